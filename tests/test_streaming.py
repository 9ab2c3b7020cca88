"""Streams give what batches give on the same ticks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, sampling
from tickloom.sources.futures import get_rolled_series
from tickloom.streaming import bars as streaming


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n), "ts": pd.date_range("2024-01-01", periods=n, freq="s"), "seq": np.arange(n), "price": 100 + np.cumsum(rng.normal(size=n)), "volume": rng.integers(1, 9, n).astype(float)})
    folder = tmp_path_factory.mktemp("ticks")
    for i in range(3):  # a file per micro-batch, in order of time
        spark.createDataFrame(pdf[i * 200 : (i + 1) * 200]).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.createDataFrame(pdf), str(folder)


def streamed(spark, folder, transform, schema, name):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = transform(source).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_ruled_bars(spark, ticks):
    batch, folder = ticks
    for name, rule in (("imb", lambda s=None: bars.Imbalance("volume", state=s)), ("sums", lambda s=None: bars.Sum(60, "volume", s)), ("runs", lambda s=None: bars.Runs("money", state=s))):
        got = streamed(spark, folder, lambda t, rule=rule: streaming.ruled_bars(t, rule, "k"), batch.schema, name)
        want = bars.ruled_bars(batch, rule, ["k"])
        cols = ["k", "bar_id", "ts", "open", "high", "low", "close", "volume", F.round("vwap", 6)]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_cusum(spark, ticks):
    batch, folder = ticks
    got = streamed(spark, folder, lambda t: streaming.cusum_events(t.withColumnRenamed("price", "close"), 3.0, "k"), batch.schema, "cusum")
    want = sampling.get_t_events(batch.withColumnRenamed("price", "close"), 3.0, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_time_bars_close_behind_the_watermark(spark, ticks):
    batch, folder = ticks
    got = streamed(spark, folder, lambda t: streaming.time_bars(t, "1 minute", "10 seconds", ["k"]), batch.schema, "minutes").count()
    assert 0 < got < bars.time_bars(batch, "1 minute", ["k"]).count()


def test_rolled_series(spark, tmp_path):
    rows = [("20240101093000000001", "A", 10.0, 11.0, 10.5), ("20240102093000000002", "A", 11.0, 12.0, 11.5), ("20240103093000000003", "B", 20.0, 21.0, 20.5)]
    spark.createDataFrame(rows, "Time string, Instrument string, Open double, Close double, VWAP double").write.parquet(str(tmp_path / "f"))
    got = get_rolled_series(spark, str(tmp_path / "f")).orderBy("Time").collect()
    assert [r["Close"] for r in got] == [11 + 8, 12 + 8, 21] and got[2]["Time"].microsecond == 3
