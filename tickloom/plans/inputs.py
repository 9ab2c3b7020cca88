"""The engine's inputs, built from the driver's tables: ticks, bars, daily series, rolls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k (event type), ts, seq, price, volume; the session's time zone is taken to be UTC."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), (F.col("value") + 1).cast("double").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One close per hour and key, as a series to label."""
    t = ticks(spark, sf_dir)
    return t.groupBy("k", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("price", F.struct("ts", "seq")).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, close: the day's highest order price."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.max("o_totalprice").cast("double").alias("close"))


TICKS = "ticks AS MATERIALIZED (SELECT event_type AS k, ts::TIMESTAMP AS ts, event_id::BIGINT AS seq, (value + 1)::DOUBLE AS price, json_extract_string(props, '$.k')::DOUBLE + 1 AS volume FROM events)"
HOURLY = TICKS + ", hourly AS MATERIALIZED (SELECT k, date_trunc('hour', ts) AS ts, arg_max(price, seq) AS close, max(price) AS high, min(price) AS low, sum(volume) AS volume FROM ticks GROUP BY 1, 2)"
DAILY = "daily AS MATERIALIZED (SELECT o_orderdate::TIMESTAMP AS ts, max(o_totalprice)::DOUBLE AS close FROM orders GROUP BY 1)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero, so that the order of sums does not show."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {digits}) + 0.0 AS {c.split(' AS ')[-1]}" for c in columns)
