"""Reading futures series and rolling them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.futures import roll_gaps
from tickloom.operators.ordered import Names


def get_rolled_series(spark: SparkSession, path: str, fmt: str = "parquet", time: str = "Time", columns: Names = ("Close", "VWAP"), instrument: str = "Instrument", open_col: str = "Open", close_col: str = "Close", **options: str) -> DataFrame:
    """A table of contracts read from any Spark source, its times parsed where they are digits, and its prices less the roll gaps."""
    df = spark.read.format(fmt).options(**options).load(path)
    if dict(df.dtypes)[time] != "timestamp":
        digits = F.rpad(F.col(time).cast("string"), 20, "0")  # year to second, and six digits of a second
        parted = F.regexp_replace(digits, r"^(\d{8})(\d{6})(\d{6})$", "$1 $2.$3")
        df = df.withColumn(time, F.to_timestamp(parted, "yyyyMMdd HHmmss.SSSSSS"))
    rolled = roll_gaps(df, instrument, open_col, close_col, True, (), (time,))
    return rolled.withColumns({c: F.col(c) - F.col("gap") for c in columns}).drop("gap")
