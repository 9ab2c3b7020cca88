"""Functions over parts of a table, in place of process pools: Spark deals the parts, retries lost tasks and fails loudly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def job_list(spark: SparkSession, func: Callable[..., dict], jobs: list[dict], schema: str) -> DataFrame:
    """One row per job, what ``func(**job)`` returns; a job that fails fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([func(**jobs[i]) for i in pdf["id"]])

    return spark.range(0, len(jobs), 1, max(1, min(len(jobs), 200))).mapInPandas(run, schema)


def pandas_obj(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str, parts: int) -> DataFrame:
    """``func`` of consecutive parts of a table; the result is in order again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return func(pdf.sort_values(order).drop(columns="__part"))

    dealt = df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id())
    return dealt.groupBy("__part").applyInPandas(run, schema).orderBy(order)
