"""Inputs and written intermediate tables of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_corpus_shared", None)
        if found is None:
            found = spark._corpus_shared = tempfile.mkdtemp(prefix="corpus-")
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and lost executors take nothing with them."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Lets the session send at most ARROW_BYTES to a Python worker at once; long texts make batches of rows large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) not in range(1, ARROW_BYTES + 1):
        spark.conf.set(name, str(ARROW_BYTES))


def narrowed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named inputs, under internal names, so that further columns of the caller can't clash; in batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col)).cast("long")).first()[0] or 0


def give_back() -> None:
    """Returns the memory that this worker has freed to the machine; Spark keeps workers for other tasks, and would count it to them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs collect what earlier work left and return it to the machine; a heap that is not told to keeps all that it ever grew to."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def lean(f: Callable) -> Callable:
    """``f``, a function of Arrow tables or of an iterator of batches, followed by ``give_back``."""
    if len(inspect.signature(f).parameters) == 2:

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            try:
                return f(a, b)
            finally:
                give_back()

    elif inspect.isgeneratorfunction(f):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from f(batches)
            finally:
                give_back()

    else:

        def run(a: pa.Table) -> pa.Table:
            try:
                return f(a)
            finally:
                give_back()

    return run
