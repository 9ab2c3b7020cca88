"""Shared ground of the operators on ordered series: windows, checks, and grouped folds.

Every operator takes ``keys``, the columns that tell series apart, and an order
(a time and, where times may tie, a sequence column). Work is parallel over
series; a single series is ordered in one task, so callers with one giant series
give it a coarser key (such as a day) where the semantics allow it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def over(keys: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*(F.col(k) for k in keys)).orderBy(*(F.col(o) for o in order))


def whole(keys: Names) -> WindowSpec:
    return Window.partitionBy(*(F.col(k) for k in keys))


def position(keys: Names, order: Names) -> Column:
    """0, 1, ... along each series."""
    return F.row_number().over(over(keys, order)) - 1


def full(value: Column, w: WindowSpec, n: int, of: Column) -> Column:
    """``value`` over the last n rows, null until n non-null values are there."""
    return F.when(F.count(of).over(w.rowsBetween(-(n - 1), 0)) == n, value)


def rolling(name: str, of: Column, w: WindowSpec, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return full({"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[name](of).over(frame), w, n, of)


def with_tick_sign(df: DataFrame, keys: Names, order: Names, price: str = "price", name: str = "sign") -> DataFrame:
    """Adds the sign of the last price change that was not zero; 1 before any."""
    w = over(keys, order)
    step = F.signum(F.col(price) - F.lag(price).over(w))
    held = F.last(F.when(F.col("__step") != 0, F.col("__step")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__step", step).withColumn(name, F.coalesce(held, F.lit(1.0))).drop("__step")


def series_schema(df: DataFrame, keys: Names, rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def per_series(df: DataFrame, keys: Names, order: Names, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fold`` of each series' rows in order, in one Arrow-fed task per series; ``schema``: of what it returns, without keys."""
    names = list(keys)
    hidden = "__series"
    source = df if names else df.withColumn(hidden, F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        out = fold(pdf)
        for i, k in enumerate(names):
            out.insert(i, k, pdf[k].iloc[0] if len(out) else None)
        return out

    return source.groupBy(*(names or [hidden])).applyInPandas(run, series_schema(df, names, schema))


def per_batch(df: DataFrame, keys: Names, order: Names, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """As ``per_series`` for folds whose state is small: what ``start`` makes for a series takes its rows in order, one Arrow batch after the other.

    Spark sorts, and spills where it must; a task holds a batch and the state, whatever the length of the series. Nulls come last in the order.
    """
    names = list(keys)
    dealt = df.repartition(*names) if names else df.repartition(1)
    source = dealt.sortWithinPartitions(*names, *(F.col(o).asc_nulls_last() for o in order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = start()
        for pdf in batches:
            out = fold(pdf)
            for i, k in enumerate(names):
                out.insert(i, k, pdf[k].iloc[0] if len(out) else None)
            yield out

    return source.groupBy(*names).applyInPandas(run, series_schema(df, names, schema))
