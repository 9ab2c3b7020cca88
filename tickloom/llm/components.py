"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.gray_index import joined_labels
from tickloom.llm.tables import forget, lean, written

EDGES = 1 << 19


def contracted(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """Edges (a, b) from each node to the smallest one that ``most`` edges of its task connect it with; with ``roots``, from those to themselves as well."""
    return edges.select("a", "b").mapInArrow(lean(contract(most, roots)), "a long, b long")


def contract(most: int, roots: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = joined_labels(len(nodes), [(at[: len(a)], at[len(a) :])])
        some = np.arange(len(nodes)) if roots else np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                if rows + part.num_rows > most:
                    yield star(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield star(held)

    return run


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); root is the smallest node reachable.

    Tasks first replace up to ``most`` edges at a time by links to the smallest node that these
    connect. What is left of a small graph then fits one such step, which ends the work; a larger
    one alternates it with large-star and small-star steps over the whole table: each moves links
    to smaller nodes and keeps connectivity, with one row per link and no neighbourhood gathered in
    a task. Every round is a written table; the end is when a round changes nothing. Repeated
    edges count once, edges with a null end or from a node to itself are left out.
    """
    now = written(contracted(edges.where("a <> b"), most), "edges")
    rows, said = now.count(), None
    while rows > most:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, now = now, written(small, "edges")
        forget(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == said:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        rows, said = state[0], state
        before, now = now, written(contracted(now, most), "edges")
        forget(before)
    return contracted(now.coalesce(1), most, roots=True).withColumnsRenamed({"a": "node", "b": "root"})
