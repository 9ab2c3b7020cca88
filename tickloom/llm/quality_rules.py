"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its failure as one
bit of ``failed`` beside the measurements. Policies are versioned masks over
the bits, so a new policy or an ablation never reads the texts again: a
document passes a policy if ``failed & mask = 0``, and the effect of leaving
out rules follows from the counts per distinct value of ``failed`` alone.

Nulls and texts without words have 0 for all measurements and fail the rule on
the number of words. Repeated rows have a row each; an empty table gives an
empty ledger; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import slices
from tickloom.llm.measures import NAMES, measures
from tickloom.llm.tables import lean, narrowed

#: Rule names, by bit; a rule fails where its condition holds. Whole-number arithmetic, so no rounding decides.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words_mean", "word_chars < 2 * n_words"),
    ("long_words_mean", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("upper_case", "2 * n_upper > word_chars"),
    ("marked_words", "10 * n_marked_words > 3 * n_words"),
    ("few_distinct_words", "20 * n_distinct_words < n_words"),
)
#: Policies by version: the rules that they apply.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words_mean", "long_words_mean", "symbols", "duplicate_lines"),
    "v2": tuple(name for name, _ in RULES),
}
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = measures(part)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[k]) for k in NAMES)], ["doc_id", *NAMES])

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{k} long" for k in NAMES)]))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, the bits of the rules that fail."""
    bits: Column = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, id_col, text_col).withColumn("failed", bits)


def passes(policy: str, failed: str | Column = "failed") -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that pass without it.

    The ledger is first counted by ``failed``, which has at most 2**rules values.
    """
    m = mask(policy)
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = by_bits.select("failed", "n", rules.alias("r")).select("failed", "n", "r.*")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(n(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n(F.col("failed") == F.col("bit")).alias("n_failed_alone"), n(F.col("failed").bitwiseAND(F.lit(m).cast("long").bitwiseXOR(F.col("bit"))) == 0).alias("n_kept_without"))
