"""A training corpus from documents: toxic texts go, one of each group of near copies stays, repeated passages and benchmark leaks go, the rest is encoded.

Each stage takes the documents that the one before kept. Ids are taken to be
unique but for repeated rows; documents with a null id are never taken for
copies of others. A stage begins on heaps that have given back what the stages
before it left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, simhash, suffix_dedup, toxicity
from tickloom.llm.queries import table, tokenizer_path
from tickloom.llm.tables import bound_batches, give_back_heaps, written

NEAR_BITS = 7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Not SQL: the stages fit a model, link fingerprints and encode; tests hold each against a plain version.
ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def afresh(stage: Stage) -> Stage:
    """``stage``, after ``give_back_heaps``."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of the folder, scores below 0.5."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if machine.prior is not None:
        return docs
    bound_batches(spark)
    seen = docs.withColumn("__decision", machine.column(docs))
    return seen.where(F.col("__decision") * machine.slope + machine.shift < 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of texts linked by one of two SimHash fingerprints of their 2-word shingles, at NEAR_BITS or fewer differing bits."""
    key = ["doc_id", "digest"]
    named = docs.where("doc_id IS NOT NULL").withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # The digest tells texts of a repeated id apart.
    placed = simhash.groups(named.withColumn("id", F.struct(*key)), shingle=2, radius=NEAR_BITS, id_col="id", turns=2)
    kept = written(placed.where("doc_id = component_id").select("doc_id.*"), "kept")
    return named.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; texts of which nothing is left go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = suffix_dedup.remove_repeats(docs, length=100, carry=tuple(rest), whole=True)
    kept = rows.where("size(spans) = 0 OR octet_length(kept) > 0").select("doc_id", F.col("kept").cast("string").alias("text"), "rest.*")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    hit = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), "key").distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("key")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 (of the text that the ids decode to)."""
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", afresh(drop_toxic)),
    ("simhash near-dedup", afresh(drop_near_copies)),
    ("suffix-array dedup", afresh(drop_repeats)),
    ("benchmark decontamination", afresh(drop_contaminated)),
    ("bpe", afresh(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
