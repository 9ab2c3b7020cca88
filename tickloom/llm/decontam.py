"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every window of a benchmark item is a sequence of up to ``window`` words; its
shingles (three words, or all of a shorter window) are ordered by how rare they
are in the corpus. As all shingles of a window must occur, the rarest one is a
sufficient prefix: a document can contain the window only where it has that
shingle. The shingle's position gives the place of the window, which must lie
within the document (positional and length bounds); there the words are
compared exactly.

The corpus is read twice: once to find the occurrences of benchmark shingles,
once to compare and count. The sets of distinct shingles and windows are
broadcast only if they are counted to be below ``BROADCAST_ROWS``; beyond it
the same joins shuffle, and adaptive execution splits skewed keys.

A-Z count as a-z; words are runs of digits, a-z and characters above U+007F.
Null texts have no words, on both sides. Rows are told apart by id and text, so
repeated ids and null ids keep rows of their own. A null item id counts as
``null``. An empty benchmark hits nothing; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import narrowed, written

#: Fixed value: what parts words.
PARTING = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SHINGLE = 3
BROADCAST_ROWS = 500_000


def words(text: str) -> Column:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return F.expr(f"array_remove(split({lower}, '{PARTING}'), '')")


def shingles(array: str, size: int) -> Column:
    """Hashes of the shingles of an array of words, by position."""
    parts = ", ".join(f"{array}[i + {k}]" for k in range(size))
    return F.expr(f"CASE WHEN size({array}) >= {size} THEN transform(sequence(0, size({array}) - {size}), i -> xxhash64({size}, {parts})) ELSE array() END")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, ws (the words of one window), q (the size of its shingles)."""
    items = narrowed(benchmark, item=F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text=text_col).select("item", words("text").alias("ws")).where("size(ws) > 0")
    each = F.expr(f"CASE WHEN size(ws) <= {window} THEN array(ws) ELSE transform(sequence(1, size(ws) - {window} + 1), i -> slice(ws, i, {window})) END")
    return items.select("item", F.explode(each).alias("ws")).withColumn("q", F.least(F.size("ws"), F.lit(SHINGLE)))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(matches, items): matches has id, key, start, len and window of every occurrence of a window; items has window and item."""
    found = written(item_windows(benchmark, window).withColumn("window", F.array_join("ws", " ")).select("item", "window", "ws", "q"), "windows")
    windows = found.select("window", "ws", "q").dropDuplicates(["window"])
    sizes = [r["q"] for r in found.select("q").distinct().collect()]  # at most SHINGLE values
    tokens = None
    for q in sizes:
        part = windows.where(F.col("q") == q).select("window", "ws", F.posexplode(shingles("ws", q)).alias("offset", "token"))
        tokens = part if tokens is None else tokens.unionByName(part)
    keyed = docs.select("id", F.xxhash64("text").alias("key"), words("text").alias("ws"))
    if tokens is None:
        none = keyed.where("false").select("id", "key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("window"))
        return none, found.select("window", "item")
    tokens = written(tokens, "tokens")
    wanted = tokens.select("token").distinct()
    n = tokens.count()
    postings = None
    for q in sizes:
        part = keyed.select("id", "key", F.size("ws").alias("n_words"), F.posexplode(shingles("ws", q)).alias("pos", "token"))
        postings = part if postings is None else postings.unionByName(part)
    postings = written(postings.join(small(wanted, n), "token"), "postings")
    # The rarest shingle of each window; one without occurrences rules the window out.
    rarity = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(rarity, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"), F.col("token"))).alias("prefix"), F.max(F.size("ws")).alias("len"))
    prefix = ranked.where("prefix.n > 0").select("window", "len", "prefix.offset", "prefix.token")
    at = postings.join(small(prefix, n), "token").select("id", "key", (F.col("pos") - F.col("offset")).alias("start"), "len", "window", "n_words")
    at = at.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).drop("n_words")
    return at.distinct(), found.select("window", "item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of the ids of items with occurring windows), key (xxhash64 of the text), one row per row of ``docs``."""
    rows = narrowed(docs, id=id_col, text=text_col)
    at, items = occurrences(rows, benchmark, window)
    wanted = at.groupBy("id", "key").agg(F.collect_list(F.struct("start", "len", "window")).alias("found")).withColumnsRenamed({"id": "id_", "key": "key_"})
    both = rows.withColumn("key", F.xxhash64("text")).join(wanted, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left")
    compared = both.select("id", "key", words("text").alias("ws"), "found").select(
        "id",
        "key",
        F.size("ws").cast("long").alias("n_words"),
        F.expr("filter(found, x -> array_join(slice(ws, x.start + 1, x.len), ' ') = x.window)").alias("found"),
    )
    covered = F.expr("size(array_distinct(flatten(transform(found, x -> sequence(x.start, x.start + x.len - 1)))))")
    base = compared.select("id", "key", "n_words", F.when(F.size("found") > 0, covered.cast("long")).otherwise(F.lit(0).cast("long")).alias("n_hit"), F.expr("array_distinct(transform(found, x -> x.window))").alias("windows"))
    base = written(base, "compared")
    hit = base.where("n_hit > 0").select("id", "key", F.explode("windows").alias("window")).join(items.distinct(), "window").groupBy("id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = hit.withColumnsRenamed({"id": "id_", "key": "key_"})
    out = base.join(hit, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "key")
