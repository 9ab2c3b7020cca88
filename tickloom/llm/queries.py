"""The corpus operators' queries on the tables of a folder, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, quality_model, quality_rules, simhash, substring, suffix_dedup, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_simhash, op3_substring_dedup, op4_suffix_dedup, op5_quality_classifier, op6_toxicity, op7_quality_rules, op8_token_counts, op9_decontamination, op10_bpe)}


SQL_WORDS = r"""
  WITH w AS (
    SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
  )
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": r"""
  WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
  , d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
  , bits AS (SELECT *, list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(x, 1 + (5 * k // 4)::INT, 3 - CASE WHEN 5 * k // 4 >= 38 THEN 1 ELSE 0 END))::INT
           * CASE WHEN 5 * k // 4 >= 38 THEN 16 ELSE 1 END) >> (7 - (5 * k) % 4)::INT) % 32, 1)), lambda a, b: a || b) AS payload_digest FROM d)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
         CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
  FROM bits""",
        "op3_substring_dedup": SQL_WORDS
        + r"""
  , win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13)
  , keyed AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM win)
  , late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM keyed) WHERE first < doc_id)
  , off AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late)
  , offs AS (SELECT doc_id, list(p) AS ps FROM off GROUP BY doc_id)
  , each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w)
  , left_over AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY each.p) AS kept FROM each ANTI JOIN off ON each.doc_id = off.doc_id AND each.p = off.p GROUP BY each.doc_id)
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM w LEFT JOIN offs USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
        "op4_suffix_dedup": r"""
  WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)
  , win AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS k FROM (SELECT *, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100))
  , late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1)
  , ranges AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS z FROM (
      SELECT doc_id, p, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
        SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS gap FROM late)) GROUP BY doc_id, g)
  , gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM ranges)
  , per AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(z) AS tail FROM ranges GROUP BY doc_id)
  , heads AS (SELECT gaps.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN b USING (doc_id) GROUP BY gaps.doc_id)
  SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
         sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
  FROM b LEFT JOIN per USING (doc_id) LEFT JOIN heads USING (doc_id)""",
        "op7_quality_rules": SQL_WORDS
        + r"""
  , win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3)
  , keyed AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS k FROM win)
  , twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1)
  , cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id)
  , lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  , held AS (SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL)
  , dup AS (SELECT doc_id, sum(c - 1) AS n, sum(c) AS all_lines FROM held GROUP BY doc_id)
  , m AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.all_lines, 0)::BIGINT AS n_lines
    FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)
  )
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
              OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
  FROM m""",
        "op9_decontamination": r"""
  WITH low AS (SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
               UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark)
  , w AS (SELECT kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM low)
  , items AS (SELECT id AS item_id, ws, least(len(ws), 10) AS size FROM w WHERE kind = 'b' AND len(ws) > 0)
  , iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM items))
  , sizes AS (SELECT DISTINCT size FROM items)
  , dw AS (SELECT id AS doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k FROM (SELECT w.id, w.ws, sizes.size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE kind = 'd' AND len(ws) >= size))
  , m AS (SELECT dw.doc_id, dw.i, dw.size, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.size = iw.size)
  , hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id)
  , its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
  SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
         sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM w LEFT JOIN hit ON w.id = hit.doc_id LEFT JOIN its ON w.id = its.doc_id WHERE kind = 'd'""",
    }
