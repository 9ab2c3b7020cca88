"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of id and
text, so rows without an id spread like all others. Each block sends its
distinct window hashes, sorted and packed by hash bucket, together with the
smallest document that has them; a bucket finds the hashes that several blocks
have and tells each block but the one with the smallest document. So a window
travels once per block however many documents repeat it, and no task gathers
the documents of a passage. A block then removes the windows it was told of and
those that a smaller document of its own has, merges them into maximal
intervals of words, and emits what is left.

Hashes have 64 bits: two of n distinct windows agree with probability n**2 / 2**65.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r. A null text has no
words. A null id comes before all others; rows with equal ids do not remove
each other's windows. Texts shorter than the window lose nothing. Whitespace
becomes one space. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import MULTIPLIERS, Rolling, U, joined, slices, text_column, word_hashes, words
from tickloom.llm.tables import lean, narrowed, text_bytes

BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 8 << 20
TASK_BYTES = 32 << 20
LOWEST = -(1 << 63)
_windows = Rolling(MULTIPLIERS[1])


def ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("doc_id").cast(pa.int64()), LOWEST).to_numpy(zero_copy_only=False)


def hashed(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each window of a slice; the first word counts over the slice."""
    buf, starts, _ = joined(text_column(part))
    ws, we = words(buf)
    if len(ws) < window:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.searchsorted(starts, ws, "right") - 1
    first = np.flatnonzero(row[window - 1 :] == row[: len(ws) - window + 1])
    return _windows.load(word_hashes(buf, ws, we)).of(first, first + window), row[first], first


def smallest(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, start of each key's run in that order, the run's smallest value)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return order, start, np.minimum.reduceat(of[order], start) if len(k) else of[:0]


def send(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()
        keys, of = [np.empty(0, U)], [np.empty(0, np.int64)]
        for part in (p for b in batch for p in slices(b)):
            h, row, _ = hashed(part, window)
            keys.append(h)
            of.append(ids(part)[row])
        keys, of = np.concatenate(keys), np.concatenate(of)
        order, start, least = smallest(keys, of)
        distinct = keys[order][start]
        names, index = np.unique(least, return_inverse=True)
        bucket = distinct % U(buckets)
        deal = np.lexsort((index, bucket))
        full, begin = np.unique(bucket[deal], return_index=True)
        own = np.split(deal, begin[1:]) if len(full) else []
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(full.astype(np.int64), pa.int64()),
                "block": pa.array(np.full(len(full), block), pa.int64()),
                "hashes": pa.array([distinct[x].tobytes() for x in own], pa.binary()),
                "docs": pa.array([packed(names, index[x]) for x in own], pa.binary()),
            }
        )

    return run


def packed(names: np.ndarray, index: np.ndarray) -> bytes:
    """Ids of ascending places in ``names``: number of distinct ones, width, the smallest, distances from it, how often each occurs."""
    used, many = np.unique(index, return_counts=True)
    own = names[used]
    width = 4 if int(own[-1]) - int(own[0]) < 1 << 32 else 8
    away = (own - own[:1]).view(U).astype(np.uint32 if width == 4 else U)
    small = np.uint16 if many.max() < 1 << 16 else np.uint32
    return np.array([len(used), width, small().itemsize, own[0]], np.int64).tobytes() + away.tobytes() + many.astype(small).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n, width, small, least = np.frombuffer(data, np.int64, 4).tolist()
    away = np.frombuffer(data, np.uint32 if width == 4 else U, n, 32).astype(U).view(np.int64)
    return np.repeat(away + np.int64(least), np.frombuffer(data, np.uint16 if small == 2 else np.uint32, n, 32 + width * n))


def compare(table: pa.Table) -> pa.Table:
    """Of a bucket: to each block, the hashes that a smaller document of another block has."""
    hashes = [np.frombuffer(x, U) for x in table.column("hashes").to_pylist()]
    least = np.concatenate([unpacked(x) for x in table.column("docs").to_pylist()])
    block = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    keys = np.concatenate(hashes)
    order, start, first = smallest(keys, least)
    size = np.diff(np.append(start, len(keys)))
    many = np.flatnonzero(size > 1)
    at = order[np.repeat(start[many], size[many]) + (np.arange(size[many].sum()) - np.repeat(np.cumsum(size[many]) - size[many], size[many]))]
    late = at[least[at] > np.repeat(first[many], size[many])]
    late = late[np.argsort(block[late], kind="stable")]
    cut = np.searchsorted(block[late], np.arange(len(hashes) + 1))
    full = np.flatnonzero(np.diff(cut))
    blocks = table.column("block").to_numpy()
    return pa.table({"block": pa.array(blocks[full], pa.int64()), "hashes": pa.array([keys[late[cut[b] : cut[b + 1]]].tobytes() for b in full], pa.binary())})


def remove(window: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.empty(0, U), *(np.frombuffer(x, U) for x in told.column("hashes").to_pylist())]))
        parts = [p for b in docs.combine_chunks().to_batches() for p in slices(b)]
        found = [hashed(p, window) for p in parts]
        of = [ids(p)[row] for p, (_, row, _) in zip(parts, found, strict=True)]
        keys = np.concatenate([np.empty(0, U), *(h for h, _, _ in found)])
        own = np.concatenate([np.empty(0, np.int64), *of])
        order, start, first = smallest(keys, own)
        late = np.empty(len(keys), bool)
        late[order] = own[order] > np.repeat(first, np.diff(np.append(start, len(keys))))
        if len(known) and len(keys):
            late |= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
        cut = np.cumsum([0, *(len(h) for h, _, _ in found)])
        return pa.concat_tables([kept_schema(docs).empty_table(), *(kept(p, first[late[a:b]], window, docs) for p, (_, _, first), a, b in zip(parts, found, cut[:-1], cut[1:], strict=True))])

    return run


def kept_schema(docs: pa.Table) -> pa.Schema:
    return pa.schema([docs.schema.field("doc_id"), ("n_words", pa.int64()), ("intervals", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("text", pa.string())])


def kept(part: pa.RecordBatch, gone: np.ndarray, window: int, docs: pa.Table) -> pa.Table:
    """The rows of a slice without the words of the windows that start at the words ``gone``."""
    buf, starts, _ = joined(text_column(part))
    ws, we = words(buf)
    row_start = np.searchsorted(ws, starts)
    row_end = np.append(row_start[1:], len(ws))
    step = np.zeros(len(ws) + 1, np.int32)
    step[gone] += 1
    step[gone + window] -= 1
    off = np.cumsum(step)[:-1] > 0
    # Maximal runs of removed words; no run crosses rows, as no window does, but runs of adjacent rows may touch.
    edge = np.concatenate(([False], off, [False]))
    breaks = np.zeros(len(ws) + 1, bool)
    breaks[row_start] = True
    begin = np.flatnonzero(edge[1:-1] & (~edge[:-2] | breaks[:-1]))
    finish = np.flatnonzero(edge[1:-1] & (~edge[2:] | breaks[1:]))
    run_row = np.searchsorted(row_start, begin, "right") - 1
    base = row_start[run_row]
    n_runs = np.bincount(run_row, minlength=len(starts))
    spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(finish - base)], ["first", "last"])
    intervals = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_runs))).astype(np.int32)), spans)
    # Bytes of the kept words and the separator after each.
    mask = np.zeros(len(buf) + 1, np.int8)
    on = ~off
    mask[ws[on]] += 1
    mask[we[on] + 1] -= 1
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    out = buf.copy()
    out[we] = 32
    out = out[mask]
    size = np.concatenate(([0], np.cumsum(np.where(on, we - ws + 1, 0))))
    a, b = size[row_start], size[row_end]
    data = out.tobytes()
    texts = pa.array([data[i : j - 1] if j > i else b"" for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()).cast(pa.string())
    return pa.table([part.column("doc_id"), pa.array(row_end - row_start), intervals, texts], schema=kept_schema(docs))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, intervals (first and last removed word of each maximal run), text (what is left), one row per row.

    Removed is each word covered by a window that also starts in a document with a smaller id.
    Blocks, buckets and tasks grow in number with the bytes of the texts, not in size.
    """
    total = text_bytes(docs, text_col)
    blocks, buckets = max(8, -(-total // block_bytes)), max(16, -(-total // bucket_bytes))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = narrowed(docs, doc_id=id_col, text=text_col).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(tasks, "block")
    sent = dealt.groupBy("block").applyInArrow(lean(send(window, buckets)), "bucket long, block long, hashes binary, docs binary")
    told = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lean(compare), "block long, hashes binary")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lean(remove(window)), f"doc_id {kind}, n_words long, intervals array<struct<first: long, last: long>>, text string")
