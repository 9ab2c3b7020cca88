"""SimHash fingerprints, their links by a Gray-order hierarchical index, and near-duplicate groups.

Fingerprints that differ in ``radius`` bits or fewer agree in at least one of
``radius + 1`` parts of their bits. Distinct fingerprints are dealt by part and
value, so all links lie within groups; each task indexes its groups in Gray
order (``gray_index``) and sends one link per linked fingerprint, to one of
those it found connected, never all pairs. Groups of more than ``HOT``
fingerprints (fewer at a radius over 2, where an index leaves out less) are
dealt anew by all choices of ``FINE - radius`` of ``FINE`` parts (of
``radius + 2`` at larger radii), which bounds a group by the values of the
remaining bits. Components of these links are those of all links.

A null text is empty; its fingerprint is zero, linked like any other. Equal
fingerprints are linked at distance 0, whatever their number, by grouping.
Null ids are not reached as smallest ids; a component without any id has a null
one. Repeated rows are equal rows of the result. An empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import U, joined, lowered, mix, slices, text_column, word_hashes, words
from tickloom.llm.components import components
from tickloom.llm.gray_index import GrayIndex, gray_rank, joined_labels
from tickloom.llm.tables import forget, lean, narrowed, written

SEED = 42
HOT = 50_000
FINE = 8
BUCKET_ROWS = 20_000


def shingle_hashes(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each shingle of the lower-cased words joined by spaces, number of shingles of each row)."""
    buf, starts, _ = joined(text_column(part))
    buf = lowered(buf)
    ws, we = words(buf)
    n = np.diff(np.append(np.searchsorted(ws, starts), len(ws)))
    # The same words with single spaces between.
    length = we - ws + 1
    to = np.cumsum(length) - length
    mask = np.zeros(len(buf) + 1, np.int8)
    mask[ws] += 1
    mask[we + 1] -= 1
    out = buf.copy()
    out[we] = 32
    text = out[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)].tobytes()
    first = np.cumsum(n) - n
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    last = np.minimum(begin + size, np.repeat(first + n, many)) - 1
    a, b = to[begin].tolist(), (to[last] + length[last] - 1).tolist() if len(begin) else []
    h = xxhash.xxh64_intdigest
    return np.array([h(text[i:j], SEED) for i, j in zip(a, b, strict=True)], U), many


def majorities(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each row's hashes: the 64 bits that over half of them have; 0 for none."""
    out = np.zeros(len(many), U)
    some = np.flatnonzero(many)
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        start = (np.cumsum(many) - many)[some]
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > many[some, None], axis=1).view(">u8")[:, 0]
    return out


def code_names(turns: int) -> list[str]:
    return ["code", *[f"code{t}" for t in range(1, turns)]]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", turns: int = 1) -> DataFrame:
    """doc_id, code (the 64-bit fingerprint as a long); with more ``turns`` also code1 and so on, fingerprints of the same shingles by other hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, many = shingle_hashes(part, shingle)
                codes = []
                for _ in range(turns):
                    codes.append(pa.array(majorities(h, many).view(np.int64)))
                    h = mix(h + U(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *codes], ["doc_id", *code_names(turns)])

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"{c} long" for c in code_names(turns)]]))


def cut(bits: int, parts: int) -> list[int]:
    """Masks of ``parts`` consecutive parts of the bits, as signed longs."""
    edge = [bits * i // parts for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def dealt(codes: DataFrame, masks: list[int]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("code").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)]))
    return codes.select("code", each.alias("p")).select("code", "p.part", "p.value")


def links(codes: DataFrame, rows: int, radius: int = 2, bits: int = 64) -> DataFrame:
    """Edges (a, b) that connect distinct codes (column ``code``) as all links at ``radius`` or less do."""
    buckets = max(16, -(-(radius + 1) * rows // BUCKET_ROWS))
    keyed = dealt(codes, cut(bits, radius + 1))
    most, fine_parts = HOT // comb(max(radius, 2), 2), max(FINE, radius + 2)
    hot = written(keyed.groupBy("part", "value").count().where(F.col("count") > most).select("part", "value"), "hot")
    if not hot.isEmpty():
        few = [sum(m) for m in combinations(cut(bits, fine_parts), fine_parts - radius)]
        fine = dealt(keyed.join(hot, ["part", "value"], "left_semi").select("code").distinct(), few)
        keyed = keyed.join(hot, ["part", "value"], "left_anti").unionByName(fine.withColumn("part", F.col("part") + fine_parts))

    def connect(table: pa.Table) -> pa.Table:
        part, value, codes = (table.column(c).to_numpy() for c in ("part", "value", "code"))
        # The rows of a part and value are a group; those alone in theirs have no links here.
        order = np.lexsort((codes, value, part))
        part, value, codes = part[order], value[order], codes[order].view(U)
        new = np.append(True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]))
        again = np.append(False, (codes[1:] == codes[:-1]) & ~new[1:])
        group, codes = np.cumsum(new)[~again], codes[~again]
        some = np.bincount(group)[group] > 1
        group, codes = group[some], codes[some]
        label = GrayIndex(codes, group).linked(radius) if len(codes) else np.empty(0, np.int64)
        moved = np.flatnonzero(label != np.arange(len(codes)))
        return pa.table({"a": codes[moved].view(np.int64), "b": codes[label[moved]].view(np.int64)})

    bucket = F.pmod(F.xxhash64("part", "value"), F.lit(buckets)).alias("bucket")
    return keyed.select("part", "value", "code", bucket).groupBy("bucket").applyInArrow(lean(connect), "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", turns: int = 1) -> DataFrame:
    """doc_id, code, component_id (smallest id reachable over links of fingerprints), one row per row.

    With more ``turns``, texts are linked that any of them links, and there are more columns of codes.
    """
    names = code_names(turns)
    rows = written(fingerprints(docs, shingle, id_col, text_col, turns), "codes")
    codes = written(rows.groupBy(*names).agg(F.min("doc_id").alias("first")), "distinct-codes")
    if turns == 1:
        roots = components(links(codes.select("code"), codes.count(), radius))
    else:
        roots = components(reduce(DataFrame.unionByName, [turned(codes, name, radius) for name in names]))
    placed = codes.join(roots.withColumnsRenamed({"node": "code"}), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select(*names, "component_id")
    return rows.join(named, names).select("doc_id", *names, "component_id")


def turned(codes: DataFrame, name: str, radius: int) -> DataFrame:
    """Edges (a, b) of values of ``code`` that connect what the fingerprints called ``name`` link, one for each row of ``codes`` at most."""
    own = codes.select(F.col(name).alias("code")).distinct()
    roots = components(links(own, own.count(), radius))
    placed = codes.select(F.col("code").alias("a"), F.col(name).alias("node")).join(roots, "node", "left").select("a", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("a").alias("b"))
    return placed.join(least, "root").where("a <> b").select("a", "b")


# Near-duplicates by the similarity of their shingle sets.

BINS = 1 << 22
PREFIX_ROWS = 200_000
WIDER = 16
PAIRS = 1 << 18


def set_hashes(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each row, their number): rows of fewer words have one shingle of all."""
    buf, starts, _ = joined(text_column(part))
    buf = lowered(buf)
    ws, we = words(buf)
    h = word_hashes(buf, ws, we)
    first = np.searchsorted(ws, starts)
    n = np.diff(np.append(first, len(ws)))
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), many)
    begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    end = np.repeat(first + n, many)
    out = mix(row.astype(U) * U(0))
    for k in range(size):
        at = begin + k
        out = mix(out + np.where(at < end, h[np.minimum(at, max(len(h) - 1, 0))], U(k + 1)) if len(h) else out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.bincount(row[new], minlength=len(n))


def frequent(texts: DataFrame, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(bins of shingle hashes that some task met far more often than others, their counts, rows that ``prefixes`` makes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, rows = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                h, n = set_hashes(part, shingle)
                np.add.at(met, (h & U(BINS - 1)).astype(np.int64), 1)
                rows += int(prefix_lengths(n, similarity).sum())
        mean = met.mean()
        at = np.flatnonzero(met > mean + 6 * np.sqrt(mean) + 3)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(met[at], rows))], ["bin", "n"])

    got = texts.select("text").mapInArrow(lean(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    bins, n = got["bin"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    return bins[bins >= 0], n[bins >= 0], int(n[bins < 0].sum())


def prefix_lengths(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a set's first members, in an order common to all sets, hold one that any set this similar has among its own first; 1 for no members."""
    return n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1


def prefixes(texts: DataFrame, shingle: int, similarity: float, bins: np.ndarray, counts: np.ndarray) -> DataFrame:
    """key, node, size, at: each set's first shingles, those of rarer bins first, with the set's size and the place. The order only decides the work, never the result."""
    held = texts.sparkSession.sparkContext.broadcast((bins, counts))  # BINS entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, counts = held.value
        for batch in batches:
            for part in slices(batch):
                h, n = set_hashes(part, shingle)
                row = np.repeat(np.arange(len(n)), n)
                met = np.zeros(len(h), np.int64)
                if len(bins):
                    bin_ = (h & U(BINS - 1)).astype(np.int64)
                    at = np.minimum(np.searchsorted(bins, bin_), len(bins) - 1)
                    met = np.where(bins[at] == bin_, counts[at], 0)
                h = h[np.lexsort((h, met, row))]
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                first = place < np.repeat(prefix_lengths(n, similarity), n)
                none = np.flatnonzero(n == 0)
                row = np.concatenate([row[first], none])
                key = np.concatenate([h[first], np.zeros(len(none), U)]).view(np.int64)
                place = np.concatenate([place[first], np.zeros(len(none), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "node", "size", "at"])

    return texts.select("node", "text").mapInArrow(lean(run), "key long, node long, size int, at int")


def shared(first: DataFrame, rows: int) -> DataFrame:
    """``first`` without the keys that only one set has; bucket, and many (sets that have the key)."""

    def run(batch: pa.Table) -> pa.Table:
        _, of, many = np.unique(batch.column("key").to_numpy(), return_inverse=True, return_counts=True)
        batch = batch.append_column("many", pa.array(many[of]))
        return batch.filter(pa.array(many[of] > 1))

    bucket = F.pmod(F.xxhash64("key"), F.lit(max(16, -(-rows // PREFIX_ROWS)))).alias("bucket")
    return first.select("key", "node", "size", "at", bucket).groupBy("bucket").applyInArrow(lean(run), "key long, node long, size int, at int, bucket long, many long")


def pairs_within(lists: DataFrame, roots: DataFrame | None, beyond: int, most: int, similarity: float) -> DataFrame:
    """a, b, n: pairs of nodes with different roots that can be similar, from places ``beyond`` + 1 to ``most`` apart in the list of a key by size and node; n keys brought them."""
    lists = lists.where(F.col("many") > beyond)
    if roots is None:
        lists = lists.withColumn("root", F.col("node"))
    else:
        lists = lists.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node")).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(batches)
        key, node, size, at, root = (batch.column(c).to_numpy() for c in ("key", "node", "size", "at", "root"))
        order = np.lexsort((node, size, key))
        key, node, size, at, root = (x[order] for x in (key, node, size.astype(np.int64), at, root))
        # Lists that lie within one component are done.
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.append(begin, len(key)))
        open_ = np.repeat(np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin), many) if len(key) else np.zeros(0, bool)
        last = np.repeat(begin + many, many)
        some, out, held = np.flatnonzero(open_), [], 0
        for d in range(beyond + 1, most + 1):
            some = some[some + d < last[some]]
            # Sizes ascend in a list, so the next ones are too large as well.
            some = some[size[some] >= similarity * size[some + d] - 1e-6]
            if not len(some):
                break
            for i in (some[k : k + PAIRS] for k in range(0, len(some), PAIRS)):
                j = i + d
                can = np.minimum(at[i], at[j]) + 1 + np.minimum(size[i] - at[i], size[j] - at[j]) - 1
                ok = (root[i] != root[j]) & ((can >= similarity * (size[i] + size[j] - can) - 1e-6) | (size[i] == 0))
                i, j = i[ok], j[ok]
                out.append((np.maximum(node[i], node[j]), np.minimum(node[i], node[j])))
                held += len(i)
                if held > PAIRS:
                    yield told(out)
                    out, held = [], 0
        yield told(out)

    def told(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = np.concatenate([np.empty((2, 0), np.int64), *out], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return lists.groupBy("bucket").applyInArrow(lean(run), "a long, b long").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """node, size, sketch: for each bin of a set's hashes whether it holds an odd number of them, in a power of two of bins that grows with the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, n = set_hashes(part, shingle)
                out, end = [], np.cumsum(n)
                for i, (size, to) in enumerate(zip(n.tolist(), end.tolist(), strict=True)):
                    bins = max(64, 1 << max(0, size - 1).bit_length())
                    odd = np.bincount((h[to - size : to] & U(bins - 1)).astype(np.int64), minlength=bins) & 1
                    out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], ["node", "size", "sketch"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, size int, sketch binary")


def bins_apart(x: bytes, y: bytes) -> int:
    """In how many bins two sketches differ, the larger one folded to the size of the other: no more than the members that one of the sets has alone."""
    x, y = sorted((x, y), key=len)
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        b = (b >> bits) ^ (b & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def likely(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sketches do not rule out; never rules out a pair of this similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, xa, nb, xb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [bins_apart(x, y) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6 for m, x, n, y in zip(na, xa, nb, xb, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = (sketched.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"x{c}")) for c in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(lean(run), "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame, sketched: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least this Jaccard similarity, compared exactly; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                keep = []
                (ha, na), (hb, nb) = (set_hashes(pa.RecordBatch.from_arrays([part.column(i)], ["text"]), shingle) for i in (2, 3))
                ea, eb = np.cumsum(na), np.cumsum(nb)
                for i in range(part.num_rows):
                    x, y = ha[ea[i] - na[i] : ea[i]], hb[eb[i] - nb[i] : eb[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = written(likely(pairs, sketched, similarity), "likely")
    some = written(texts.join(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "texts")
    a, b = (some.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    found = written(left.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long"), "similar")
    forget(left, some)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of texts that are near-duplicates of others: sets of ``shingle`` words at ``similarity`` or more, over chains.

    ``docs`` has one row per distinct text, with a long id. Exact: of two such sets, the rarest
    shingles have one in common (a fifth of each set at 0.8), so the sets that have a shingle
    among their rarest meet in its list, and those whose sizes and places allow the similarity
    are compared. First each node's closest pair of those next to each other in a list, then the
    others, then those further apart, WIDER times as far each round until the longest list is
    through. Pairs are first compared by small sketches, which rule out most of those that
    differ, so few texts travel. Pairs in one component are left out, so a large group of copies costs about as many
    comparisons as it has members, while members of different components all meet.
    """
    texts = narrowed(docs, node=F.col(id_col).cast("long"), text=text_col)
    bins, counts, rows = frequent(texts, shingle, similarity)
    sketched = written(sketches(texts, shingle), "sketches")
    lists = written(shared(prefixes(texts, shingle, similarity, bins, counts), rows), "lists")
    longest = lists.agg(F.max("many")).first()[0] or 0
    pairs = written(pairs_within(lists, None, 0, 1, similarity), "candidates")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b", "n"), F.struct(F.col("b").alias("node"), "a", "b", "n"))).alias("x")).select("x.*")
    tried = written(ends.groupBy("node").agg(F.min(F.struct(-F.col("n"), "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "tried")
    found = similar(tried, texts, sketched, shingle, similarity)
    roots = written(components(found), "roots")
    forget(pairs, found)
    beyond, most = 0, 1
    while beyond < longest:
        rest = pairs_within(lists, roots, beyond, most, similarity).select("a", "b").join(tried, ["a", "b"], "left_anti")
        rest = written(rest, "rest")
        if not rest.isEmpty():
            found = similar(rest, texts, sketched, shingle, similarity)
            before, roots = roots, written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)), "roots")
            forget(found, before)
            tried = tried.unionByName(rest)
        beyond, most = most, most * WIDER
    forget(lists, sketched)
    return roots
