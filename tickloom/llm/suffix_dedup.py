"""Exact removal of byte strings that occur earlier, by suffix arrays of the places where texts may agree.

Windows of ``length`` bytes are represented by anchors (see ``anchors``), so
equal windows meet under one key wherever they are. The steps:

1. Documents are dealt into blocks of about ``BLOCK_BYTES``. A block sends each
   distinct run of windows once, to a bucket of the run's key and content, with
   the smallest document that has it; and each distinct key once, to a bucket of
   the key, with one content and the number of contents that the block has.
2. A bucket of contents tells blocks which of their runs a smaller document
   elsewhere has. A bucket of keys tells which keys have several contents, and
   which of these have more than ``HOT``.
3. A block notes the runs that are whole repeats. Of each other run whose key
   has several contents it sends the bytes to the key's bucket; if the key is
   hot, it sends the run's windows instead, each to a bucket of its own content.
4. A key's bucket cuts the runs into pieces of at most ``WIDTH`` windows. Equal
   pieces are told by their bytes; of pieces that agree in their core (what all
   their windows cover, one symbol by the order of its bytes) the suffixes are
   sorted with ``suffix_array``, and neighbours that agree on a whole window are
   one string. All but a string's first place are noted; so are all but the first
   of equal windows of hot keys.
5. A block merges what was noted into maximal spans and emits what is left.

Whole runs and windows of hot keys are equal if 128 bits of hashes are; pieces
are compared by their bytes. A content travels once per block, however many
documents have it. A task holds a block, the distinct contents of a bucket, or a
bucket's runs of keys with at most ``HOT`` contents per key, so a passage with
other surroundings in every document is split by those surroundings.

Null texts are empty; texts shorter than ``length`` lose nothing; matches never
cross documents. Null ids come before all others, in the order of a hash of
their texts. Documents with equal ids are ordered by that hash as well; rows
equal in both count as one document, and each gets its result. An empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.anchors import runs
from tickloom.llm.arrays import MULTIPLIERS, Rolling, U, byte_values, joined, mix, slices, text_column
from tickloom.llm.substring import LOWEST, packed, unpacked
from tickloom.llm.suffix_array import suffix_array
from tickloom.llm.tables import lean, narrowed, text_bytes, written

BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 8 << 20
TASK_BYTES = 32 << 20
HOT = 512
BATCH_RUNS = 1024
WIDTH = 8
_windows = (Rolling(MULTIPLIERS[0]), Rolling(MULTIPLIERS[1]))
_window_bytes = (byte_values(5), byte_values(6))


def longs(table: pa.Table, column: str, width: int) -> np.ndarray:
    """Packed rows of ``width`` 64-bit numbers, as columns."""
    return np.concatenate([np.empty((width, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(width, -1) for x in table.column(column).to_pylist())], axis=1)


def ids(part: pa.RecordBatch) -> np.ndarray:
    """Where documents stand in the order: their ids; nulls first, by their texts' hash."""
    own = part.column("doc_id").cast(pa.int64())
    if not own.null_count:
        return own.to_numpy()
    first = (part.column("key").to_numpy().view(U) >> U(3)).view(np.int64) + LOWEST
    return pc.if_else(pc.is_null(own), pa.array(first), own).to_numpy()


def parts_of(table: pa.Table):
    """Slices of a block without repeated rows, with places in the order and text hashes."""
    seen: set[tuple[int, int]] = set()
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch):
            own, key = ids(part), part.column("key").to_numpy()
            new = [i for i, x in enumerate(zip(own.tolist(), key.tolist(), strict=True)) if x not in seen and not seen.add(x)]
            yield (part, own, key) if len(new) == len(own) else (part.take(pa.array(new)), own[new], key[new])


def starting(keys: np.ndarray) -> np.ndarray:
    """Whether each of ascending keys differs from the one before."""
    return np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)


def stretches(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each stretch of equal values."""
    at = np.flatnonzero(starting(values))
    return list(zip(values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)], strict=True)) if len(values) else []


class Sent:
    """What a block sends of its runs, in an order that depends on the runs alone, so that answers can name places in it.

    ``h``, ``c``, ``of``: the distinct runs' key, content and smallest document, by bucket; ``keys``, ``some``, ``many``: the
    distinct keys, the smallest content of each and the number of contents, by bucket.
    """

    def __init__(self, h: np.ndarray, c: np.ndarray, of: np.ndarray, buckets: int) -> None:
        order = np.lexsort((of, c, h))
        order = order[starting(h[order]) | starting(c[order])]
        h, c, of = h[order], c[order], of[order]
        begin = np.flatnonzero(starting(h))
        keys, some, many = h[begin], c[begin], np.diff(np.append(begin, len(h)))
        to = mix(h + mix(c)) % U(buckets)
        deal = np.lexsort((c, h, of, to))
        self.h, self.c, self.of, self.to = h[deal], c[deal], of[deal], to[deal]
        to = keys % U(buckets)
        deal = np.argsort(to, kind="stable")
        self.keys, self.some, self.many, self.key_to = keys[deal], some[deal], many[deal], to[deal]


def send(length: int, k: int, buckets: int):
    """Of a block: kind 0, runs to a bucket of contents; kind 1, keys to a bucket of keys."""

    def run(table: pa.Table) -> pa.Table:
        h, c, of = [np.empty(0, U)], [np.empty(0, U)], [np.empty(0, np.int64)]
        for part, own, _ in parts_of(table):
            row, _, _, _, key, content = runs(*joined(text_column(part)), length, k)
            h.append(key)
            c.append(content)
            of.append(own[row])
        sent = Sent(np.concatenate(h), np.concatenate(c), np.concatenate(of), buckets)
        names, index = np.unique(sent.of, return_inverse=True)
        rows = [(0, b, sent.h[i:j].tobytes() + sent.c[i:j].tobytes(), packed(names, index[i:j])) for b, i, j in stretches(sent.to)]
        few = np.minimum(sent.many, 65535).astype(np.uint16)
        rows += [(1, b, sent.keys[i:j].tobytes() + sent.some[i:j].tobytes(), few[i:j].tobytes()) for b, i, j in stretches(sent.key_to)]
        kind, bucket, data, more = zip(*rows, strict=True) if rows else ((), (), (), ())
        block = [table.column("block")[0].as_py()] * len(rows)
        return pa.table([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], names=["kind", "bucket", "block", "runs", "more"])

    return run


def compare(table: pa.Table) -> pa.Table:
    """To each block, places in what it sent to a bucket: of contents, those that a smaller document has; of keys, those of several contents and the hot ones."""
    kind = table.column("kind")[0].as_py()
    first_, second = longs(table, "runs", 2).view(U)
    n = [len(x) // 16 for x in table.column("runs").to_pylist()]
    message = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(message)) - np.repeat(np.cumsum(n) - n, n)
    if kind == 0:
        least = np.concatenate([unpacked(x) for x in table.column("more").to_pylist()])
        order = np.lexsort((least, second, first_))
        begin = np.flatnonzero(starting(first_[order]) | starting(second[order]))
        told = [order[least[order] > np.repeat(least[order[begin]], np.diff(np.append(begin, len(order))))], order[:0]]
    else:
        many = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("more").to_pylist()]).astype(np.int64)
        order = np.argsort(first_, kind="stable")
        begin = np.flatnonzero(starting(first_[order]))
        size = np.diff(np.append(begin, len(order)))
        c = second[order]
        several = (np.maximum.reduceat(many[order], begin) > 1) | (np.minimum.reduceat(c, begin) != np.maximum.reduceat(c, begin))
        told = [order[np.repeat(x, size)] for x in (several, several & (np.add.reduceat(many[order], begin) > HOT))]
    out: list[dict[int, bytes]] = []
    for some in told:
        some = np.sort(some)
        out.append({m: place[some[i:j]].astype(np.uint32).tobytes() for m, i, j in stretches(message[some])})
    block, to = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    rows = [(block[m], kind, to, out[0].get(m, b""), out[1].get(m, b"")) for m in sorted(out[0].keys() | out[1].keys())]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, _told, strict=True)], names=["block", "kind", "bucket", "places", "hot"])


_told = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
TOLD = "block long, kind int, bucket long, places binary, hot binary"


def marked(told: pa.Table, kind: int, column: str, to: np.ndarray) -> np.ndarray:
    """Which of the things sent, by bucket ``to``, the answers name."""
    out, start = np.zeros(len(to), bool), {b: i for b, i, _ in stretches(to)}
    for k, b, places in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", column)), strict=True):
        if k == kind:
            out[start[b] + np.frombuffer(places, np.uint32).astype(np.int64)] = True
    return out


NOTED = "kind int, block long, bucket long, longs binary, data binary"
_noted = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("longs", pa.binary()), ("data", pa.binary())])


def by_bucket(kind: int, to: np.ndarray, columns: np.ndarray, pieces: list[bytes] | None = None) -> list[tuple]:
    """Rows of NOTED, one per bucket, with columns of numbers and bytes dealt to it."""
    deal = np.argsort(to, kind="stable")
    columns = columns[:, deal]
    return [(kind, -1, b, np.ascontiguousarray(columns[:, i:j]).tobytes(), b"".join([pieces[x] for x in deal[i:j]]) if pieces else b"") for b, i, j in stretches(to[deal])]


def note(length: int, k: int, buckets: int):
    """Of a block: kind 0, repeats as (id, key, start, end); kind 1, runs of keys with several contents as (h, anchor, first, size, id, key, block) and their bytes; kind 2, windows of hot keys as (hash, hash, id, key, start, block)."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        found = []
        for part, own, key in parts_of(docs):
            buf, starts, ends = joined(text_column(part))
            row, first, last, anchor, h, c = runs(buf, starts, ends, length, k)
            base = starts[row]
            found.append((own[row], key[row], first - base, last - base, anchor - base, h, c, part, row))
        if not found:
            return _noted.empty_table()
        own, key, first, last, anchor, h, c = (np.concatenate([f[i] for f in found]) for i in range(7))
        sent, me = Sent(h, c, own, buckets), docs.column("block")[0].as_py()
        # Runs in the order of (h, c), documents and places, beside the distinct runs in that order.
        order = np.lexsort((first, key, own, c, h))
        new = starting(h[order]) | starting(c[order])
        distinct = np.lexsort((sent.c, sent.h))
        gone = marked(told, 0, "places", sent.to)[distinct]
        of_key = np.argsort(sent.keys, kind="stable")
        group = np.cumsum(starting(h[order])) - 1
        asked, hot = (marked(told, 1, x, sent.key_to)[of_key] for x in ("places", "hot"))
        lead = ~gone[np.cumsum(new) - 1] & new if len(order) else new
        rows, ranges = [], []
        r = order[~lead]
        ranges.append((own[r], key[r], first[r], last[r] + length))
        want = np.sort(order[lead & asked[group] & ~hot[group]]) if len(order) else order
        offset = np.cumsum([0, *(len(f[0]) for f in found)])
        if len(want):
            pieces, size, at = [], last[want] - first[want] + length, (-1, -1)
            for i, p in zip(want.tolist(), (np.searchsorted(offset, want, "right") - 1).tolist(), strict=True):
                row = int(found[p][8][i - offset[p]])
                if at != (p, row):
                    at, text = (p, row), text_column(found[p][7])[row].as_buffer().to_pybytes()
                pieces.append(text[int(first[i]) : int(last[i]) + length])
            table = np.stack([h[want].view(np.int64), anchor[want] - first[want], first[want], size, own[want], key[want], np.full(len(want), me, np.int64)])
            rows += by_bucket(1, (h[want] % U(buckets)).astype(np.int64), table, pieces)
        want = np.sort(order[lead & asked[group] & hot[group]]) if len(order) else order
        if len(want):
            out = []
            for p, i, j in stretches(np.searchsorted(offset, want, "right") - 1):
                w = want[i:j]
                buf, starts, _ = joined(text_column(found[p][7]))
                many = last[w] - first[w] + 1
                of = np.repeat(w, many)
                pos = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                at = starts[found[p][8][of - offset[p]]] + pos
                a, b = (x.load(v[buf]).of(at, at + length) for x, v in zip(_windows, _window_bytes, strict=True))
                out.append(np.stack([a.view(np.int64), b.view(np.int64), own[of], key[of], pos]))
            a, b, o, q, pos = np.concatenate(out, axis=1)
            deal = np.lexsort((pos, q, o, b, a))
            new = starting(a[deal]) | starting(b[deal])
            late, deal = deal[~new], np.sort(deal[new])
            ranges.append((o[late], q[late], pos[late], pos[late] + length))
            table = np.stack([a, b, o, q, pos, np.full(len(a), me, np.int64)])[:, deal]
            rows += by_bucket(2, (table[0].view(U) % U(buckets)).astype(np.int64), table)
        ranges = [np.concatenate(x) for x in zip(*ranges, strict=True)]
        if len(ranges[0]):
            rows.append((0, me, -1, merged(*ranges).tobytes(), b""))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _noted, strict=True)], schema=_noted) if rows else _noted.empty_table()

    return run


def merged(own: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (id, key, start, end) with overlapping or touching ranges of one document joined; ranges as long as each other or longer later."""
    order = np.lexsort((start, key, own))
    own, key, start, end = own[order], key[order], start[order], end[order]
    new_doc = starting(own) | starting(key)
    doc = np.cumsum(new_doc) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * span) - doc * span  # the farthest end so far in the document
    new = new_doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([own[begin], key[begin], start[begin], np.maximum.reduceat(end, begin)])


def told_blocks(block: np.ndarray, own: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """One row of merged ranges per block."""
    order = np.argsort(block, kind="stable")
    rows = [(to, merged(*(x[order[i:j]] for x in (own, key, start, end))).tobytes()) for to, i, j in stretches(block[order])]
    return pa.table({"block": pa.array([x[0] for x in rows], pa.int64()), "longs": pa.array([x[1] for x in rows], pa.binary())})


def first_windows(table: pa.Table, length: int) -> pa.Table:
    """Of windows of hot keys, equal by both hashes: all but the first, to their blocks."""
    a, b, own, key, pos, block = longs(table, "longs", 6)
    order = np.lexsort((pos, key, own, b, a))
    late = order[~(starting(a[order]) | starting(b[order]))]
    return told_blocks(block[late], own[late], key[late], pos[late], pos[late] + length)


def same_rows(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes, the rank of its content."""
    return np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").reshape(-1), return_inverse=True)[1].reshape(-1)


def repeated(length: int, h: np.ndarray, anchor: np.ndarray, first: np.ndarray, size: np.ndarray, own: np.ndarray, key: np.ndarray, base: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, last window) of what repeats an earlier window, for runs whose bytes start at ``base`` of ``buf``."""
    # Pieces: windows at -r of the anchor with r // WIDTH equal; the core is what they all cover.
    low, high = (anchor - (size - length)) // WIDTH, anchor // WIDTH
    run_ = np.repeat(np.arange(len(h)), high - low + 1)
    j = np.arange(len(run_)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[run_]
    core = anchor[run_] - WIDTH * j
    p, q = np.maximum(core - WIDTH + 1, 0), np.minimum(core, size[run_] - length)
    at = base[run_]
    across = np.arange(length - WIDTH + 1)
    cores = same_rows(buf[(at + core)[:, None] + across])
    side = np.arange(WIDTH - 1)
    left_at, right_at = core[:, None] - (WIDTH - 1) + side, core[:, None] + length - WIDTH + 1 + side
    byte = lambda where, ok: np.where(ok, buf[np.where(ok, at[:, None] + where, 0)].astype(np.int16) + 2, 0)
    left, right = byte(left_at, left_at >= p[:, None]), byte(right_at, right_at < q[:, None] + length)
    # A name is an anchor, a place and a core; equal pieces have equal names and sides.
    h = h[run_]
    name_of = np.lexsort((cores, j, h))
    name = np.empty(len(h), np.int64)
    name[name_of] = np.cumsum(starting(h[name_of]) | starting(j[name_of]) | starting(cores[name_of])) - 1
    sides = same_rows(np.concatenate([left, right], axis=1).view(np.uint8))
    order = np.lexsort((first[run_] + p, key[run_], own[run_], sides, name))
    rank = np.empty(len(order), np.int64)  # by document and place
    rank[np.lexsort((first[run_] + p, key[run_], own[run_]))] = np.arange(len(order))
    new_name = starting(name[order])
    new = new_name | starting(sides[order])
    out = [(order[~new], p[order[~new]], q[order[~new]])]
    group = np.cumsum(new_name) - 1
    some = new & (np.bincount(group[new], minlength=group[-1] + 1)[group] > 1)
    piece, symbol = order[some], group[some]
    if len(piece):
        grid = np.concatenate([left[piece], symbol[:, None] + 258, right[piece], np.ones((len(piece), 1), np.int64)], axis=1)
        text = grid[grid > 0]
        length_of = (grid > 0).sum(1)
        start = np.cumsum(length_of) - length_of
        windows = q[piece] - p[piece] + 1
        of = np.repeat(np.arange(len(piece)), windows)
        step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        which = np.full(len(text), -1)
        which[start[of] + step] = np.arange(len(of))
        sa = which[suffix_array(text)]
        sa = sa[sa >= 0]  # the suffixes with which windows start, ascending
        head = text[(start[of] + step)[sa][:, None] + np.arange(WIDTH)]
        fresh = np.ones(len(sa), bool)
        fresh[1:] = (head[1:] != head[:-1]).any(1)
        # Of the windows that are one string, all but that of the first document and place.
        string = np.cumsum(fresh) - 1
        later = rank[piece[of[sa]]] * WIDTH * 2 + step[sa]
        repeat = sa[later > np.minimum.reduceat(later, np.flatnonzero(fresh))[string]]
        w = p[piece[of[repeat]]] + step[repeat]
        out.append((piece[of[repeat]], w, w))
    who, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return run_[who], a, b


def sort_suffixes(length: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 2:
            return first_windows(table, length)
        h, anchor, first, size, own, key, block = longs(table, "longs", 7)
        buf = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        base = np.cumsum(size) - size
        order, out = np.argsort(h, kind="stable"), []
        # Keys are independent of each other: batches of whole keys, of at most BATCH_RUNS + HOT runs.
        begin = np.flatnonzero(starting(h[order]))
        cuts = begin[starting(begin // BATCH_RUNS)].tolist() + [len(h)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[i:j]
            r, a, b = repeated(length, *(x[some] for x in (h, anchor, first, size, own, key, base)), buf)
            out.append((some[r], a, b))
        r, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return told_blocks(block[r], own[r], key[r], first[r] + a, first[r] + b + length)

    return run


def left_schema(docs: pa.Table) -> pa.Schema:
    return pa.schema([docs.schema.field("doc_id"), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), docs.schema.field("rest")])


def remove(docs: pa.Table, noted: pa.Table, whole: bool = False) -> pa.Table:
    table = longs(noted, "longs", 4)
    if table.shape[1]:
        table = merged(*table)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for own, key, start, end in table.T.tolist():
        spans.setdefault((own, key), []).append((start, end))
    out = [left_schema(docs).empty_table()]
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch):
            raw, sizes, found, kept = text_column(part).cast(pa.binary()).to_pylist(), [], [], []
            for text, own, key in zip(raw, ids(part).tolist(), part.column("key").to_pylist(), strict=True):
                off = spans.get((own, key), [])
                sizes.append(len(text))
                found.append([{"start": a, "end": b} for a, b in off])
                at, rest = 0, []
                for a, b in off:
                    rest.append(text[at:a])
                    at = b
                left = b"".join([*rest, text[at:]]) if off else text
                kept.append(left.decode(errors="ignore").encode() if whole and off else left)
            schema = left_schema(docs)
            out.append(pa.table([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, schema.field("spans").type), pa.array(kept, pa.binary()), part.column("rest")], schema=schema))
    return pa.concat_tables(out)


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges), kept (the remaining bytes), rest, one row per row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also starts earlier: in a smaller document, or earlier in the same one.
    ``carry``: columns of ``docs`` that come back as the fields of ``rest``. ``whole``: bytes left of characters that were cut are left out.
    """
    total = text_bytes(docs, text_col)
    blocks, buckets = max(8, -(-total // block_bytes)), max(16, -(-total // bucket_bytes))
    dealt = narrowed(docs, doc_id=id_col, text=text_col, rest=F.struct(*carry) if carry else F.lit(True)).withColumn("key", F.xxhash64("text")).withColumn("block", F.pmod(F.when(F.col("doc_id").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)))
    dealt = dealt.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)), "block")
    kind = dict(dealt.dtypes)
    sent = dealt.groupBy("block").applyInArrow(lean(send(length, k, buckets)), "kind int, bucket long, block long, runs binary, more binary")
    told = sent.groupBy("kind", "bucket").applyInArrow(lean(compare), TOLD)
    noted = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lean(note(length, k, buckets)), NOTED), "noted")
    found = noted.where("kind > 0").groupBy("kind", "bucket").applyInArrow(lean(sort_suffixes(length)), "block long, longs binary")
    noted = noted.where("kind = 0").select("block", "longs").unionByName(found)
    return dealt.groupBy("block").cogroup(noted.groupBy("block")).applyInArrow(lean(lambda a, b: remove(a, b, whole)), f"doc_id {kind['doc_id']}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, rest {kind['rest']}")
