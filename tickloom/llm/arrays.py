"""Numpy views of Arrow text: words, their hashes and cuts of batches into bounded slices.

Texts are handled as one byte buffer with a space after each text, so no word
or window can cross texts unnoticed. Work is done in slices of at most
``SLICE_BYTES`` (or one longer text), which bounds the memory of a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Bytes that part words under the pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64
MULTIPLIERS = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))


def inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the one of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F) + U(seed))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = int(base), np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", inverse(self.base))):
                p = np.full(size, b, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        up, down = self.up[:n], self.down[:n]
        if len(self.up) > 4 * SLICE_BYTES:  # keep no tables of one giant text
            self.up, self.down = self.up[:1].copy(), self.down[:1].copy()
        return up, down


class Rolling:
    """Polynomial (Rabin-Karp) hashes of any ranges of a sequence of 64-bit values, modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.powers = Powers(base)

    def load(self, values: np.ndarray) -> Rolling:
        up, self.down = self.powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch, each of ``most`` bytes of text or of a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts with a space after each, starts, ends)."""
    raw = col.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = memoryview(raw.buffers()[2] or b"")
    buf = b" ".join([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] + [b""])
    starts = offsets[:-1] - offsets[0] + np.arange(len(raw))
    return np.frombuffer(buf, np.uint8), starts, starts + np.diff(offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


def words(buf: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that do not part words; the buffer ends with one that does."""
    gap = parts[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        turn = np.concatenate(([0], turn))
    return turn[::2], turn[1::2]


_bytes = (byte_values(1), byte_values(2))
_rolling = (Rolling(MULTIPLIERS[0]), Rolling(MULTIPLIERS[1]))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return _rolling[which].load(_bytes[which][buf]).of(start, end)


def counts(where: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the ascending positions fall into each [start, end)."""
    return np.searchsorted(where, ends) - np.searchsorted(where, starts)
