"""Content-defined anchors: which k-byte string stands for each fixed-length window of bytes.

The anchor of a window is the leftmost of its k-byte strings with the smallest
hash, so equal windows have equal anchors at equal places. Consecutive windows
with one anchor form a run; about ``2 / (length - k + 2)`` runs start per byte.
"""

from __future__ import annotations

import numpy as np

from tickloom.llm.arrays import MULTIPLIERS, Rolling, byte_values

_bytes = byte_values(3)
_rolling = Rolling(MULTIPLIERS[0])


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor, key, content) of each run of windows that lie in one row.

    ``first`` and ``last`` are places of windows in ``buf``, ``anchor`` that of the k-byte
    string, ``key`` its hash and ``content`` the hash of all bytes under the run's windows.
    """
    w, none = length - k + 1, np.empty(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = _rolling.load(_bytes[buf])
    at = np.arange(len(buf) - k + 1)
    h = roll.of(at, at + k)
    m = sliding_minimum(h, w)
    new = np.zeros(len(m), bool)
    new[0] = True
    new[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
    new[starts[starts < len(m)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    row = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(last, ends[row] - length)
    some = last >= first
    row, first, last = row[some], first[some], last[some]
    anchor = last.copy()
    rest = np.flatnonzero(h[last] != m[first])
    for i in range(0, len(rest), 1 << 16):
        f = first[rest[i : i + (1 << 16)]]
        anchor[rest[i : i + (1 << 16)]] = f + (h[f[:, None] + np.arange(w)] == m[f][:, None]).argmax(1)
    # A tie may stand before the end of a run that its row's end has cut.
    return row, first, last, anchor, h[anchor], roll.of(first, last + length)
