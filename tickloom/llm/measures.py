"""Measurements of whole texts, vectorised over all texts of a batch slice.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r. Windows and
lines are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm.arrays import MULTIPLIERS, Rolling, U, byte_values, counts, joined, mix, text_column, word_hashes, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
NAMES = ("n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_same_next", "n_long_words", "n_short_words", "n_marked_words")
_lines = Rolling(MULTIPLIERS[1])
_line_bytes = byte_values(5)


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK = table(SYMBOLS), table(bytes(range(65, 91))), table(b"0123456789"), table(b"!?|<>{}[]=/\\_~^*#$%&@;:")


def repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Which keys occur more than once; ``first``: with the first occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    if first:
        out[order[:-1]] |= same
    return out


def measures(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """NAMES for each row; nulls as empty texts."""
    buf, starts, ends = joined(text_column(part))
    rows = len(starts)
    at = lambda where: counts(where, starts, ends)
    ws, we = words(buf)
    out = {"n_bytes": ends - starts, "n_words": at(ws)}
    total = lambda values, n: np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(n)))])
    size = we - ws
    out["word_chars"] = total(size, out["n_words"]) - at(np.flatnonzero((buf & 0xC0) == 0x80))
    for name, of in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = at(np.flatnonzero(of[buf]))
    of_word = np.repeat(np.arange(rows), out["n_words"])
    out["n_long_words"], out["n_short_words"] = (np.bincount(of_word[x], minlength=rows) for x in (size > 14, size < 4))
    last = buf[we - 1] if len(we) else buf[:0]
    out["n_marked_words"] = np.bincount(of_word[_MARK[last]], minlength=rows)
    # Lines with a word, equal to an earlier line of the same text.
    newline = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate((starts, newline + 1)))
    line_end = np.sort(np.concatenate((newline, ends)))
    of_line = np.searchsorted(starts, line_start, "right") - 1
    held = counts(ws, line_start, line_end) > 0
    salt = mix(np.arange(1, rows + 1, dtype=U))
    keys = _lines.load(_line_bytes[buf]).of(line_start[held], line_end[held]) + salt[of_line[held]]
    out["n_lines"] = np.bincount(of_line[held], minlength=rows)
    out["n_dup_lines"] = np.bincount(of_line[held][repeated(keys, first=False)], minlength=rows)
    # Words in 3-word windows found twice or more in the same text.
    h = word_hashes(buf, ws, we) + salt[of_word]
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = of_word[2:] == of_word[:-2]
        twice = np.zeros(len(inside), bool)
        twice[inside] = repeated(mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])[inside], first=True)
        for k in range(3):
            covered[k : len(h) - 2 + k] |= twice
    out["n_repeat_words"] = np.bincount(of_word[covered], minlength=rows)
    out["n_distinct_words"] = np.bincount(of_word[~repeated(h, first=False)], minlength=rows)
    out["n_same_next"] = np.bincount(of_word[1:][h[1:] == h[:-1]], minlength=rows) if len(h) else np.zeros(rows, int)
    return {k: out[k].astype(np.int64) for k in NAMES}
