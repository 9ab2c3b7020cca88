"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is exactly one token with which the encoding of
that prefix ends. An automaton over the vocabulary gives all tokens that are
suffixes of a prefix; of these, the one is stored whose pair with the last
token of the shorter prefix is compatible, i.e. merging the two tokens' joined
strings gives these two tokens again. Following the stored tokens back from the
end of the word gives the ids. The cost is linear in the word's length times
the number of matching suffixes; no merge loop runs.

Compatibility needs only the tokens' merge trees. The last constituents of the
left token and the first ones of the right token exist over intervals of merge
ranks; the pair is incompatible if a merge of two that exist at the same time
would fire before either is merged inside its own token.

The word's end is a character of its own in the strings (``</w>`` becomes one
letter glued to the last byte), so that tokens with the suffix match at the
end only.

Words are remembered per worker, in a table that is cleared at ``MEMO``
entries. Nulls encode as empty texts: no ids, decoded text empty, both hashes
those of the empty string. Repeated rows are encoded each; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.arrays import slices, text_column
from tickloom.llm.tables import lean, narrowed

MEMO = 300_000
#: Characters on which Unicode versions and lower-casing agree; texts with others are normalised and split by the library.
OTHER = re.compile("[^\x00-ͯ‐-⁞]")
END = "￿"
NEVER = 1 << 30


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """The vocabulary and merges of a tokenizers file with a BPE model."""

    def __init__(self, tokenizer_file: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        if spec["decoder"] is not None or not self.suffix or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE model with an end-of-word suffix and no decoder is expected")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        self.names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (r, vocab[a], vocab[b]) for r, (a, b) in reversed([*enumerate(merges)])}
        # Of each token, outermost first: (constituent, rank at which it is merged into the next outer one).
        self.rights = {t: self.spine(t, 2) for t in vocab.values()}
        self.lefts = {t: self.spine(t, 1) for t in vocab.values()}
        automaton = ahocorasick.Automaton()
        for name, t in vocab.items():
            if (m := self.made.get(t)) and not self.compatible(m[1], m[2], m[0]):
                continue  # no merge order gives it, so no encoding has it
            s = self.glued(name)
            automaton.add_word(s, (len(s), t))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self)

    def glued(self, name: str) -> str:
        return name.removesuffix(self.suffix) + END if name.endswith(self.suffix) else name

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        out = [(token, NEVER)]
        while m := self.made.get(token):
            token = m[side]
            out.append((token, m[0]))
        return out

    def compatible(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether no merge across the boundary fires. Equal ranks fire from left to right.

        ``before``: only merges of lower rank count, which tests a token's own last merge.
        """
        rank = self.rank
        for a, gone_a in self.rights[left]:
            for b, gone_b in self.lefts[right]:
                r = rank.get((a, b))
                if r is not None and r < before and r < gone_a and r <= gone_b:
                    return False
        return True

    def word(self, glued: str) -> list[int]:
        """Ids of one pre-token, given with letters for bytes and the end letter."""
        pairs, n = self.pairs, len(glued)
        last, back = [None] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for end, (size, token) in self.matches(glued):
            end += 1
            # The end letter is no place of its own: nothing ends just before it.
            if last[end] is not None or end == n - 1:
                continue
            before = last[end - size]
            if before is None:
                continue
            if before >= 0:
                ok = pairs.get((before, token))
                if ok is None:
                    if len(pairs) > 4 * MEMO:
                        pairs.clear()
                    ok = pairs[before, token] = self.compatible(before, token)
                if not ok:
                    continue
            last[end], back[end] = token, end - size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def entry(self, word: str) -> tuple[int, str, str]:
        ids = self.word("".join([self.letters[b] for b in word.encode()]) + END)
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without special strings."""
        if OTHER.search(text):
            whole = self.tokenizer.normalizer.normalize_str(text)
            return [whole[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.lower())

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """Of each pre-token and each special string: number of ids, ids, tokens."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        found, at = [], 0
        for m in [*self.cut.finditer(text)] if self.cut else []:
            found += map(self.memo.__getitem__, self.words(text[at : m.start()]))
            found.append((1, str(self.special[m[0]]), m[0]))
            at = m.end()
        found += map(self.memo.__getitem__, self.words(text[at:] if at else text))
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces, as the library decodes where a file names no decoder."""
        return " ".join([self.names[i] for i in ids])


class Memo(dict):
    def __init__(self, of: Codec) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> tuple[int, str, str]:
        self[word] = out = self.of.entry(word)
        return out


_codecs: dict[str, Codec] = {}


def codec(tokenizer_file: str) -> Codec:
    return _codecs.get(tokenizer_file) or _codecs.setdefault(tokenizer_file, Codec(tokenizer_file))


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the general operator, for tables that keep the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([c.encode(t) for t in text_column(part).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, text of the tokens, from the output of :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            texts = pa.array([c.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    rows = narrowed(encoded, doc_id="doc_id", ids="ids")
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one encoding and decoding of every text, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            for part in slices(batch):
                n, ids, texts = [], [], []
                for text in text_column(part).to_pylist():
                    number, numbers, tokens = zip(*found, strict=True) if (found := c.entries(text)) else ((), (), ())
                    n.append(sum(number))
                    ids.append(hashlib.sha256(" ".join(numbers).encode()).hexdigest())
                    texts.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_decode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            for part in slices(batch):
                ids = [c.encode(t) for t in text_column(part).to_pylist()]
                texts = [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "decoded_sha256"])

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, decoded_sha256 string")
