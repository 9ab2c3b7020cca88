"""Token counts: lengths of byte-level BPE encodings, by batches in Arrow functions.

Only lengths leave Python. Texts are handled in slices cut by bytes, not rows, and long texts
are split where the pre-tokenizer always splits (before a space that stands
between two non-space characters), so that no piece is longer than
``PIECE_CHARS`` unless it holds no such place. The encoder's merges never cross
pre-tokens, so the library encodes the distinct pre-tokens of a slice that are not known yet, in batches of about
``BATCH_BYTES``; a text's count is the sum over its
pre-tokens. Lengths are remembered for later slices, until the table holds ``MEMO_BYTES`` of strings.

Strings of special tokens inside texts are parted off as the library does by
default, and count one each. Texts with characters on which Unicode versions
differ are given to the library as whole pieces, in the same batches.

Nulls count as empty texts (0 tokens); empty texts have 0 tokens; repeated rows
are counted each; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import slices, text_column
from tickloom.llm.tables import lean, narrowed

PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 18
MEMO_BYTES = 16 << 20
#: Fixed value: the pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which all Unicode versions of the last decade agree; others go to the library.
OTHER = re.compile("[^\x00-ͯ‐-⁞]")
SAFE_CUT = re.compile(r"(?<=[^\s])(?= [^\s])")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut only at places where the pre-tokenizer always cuts."""
    at = 0
    while len(text) - at > most:
        cut = SAFE_CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Lengths(dict):
    """Pre-token to its number of tokens."""

    def __init__(self, tokenizer_file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("lengths per pre-token hold for byte-level BPE without a normalizer only")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)

    def batches(self, strings: list[str]) -> Iterator[int]:
        """The library's number of tokens of each string, encoded in batches of about BATCH_BYTES."""
        some, size = [], 0
        for i, x in enumerate(strings):
            some.append(x)
            size += len(x.encode())
            if size >= BATCH_BYTES or i + 1 == len(strings):
                yield from (len(e.ids) for e in self.tokenizer.encode_batch(some, add_special_tokens=False))
                some, size = [], 0

    def learn(self, tokens: set[str]) -> None:
        new = sorted(tokens.difference(self))
        self.update(zip(new, self.batches(new), strict=True))
        self.held += sum(map(len, new)) + 100 * len(new)

    def counts(self, texts: list[str]) -> list[int]:
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        out, found, whole, whole_of = [], [], [], []
        for i, text in enumerate(texts):
            parts = [text] if self.special is None or self.special.search(text) is None else self.special.split(text)
            out.append(len(parts) - 1)
            tokens = []
            for p in parts:
                if OTHER.search(p):
                    whole += pieces(p)
                    whole_of += [i] * (len(whole) - len(whole_of))
                else:
                    for x in pieces(p):
                        tokens += self.pattern.findall(x)
            found.append(tokens)
        self.learn(set().union(*found))
        for i, tokens in enumerate(found):
            out[i] += sum(map(self.__getitem__, tokens))
        for i, n in zip(whole_of, self.batches(whole), strict=True):
            out[i] += n
        return out


_lengths: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths.get(tokenizer_file) or _lengths.setdefault(tokenizer_file, Lengths(tokenizer_file))
        for batch in batches:
            for part in slices(batch):
                n = pa.array(lengths.counts(text_column(part).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(lean(count), schema).withColumn("over_limit", F.col("n_tokens") > limit)
