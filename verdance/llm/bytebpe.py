"""Byte-level BPE as a monoid tree reduction.

A text is halved recursively.  Leaves are encoded on their own; two neighbours
are joined by encoding a window around their border again, which grows until
what lies outside it provably cannot change:

* Pre-tokens (matches of the split pattern).  A match depends on the text from
  its start to one character past its end (three for a contraction), so the left
  side keeps every match that looked at its own text only.  From there matches
  are drawn again until one starts where a match of the right side starts; from
  that place on both see the same text.
* Tokens inside one long pre-token.  A token sequence is the encoding of its
  bytes exactly if each adjacent pair is the encoding of the pair's bytes, so
  the window may stop once the pairs at its two rims hold.

Decoding looks up leaves of ids and concatenates up the same kind of tree.

Defined results: a null text counts as empty and has no tokens; lone surrogates
(which Spark's strings can't hold) become question marks; repeated rows and null ids are returned as they come; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Characters of a text's leaf; bytes of a pre-token's leaf; ids of a decoding leaf.
LEAF_CHARS = 512
LEAF_BYTES = 64
LEAF_IDS = 256


class TreeBPE:
    """Encoder and decoder of one rank vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.piece_leaf = self.library._core_bpe.encode_single_piece
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.holds = functools.lru_cache(1 << 16)(self._holds)

    # tokens inside one pre-token

    def _holds(self, a: int, b: int) -> bool:
        return self.piece_leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours that lie in one pre-token."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        size = 2
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            middle = self.piece_leaf(window)
            if (not i or self.holds(left[i - 1], middle[0])) and (j == len(right) or self.holds(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            size *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: a vocabulary entry as it is, else its halves joined."""
        if len(piece) <= LEAF_BYTES:
            return self.piece_leaf(piece)
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._halves(piece)

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.piece_leaf(piece)
        half = len(piece) // 2
        return self.join_tokens(self._halves(piece[:half]), self._halves(piece[half:]))

    # pre-tokens of a text

    def _leaf(self, text: str) -> tuple[list[str], list[int]]:
        words = self.pattern.findall(text)
        return words, self.library.encode_ordinary(text)

    def _count(self, words: list[str]) -> int:
        return sum(len(self.encode_piece(w.encode())) for w in words)

    def join_texts(self, text: str, start: int, border: int, left: tuple, right: tuple) -> tuple[list[str], list[int]]:
        """The (pre-tokens, ids) of ``text[start:]`` up to the right side's end, from those of its two sides."""
        lw, li = left
        rw, ri = right
        # The left side's last matches that may have looked past its end.
        keep, at = len(lw), border
        while keep:
            word = len(lw[keep - 1])
            if at < border and at - word + 3 <= border:
                break
            at -= word
            keep -= 1
        # Draw matches again until they meet a start on the right side.
        middle, place, skip, meets = [], at, 0, border
        end = border + sum(map(len, rw))
        while place != meets:
            m = self.pattern.match(text, place, end)
            middle.append(m.group())
            place = m.end()
            while meets < place and skip < len(rw):
                meets += len(rw[skip])
                skip += 1
        drop_l, drop_r = self._count(lw[keep:]), self._count(rw[:skip])
        ids = [i for w in middle for i in self.encode_piece(w.encode())]
        return lw[:keep] + middle + rw[skip:], li[: len(li) - drop_l] + ids + ri[drop_r:]

    def _tree(self, text: str, start: int, end: int) -> tuple[list[str], list[int]]:
        if end - start <= LEAF_CHARS:
            return self._leaf(text[start:end])
        half = (start + end) // 2
        return self.join_texts(text, start, half, self._tree(text, start, half), self._tree(text, half, end))

    def encode(self, text: str | None) -> list[int]:
        text = (text or "").encode("utf-8", "replace").decode() if text and not text.isascii() else text or ""
        return self._tree(text, 0, len(text))[1]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + LEAF_IDS])) for i in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@functools.lru_cache(maxsize=2)
def tree_bpe(path: str, pattern: str) -> TreeBPE:
    return TreeBPE(path, pattern)


def _mapped(source: DataFrame, fields: list[T.StructField], row) -> DataFrame:
    """The first column of ``source`` as it is, and ``row(value)`` of its second."""
    name = source.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = row()
        types = T.StructType(fields)
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(types)]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                made = [make(x.as_py()) for x in part.column(1)]
                columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [name, *types.names])

    return map_arrow(source, run, T.StructType([source.schema.fields[0], *fields]))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the token ids of each whole text."""
    def row():
        bpe = tree_bpe(vocabulary, pattern)
        return lambda text: (bpe.encode(text),)

    return _mapped(docs.select(id_col, F.col(text_col).alias("__text")), [T.StructField("ids", T.ArrayType(T.IntegerType()))], row)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``, the bytes of each list of ids (null: empty)."""
    def row():
        bpe = tree_bpe(vocabulary, pattern)
        return lambda ids: (bpe.decode(ids or []),)

    return _mapped(encoded.select(id_col, F.col(ids_col).alias("__ids")), [T.StructField("decoded", T.BinaryType())], row)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``id_col, n_tokens, ids_sha256, decoded_sha256``."""
    def row():
        bpe = tree_bpe(vocabulary, pattern)

        def digest(text):
            ids = bpe.encode(text)
            return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return digest

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs.select(id_col, F.col(text_col).alias("__text")), fields, row)
