"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, all byte n-grams of its texts that more than
chance repeats.  They fill one Bloom filter per language, sized to the largest
language and stored bit-sliced: slot i holds one bit for each language, so a
lookup ands a few slots and returns every language whose filter has the n-gram.  A text is looked up as a whole in numpy;
the masks' population counts give hits per language, corrected for the filter's
false positives, and the language with the greatest corrected share wins.

Training reads a bounded, documented sample of labelled rows; everything else
covers all rows and whole texts.

Defined results: a null text or one without a letter gets ``und`` with score 0,
as does every text if nothing was learned; ties take the language with
more training rows, then the one that sorts first; repeated rows and null ids are returned as they come; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, least_hash, map_arrow, text_column

UNDETERMINED = "und"
#: Labelled rows that training uses at most, those of least id hash.
TRAIN_ROWS = 12000
#: Bytes of an n-gram; words are joined by one space, so n-grams see word rims.
GRAM = 5
#: Documents of a language that must hold an n-gram for it to be learned: what a single text says is as likely noise.
LEAST_DOCS = 3
#: A filter has so many slots for each n-gram of the language with most of them.
SLOTS_PER_GRAM = 24
HASHES = 2

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def grams(text: str | None) -> np.ndarray:
    """Codes of all byte n-grams of the lower-cased letters of a text, words apart by one space."""
    raw = _OTHER.sub(" ", (text or "").lower()).strip()
    b = np.frombuffer(f"  {raw}  ".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    n = b.size - GRAM + 1
    code = np.zeros(n, np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | b[i : i + n]
    return code


def slots(codes: np.ndarray, log2: int, hashes: int) -> list[np.ndarray]:
    """A filter's slots of n-gram codes, one array per hash."""
    down = np.uint64(64 - log2)
    return [(((codes + np.uint64(i)) * _ODD ^ (codes >> np.uint64(17))) * _MORE[i] >> down).astype(np.int64) for i in range(hashes)]


@dataclass
class Filters:
    """Bit-sliced filters: bit j of ``planes[p][slot]`` belongs to language ``64 p + j``; words are as narrow as the languages allow."""

    langs: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray
    log2: int
    hashes: int

    def lookup(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each plane, the mask of languages that may hold each n-gram."""
        at = slots(codes, self.log2, self.hashes)
        out = []
        for plane in self.planes:
            mask = plane[at[0]]
            for a in at[1:]:
                mask = mask & plane[a]
            out.append(mask)
        return out

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """Each language's share of the n-grams, less what false positives would give."""
        hits = []
        for masks, lo in zip(self.lookup(codes), range(0, len(self.langs), 64)):
            width = min(64, len(self.langs) - lo)
            if width <= 8:  # all masks fit a small table of counts
                seen = np.bincount(masks.astype(np.int64), minlength=1 << width)
                hits += [int(seen[(np.arange(seen.size) >> j & 1) == 1].sum()) for j in range(width)]
            else:
                hits += [int(np.count_nonzero(masks >> masks.dtype.type(j) & masks.dtype.type(1))) for j in range(width)]
        seen = np.array(hits, float) / max(1, codes.size)
        return np.clip((seen - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """The language, its part of all corrected shares, its own share and the n-grams of a text."""
        if not self.langs or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, 0
        codes = grams(text)
        got = self.shares(codes)
        best = int(np.argmax(got))
        total = float(got.sum())
        return self.langs[best], float(got[best]) / total if total > 0 else 0.0, float(got[best]), codes.size


def assemble(grams_of: list[tuple[str, np.ndarray]], log2: int | None = None, hashes: int = HASHES) -> Filters:
    """Filters of the given languages' n-gram codes; on ties the earlier language wins."""
    if log2 is None:
        log2 = max(10, math.ceil(math.log2(SLOTS_PER_GRAM * max([1, *(len(codes) for _, codes in grams_of)]))))
    widths = [min(64, len(grams_of) - lo) for lo in range(0, len(grams_of), 64)]
    planes = [np.zeros(1 << log2, next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if w <= 8 * t().itemsize)) for w in widths]
    false_rate = np.zeros(len(grams_of))
    for j, (_, codes) in enumerate(grams_of):
        plane = planes[j // 64]
        bit = plane.dtype.type(1 << (j % 64))
        for at in slots(codes.astype(np.uint64), log2, hashes):
            plane[at] |= bit
        false_rate[j] = (np.count_nonzero(plane & bit) / plane.size) ** hashes
    return Filters([lang for lang, _ in grams_of], planes, false_rate, log2, hashes)


def enough(docs: int, least: int) -> int:
    """Documents that must hold an n-gram, of ``docs`` of its language."""
    return min(least, max(1, docs // 2))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS,
    least: int = LEAST_DOCS, log2: int | None = None, hashes: int = HASHES,
) -> Filters:
    """Filters learned from at most ``rows`` labelled rows that are not held out.

    The sample is chosen first, from narrow columns, and its texts are fetched by
    a join with that bounded list.  N-grams are counted where the texts are; the
    driver gets the learned codes, which the bounded sample bounds.
    """
    able = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    chosen = least_hash(able.select(F.col(id_col).alias("__id")), "__id", rows).distinct()
    source = able.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                found = [np.unique(grams(t.as_py())) for t, x in zip(batch.column(1), langs) if x == lang]
                codes, seen = np.unique(np.concatenate(found), return_counts=True)
                codes, seen = np.append(codes.view(np.int64), -1), np.append(seen, len(found))  # -1: documents
                yield pa.RecordBatch.from_arrays([pa.array([lang] * codes.size), pa.array(codes), pa.array(seen.astype(np.int64))], ["lang", "code", "n"])

    counts = cut(map_arrow(source, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "langid-grams")
    sizes = counts.where("code = -1").select("lang", F.col("n").alias("docs"))
    wanted = F.least(F.lit(least), F.greatest(F.lit(1), F.floor(F.col("docs") / 2)))  # as enough()
    learned = counts.where("code >= 0").join(F.broadcast(sizes), "lang").where(F.col("n") >= wanted).select("lang", "code").toArrow()
    docs_of = {r.lang: r.docs for r in sizes.collect()}
    names, codes = learned.column("lang").to_numpy(), learned.column("code").to_numpy()
    order = sorted(docs_of, key=lambda x: (-docs_of[x], x))
    return assemble([(lang, codes[names == lang]) for lang in order], log2, hashes)


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (0 to 1), ``share`` and ``grams`` of each whole text.

    ``share`` is the corrected share of the text's n-grams that the language knows.
    """
    names = list(keep)
    text, text_at = text_column(names, text_col)
    source = docs.select(*names, *text)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("grams", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(text_at)]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], [*names, *(f.name for f in added)])

    return map_arrow(source, run, T.StructType([*source.schema.fields[: len(names)], *added]))
