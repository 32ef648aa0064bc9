"""Chroma fingerprints of audio columns and their alignment.

A recording is cut into overlapping frames; each frame's spectrum is folded into
twelve pitch classes, smoothed over time and normalised.  Over the image of
frames by pitch classes, sums of rectangles come from an integral image; sixteen
filters compare rectangles, each quantised to two bits in Gray code, which pack
into one 32-bit integer for each place.

Recordings with equal fingerprints form a class.  Between classes, equal integers
vote for an offset; the offset with most votes is aligned and the share of
differing bits decides.  A sustained sound repeats its integer, so places go by
runs: two runs of one integer vote for a span of offsets at once.  An integer or
a class that very many rows hold is split over tasks.

Defined results: a null, empty, undecodable or too short recording, or a silent
one, has a fingerprint without integers, is a class of its own and matches
nothing; silent places are null and are neither voted on nor compared; ties of
offsets take the smaller one; repeated rows are members each; a null id is a
member but names no class unless no other id is in it; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_join, map_arrow

#: An integer or a class that more than one in HOT_SHARE of all rows hold is split: HOT_SHARE of them at most, over SALTS tasks.
HOT_SHARE, SALTS = 1000, 64
#: Seconds of a frame and between frames; range of pitches in Hz.
FRAME_S, HOP_S = 0.256, 0.064
LOW_HZ, HIGH_HZ = 55.0, 1760.0
#: Frames that a filter sees at most, and the mean amplitude below which a frame is silent.
WIDTH = 12
SILENCE = 1e-3
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
# Fixed values: (kind, first pitch class, pitch classes, frames) of the filters.
FILTERS = (
    ("pitch halves", 0, 6, 4), ("pitch halves", 6, 6, 4), ("pitch halves", 3, 6, 8), ("pitch halves", 0, 12, 8),
    ("time halves", 0, 4, 8), ("time halves", 4, 4, 8), ("time halves", 8, 4, 8), ("time halves", 0, 12, 4),
    ("checks", 0, 6, 8), ("checks", 6, 6, 8), ("checks", 3, 6, 12), ("checks", 0, 12, 12),
    ("time thirds", 0, 6, 12), ("time thirds", 6, 6, 12), ("pitch thirds", 0, 6, 6), ("pitch thirds", 6, 6, 6),
)
_LEVEL = 0.35
_GRAY = np.array([0, 1, 3, 2], np.uint32)

VOTES = 3
OVERLAP = 12
ERROR_RATE = 0.25


def decode_wav(raw: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] and their rate, of a PCM or float WAV; None if it isn't one."""
    if not raw or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            dtype = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}.get((kind, bits))
            if dtype is None or channels == 0 or rate == 0:
                return None
            step = np.dtype(dtype).itemsize * channels
            x = np.frombuffer(body[: len(body) // step * step], dtype).astype(np.float64).reshape(-1, channels).mean(1)
            x = {"u1": (x - 128) / 128, "<i2": x / 2**15, "<i4": x / 2**31, "<f4": x}[dtype]
            return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), rate
        at += 8 + size + size % 2
    return None


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


@functools.lru_cache(maxsize=8)
def _fold(rate: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    frame, hop = max(16, round(FRAME_S * rate)), max(1, round(HOP_S * rate))
    hz = np.fft.rfftfreq(frame, 1 / rate)
    inside = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    fold = np.zeros((hz.size, 12))
    fold[inside, np.round(12 * np.log2(hz[inside] / 440)).astype(int) % 12] = 1
    return frame, hop, np.hanning(frame), fold


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Normalised pitch-class energies, one row per frame; zeros where it is silent."""
    frame, hop, window, fold = _fold(rate)
    if samples.size < frame:
        return np.zeros((0, 12))
    parts = []
    views = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    for i in range(0, len(views), 512):
        part = views[i : i + 512]
        energy = np.square(np.abs(np.fft.rfft(part * window))) @ fold
        energy[np.abs(part).mean(1) < SILENCE] = 0
        parts.append(energy)
    energy = np.concatenate(parts)
    padded = np.pad(energy, ((2, 2), (0, 0)))
    smooth = sum(w * padded[i : i + len(energy)] for i, w in enumerate(_SMOOTH))
    smooth[energy.sum(1) == 0] = 0
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 0)


def packed(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed integer of each place, and whether the place is silent."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    image = np.pad(frames, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        if kind == "pitch halves":
            a, b = area(0, w, p, p + h // 2), area(0, w, p + h // 2, p + h)
        elif kind == "time halves":
            a, b = area(0, w // 2, p, p + h), area(w // 2, w, p, p + h)
        elif kind == "checks":
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
            b = area(0, w, p, p + h) - a
        elif kind == "time thirds":
            a = area(w // 3, w - w // 3, p, p + h)
            b = (area(0, w, p, p + h) - a) / 2
        else:
            a = area(0, w, p + h // 3, p + h - h // 3)
            b = (area(0, w, p, p + h) - a) / 2
        small = 0.02 * h * w
        value = np.log((small + a) / (small + b))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted([-_LEVEL, 0, _LEVEL], value)]
    quiet = np.pad((frames.sum(1) == 0).astype(int), (1, 0)).cumsum()
    return out, 2 * (quiet[t + WIDTH] - quiet[t]) > WIDTH


def fingerprint(raw: bytes | None) -> list[int | None]:
    """Packed integers of a WAV, null where it is silent; empty if it can't be read or is silent throughout."""
    audio = decode_wav(raw)
    if audio is None:
        return []
    items, quiet = packed(chroma(*audio))
    return [] if quiet.all() else [None if q else int(i) for i, q in zip(items.tolist(), quiet.tolist())]


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """``id`` and ``items`` of each recording."""
    source = media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])

    return map_arrow(source, run, T.StructType([source.schema.fields[0], T.StructField("items", T.ArrayType(T.LongType()))]))


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, class_id)`` and classes ``(class_id, items)`` of equal fingerprints ``(id, items)``."""
    full = prints.where(F.size("items") > 0).withColumn("key", F.sha2(F.array_join(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ","), 256))
    found = cut(full.groupBy("key").agg(F.min("id").alias("class_id"), F.first("items").alias("items"), F.count("*").alias("n")), "audio-classes")
    rows = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lone = prints.where(F.size("items") == 0).select("id", F.col("id").alias("class_id"))
    named = hot_join(full.select("key", "id"), found.select("key", "class_id", "n"), "key", F.col("n") * HOT_SHARE > rows)
    return named.select("id", "class_id").unionByName(lone), found.select("class_id", "items")


def runs(prints: DataFrame, name: str, start: str, size: str) -> DataFrame:
    """``name, item, start, size``: the maximal stretches of one integer in each class's ``items``, silent places left out."""
    before = lambda i: F.when(i > 0, F.element_at("items", i))  # noqa: E731  places count from 1 there
    begins = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: ~F.element_at("items", i + 1).eqNullSafe(before(i)) | (i == 0))
    ends = F.concat(F.slice("b", 2, F.size("b")), F.array(F.size("items")))
    marked = prints.where(F.size("items") > 0).select(F.col("class_id").alias(name), "items", begins.alias("b")).select(name, "items", "b", ends.alias("e"))
    cells = F.zip_with("b", "e", lambda b, e: F.struct(F.element_at("items", b + 1).alias("item"), b.alias(start), (e - b).alias(size)))
    return marked.select(name, F.explode(cells).alias("x")).where("x.item is not null").select(name, "x.*")


def voted(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``query_class, class_id, offset, votes``: equal integers by offset between two sides that have ``class_id`` and ``items``."""
    theirs = cut(runs(found, "class_id", "b", "m"), "audio-runs")
    total = theirs.count()
    hot = F.broadcast(theirs.groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") * HOT_SHARE > total).select("item", F.lit(SALTS).alias("s")))
    left = runs(asked, "query_class", "a", "n").join(hot, "item", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))).drop("s")
    right = theirs.join(hot, "item", "left").withColumn("salt", F.pmod(F.xxhash64("class_id", "b"), F.coalesce("s", F.lit(1))).cast("int")).drop("s")
    hits = left.join(right, ["item", "salt"]).where("query_class <> class_id")
    # Runs of n and m places from a and b on: an offset is met as often as it has place pairs in them.
    spans = F.sequence(F.col("b") - F.col("a") - F.col("n") + 1, F.col("b") - F.col("a") + F.col("m") - 1)
    offsets = hits.select("query_class", "class_id", "a", "n", "b", "m", F.explode(spans).alias("offset"))
    pairs = F.least(F.col("a") + F.col("n"), F.col("b") + F.col("m") - F.col("offset")) - F.greatest("a", F.col("b") - F.col("offset"))
    return offsets.groupBy("query_class", "class_id", "offset").agg(F.sum(pairs).alias("votes"))


def align(asked: DataFrame, found: DataFrame, votes: int = VOTES, overlap: int = OVERLAP, error_rate: float = ERROR_RATE) -> DataFrame:
    """``query_class, class_id, offset, votes, overlap, error_rate`` of the classes that align with those asked for.

    ``offset`` is the place in the class less that in the query.  Both sides have ``class_id`` and ``items``.
    """
    counted = voted(asked, found)
    best = counted.groupBy("query_class", "class_id").agg(F.max(F.struct("votes", (-F.col("offset")).alias("o"))).alias("x")).where(F.col("x.votes") >= votes)
    best = best.select("query_class", "class_id", (-F.col("x.o")).alias("offset"), "x.votes")
    both = best.join(asked.select(F.col("class_id").alias("query_class"), F.col("items").alias("qa")), "query_class").join(found.select("class_id", F.col("items").alias("qb")), "class_id")
    first = F.greatest(F.lit(0), -F.col("offset"))
    shared = F.least(F.size("qa") - first, F.size("qb") - first - F.col("offset"))
    bits = F.zip_with(F.slice("qa", first + 1, shared), F.slice("qb", first + F.col("offset") + 1, shared), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    both = both.withColumn("bits", F.filter(bits, lambda x: x.isNotNull()))
    both = both.withColumn("overlap", F.size("bits").cast("long")).where(F.col("overlap") >= overlap)
    wrong = F.aggregate("bits", F.lit(0), lambda s, x: s + x) / (32.0 * F.col("overlap"))
    return both.select("query_class", "class_id", F.col("offset").cast("long").alias("offset"), "votes", "overlap", wrong.alias("error_rate")).where(F.col("error_rate") <= error_rate)


def search(media: DataFrame, id_col: str, audio_col: str, every: int = 50, **limits) -> DataFrame:
    """Members of all classes, and the alignments of classes that hold an id which ``every`` divides.

    Rows of kind ``member`` give a recording's class; rows of kind ``match`` link two classes by their names.
    """
    prints = cut(fingerprints(media, id_col, audio_col), "audio-prints")
    members, found = classes(prints)
    members = cut(members, "audio-members")
    asked = members.where(F.col("id") % every == 0).select("class_id").distinct().join(found, "class_id")
    matches = align(asked, found, **limits)
    none = lambda kind: F.lit(None).cast(kind)
    id_kind = members.schema["id"].dataType
    return members.select(
        F.lit("member").alias("kind"), "id", "class_id", none(id_kind).alias("query_class"), none("long").alias("offset"), none("long").alias("votes"), none("long").alias("overlap"), none("double").alias("error_rate")
    ).unionByName(matches.select(F.lit("match").alias("kind"), none(id_kind).alias("id"), "class_id", "query_class", "offset", "votes", "overlap", "error_rate"))


# The test tables hold no recordings, so vectors are played as tunes of two voices.
NOTE_S, RATE = 0.125, 4000


def tune(vector: list | None) -> bytes | None:
    """A WAV that plays a vector: each half of its components is a voice, one note for each component."""
    if not vector or any(x is None for x in vector):
        return None
    x = np.nan_to_num(np.array(vector, float))
    half = (len(x) + 1) // 2
    step = np.clip(np.floor((x * np.sqrt(len(x)) + 3) * 4), 0, 23)
    t = np.arange(round(NOTE_S * RATE)) / RATE
    rise = np.minimum(1, np.minimum(t, t[::-1]) / 0.01)
    voices = [np.concatenate([np.sin(2 * np.pi * low * 2 ** (s / 12) * t) * rise for s in part]) for low, part in ((220.0, step[:half]), (330.0, step[half:])) if part.size]
    out = np.zeros(max(v.size for v in voices))
    for v in voices:
        out[: v.size] += 0.4 * v
    return encode_wav(out, RATE)


def tunes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``audio``: each vector played."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tune(v.as_py()) for v in part.column(1)], pa.binary())], ["id", "audio"])

    return map_arrow(source, run, T.StructType([source.schema.fields[0], T.StructField("audio", T.BinaryType())]))
