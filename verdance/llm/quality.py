"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its content (hashed
byte trigrams and repetition of words) and its page metadata (source, language,
length, layout and character classes).  Over a few rounds each labels the rows of
an unlabelled pool that it is sure of, for the other to learn from.  Each view is
then calibrated on labelled rows that neither saw, and a logistic combination of
the two calibrated views scores all documents.

The labelled sample and the pool are bounded by documented parameters
(``LABELLED_ROWS``, ``POOL_ROWS``); the scored table is not, and texts are read
whole.

Defined results: a null text counts as empty, null metadata as a value of its
own; rows without a label, or with a null one, only serve as pool; conflicting
labels of one id take their mean, 0.5 counting as 1; without labels of both
classes every document scores 1 (or the only class); of an id's rows the one of
least hash is learned from; repeated rows and null ids are returned as they come; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hash, map_arrow, text_column, utf8

LABELLED_ROWS = 6000
POOL_ROWS = 6000
ROUNDS = 3
#: Calibrated probability from which a view's label is passed on.
SURE = 0.98
#: Labelled rows kept for calibration: one in HOLD.
HOLD = 4
THRESHOLD = 0.5
#: Rows that are converted at once where a sample is worked on, so that the driver holds little beside it.
ROWS = 1000
#: Gradient steps of a view's first fit, and of each round's, which goes on from the round before.
STEPS, MORE_STEPS = 150, 60

TRIGRAM_SLOTS = 1024
NAME_SLOTS = 32
#: Byte classes of the metadata view.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()/\\=+_-", b"'\"")
_CLASS_OF = np.zeros((256, len(_CLASSES)), np.float32)
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c), _i] = 1


def content_view(raw: bytes) -> np.ndarray:
    """Root frequencies of hashed byte trigrams, then repetition of words."""
    out = np.zeros(TRIGRAM_SLOTS + 3, np.float32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if b.size >= 3:
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(22)
        out[:TRIGRAM_SLOTS] = np.sqrt(np.bincount(slot, minlength=TRIGRAM_SLOTS) / slot.size)
    words = raw.split()
    if words:
        out[TRIGRAM_SLOTS] = sum(map(operator.eq, words, words[1:])) / len(words)
        out[TRIGRAM_SLOTS + 1] = len(set(words)) / len(words)
        out[TRIGRAM_SLOTS + 2] = min(1.0, max(map(len, words)) / 64)
    return out


def metadata_view(raw: bytes, names: tuple) -> np.ndarray:
    """Hashed names (source, language), length, layout and shares of byte classes."""
    hashed = np.zeros(NAME_SLOTS * len(names), np.float32)
    for i, name in enumerate(names):
        hashed[NAME_SLOTS * i + zlib.crc32(repr(name).encode()) % NAME_SLOTS] = 1
    size = len(raw)
    lines = raw.count(b"\n") + 1
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF / max(1, size)
    layout = [np.log1p(size), np.log1p(lines), np.log1p(size / lines), np.log1p(max(map(len, raw.split(b"\n"))))]
    return np.concatenate((hashed, np.array(layout, np.float32), shares, np.sqrt(shares))).astype(np.float32)


@dataclass
class Linear:
    """A logistic classifier of one view with its calibration ``a * logit + b``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        slope = self.scale.astype(float) * self.weights
        raw = [x[i : i + ROWS].astype(float) @ slope for i in range(0, len(x), ROWS)]
        return self.a * (np.concatenate([np.zeros(0), *raw]) - self.mean.astype(float) @ slope + self.bias) + self.b


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150, start: Linear | None = None) -> Linear:
    """Penalised logistic regression by accelerated gradient steps, from ``start`` or from zero; classes weigh alike."""
    z = x.astype(np.float32)  # the one copy, scaled in place
    parts = [z[i : i + ROWS] for i in range(0, len(z), ROWS)]
    mean = (sum(p.sum(0, dtype=float) for p in parts) / len(z)).astype(np.float32)
    z -= mean
    spread = np.sqrt(sum(np.einsum("ij,ij->j", p, p, dtype=float) for p in parts) / len(z))
    scale = (1 / np.maximum(spread, 1e-3)).astype(np.float32)
    z *= scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(10):  # the largest curvature
        v = z.T @ (weight * (z @ v))
        top = float(np.linalg.norm(v))
        v = v / max(top, 1e-12)
    rate = 1 / (0.25 * top + 0.25 + penalty)
    w, bias = np.zeros(z.shape[1], np.float32), 0.0
    if start is not None:
        w = (start.weights * start.scale / scale).astype(np.float32)
        bias = start.bias + float(((mean - start.mean) * start.scale) @ start.weights)
    w0, bias0 = w, bias
    for t in range(steps):
        k = t / (t + 3)
        u, ub = w + k * (w - w0), bias + k * (bias - bias0)
        g = weight * (sigmoid(z @ u + ub) - y).astype(np.float32)
        w0, bias0 = w, bias
        w, bias = (u - rate * (z.T @ g + penalty * u)).astype(np.float32), float(ub - rate * g.sum())
    return Linear(mean, scale, w, bias)


def platt(logits: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of ``columns of logits, 1`` for calibrated probabilities, by damped Newton steps."""
    x = np.column_stack((logits, np.ones(len(y)))).astype(float)
    w = np.zeros(x.shape[1])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - target) + 1e-2 * w)
    return w


@dataclass
class CoTrained:
    """Both views and their combination; ``views`` is empty if there was nothing to learn."""

    views: list[Linear]
    mix: np.ndarray
    constant: float = 1.0
    passed: tuple = ()

    def score(self, xs: list[np.ndarray]) -> np.ndarray:
        if not self.views:
            return np.full(len(xs[0]), self.constant)
        logits = np.column_stack([v.logit(x) for v, x in zip(self.views, xs)])
        return sigmoid(np.column_stack((logits, np.ones(len(logits)))) @ self.mix)


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, sure: float = SURE, hold: int = HOLD) -> CoTrained:
    """Fit both views on labelled rows, letting each teach the other from the pool."""
    y = y.astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return CoTrained([], np.zeros(0), float(y[0]) if len(y) else 1.0)
    kept = np.arange(len(y)) % hold == 0
    if min(y[kept].sum(), (1 - y[kept]).sum(), y[~kept].sum(), (1 - y[~kept]).sum()) < 1:
        kept = np.zeros(len(y), bool)  # too few to set some aside
    check = kept if kept.any() else ~kept
    given = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * 2  # pool rows and labels that view i learns from
    passed, views = [], [None, None]
    for r in range(rounds + 1):
        before, views = views, []
        for x, p, (rows, lab), start in zip(labelled, pool, given, before):
            model = fit(np.concatenate((x[~kept], p[rows])), np.concatenate((y[~kept], lab)), steps=STEPS if start is None else MORE_STEPS, start=start)
            model.a, model.b = platt(model.logit(x[check]), y[check])
            views.append(model)
        if r == rounds or not len(pool[0]):
            break
        offered = []
        for model, p in zip(views, pool):
            prob = sigmoid(model.logit(p))
            rows = np.flatnonzero((prob >= sure) | (prob <= 1 - sure))
            offered.append((rows, (prob[rows] >= 0.5).astype(np.float32)))
        given = offered[::-1]
        passed.append(tuple(len(o[0]) for o in offered))
    logits = np.column_stack([v.logit(x[check]) for v, x in zip(views, labelled)])
    return CoTrained(views, platt(logits, y[check]), passed=tuple(passed))


def _views(batch: pa.RecordBatch, text_at: int, first: int) -> list[np.ndarray]:
    """Both views of a batch with the text in column ``text_at`` and the names from column ``first`` on."""
    content, meta = [], []
    names = [batch.column(i).to_pylist() for i in range(first, batch.num_columns)]
    for text, *row in zip(batch.column(text_at), *names):
        raw = utf8(text.as_py())
        content.append(content_view(raw))
        meta.append(metadata_view(raw, tuple(row)))
    return [np.array(content), np.array(meta)]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_cols: tuple[str, ...] = ("source", "lang"),
    label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS,
) -> CoTrained:
    """A model from bounded samples of labelled rows and of the pool, both of least id hash."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("__y"))
    own = docs.where(F.col(id_col).isNotNull())
    mine = known.join(own.select(F.col(id_col).alias("__id")), "__id", "left_semi")
    pool = own.select(F.col(id_col).alias("__id")).join(known.select("__id"), "__id", "left_anti")
    chosen = least_hash(mine, "__id", labelled_rows).unionByName(least_hash(pool, "__id", pool_rows).distinct().withColumn("__y", F.lit(None).cast("int")))
    source = own.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__y", "__id", F.col(text_col).alias("__text"), *(F.col(c).alias(f"__n{i}") for i, c in enumerate(name_cols)))
    # One row of each id, that of least hash, so that the sample stays bounded however often an id is repeated.
    fields = source.columns[2:]
    source = source.groupBy("__y", "__id").agg(F.min_by(F.struct(*fields), F.xxhash64(*fields)).alias("x")).select("__y", "__id", *(F.col(f"x.{f}") for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                xs = _views(batch, 2, 3)
                cols = [pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()) for x in xs]
                key = pa.array([zlib.crc32(repr(i).encode()) for i in batch.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([key, batch.column(0), *cols], ["key", "y", "content", "meta"])

    rows = map_arrow(source, run, "key long, y int, content binary, meta binary").orderBy("key", "y", F.xxhash64("content")).toArrow()
    y = np.array([-1 if v is None else v for v in rows.column("y").to_pylist()], np.int64)
    width = [TRIGRAM_SLOTS + 3, NAME_SLOTS * len(name_cols) + 4 + 2 * len(_CLASSES)]
    xs = []
    for name, w in zip(("content", "meta"), width):
        x = np.empty((len(y), w), np.float16)
        for i, raw in enumerate(rows.column(name)):
            x[i] = np.frombuffer(raw.as_buffer(), np.float16)
        xs.append(x)
    del rows
    labelled, pool = [x[y >= 0] for x in xs], [x[y < 0] for x in xs]
    del xs, x
    return co_train(labelled, y[y >= 0], pool, rounds)


def score(
    docs: DataFrame, model: CoTrained, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    name_cols: tuple[str, ...] = ("source", "lang"), threshold: float = THRESHOLD,
) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``accepted`` of each document."""
    names = list(keep)
    text, text_at = text_column(names, text_col)
    source = docs.select(*names, *text, *(F.col(c).alias(f"__n{i}") for i, c in enumerate(name_cols)))
    first = len(names) + len(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = shared.value.score(_views(part, text_at, first)).astype(float)
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(names))), pa.array(got), pa.array(got >= threshold)], [*names, "score", "accepted"])

    fields = [*source.schema.fields[: len(names)], T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return map_arrow(source, run, T.StructType(fields))
