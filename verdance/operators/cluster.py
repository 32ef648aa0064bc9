"""Unsupervised pixel classes, one image at a time.

An image is one group of pixels, bounded by its own size; beside it a task holds
blocks only (distances of some hundred pixels at a time).  The two classes of a
method are named by brightness or hue, so results don't depend on the order in
which a method finds them.  One-dimensional two-means is exact and runs in the
engine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lab(rgb: np.ndarray) -> np.ndarray:
    """L, a, b of 8-bit red, green, blue rows, scaled to 0..255 as 8-bit images store them."""
    c = rgb / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    # sRGB to XYZ under D65, and its white point.
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[:, 1] > 0.008856, 116 * np.cbrt(xyz[:, 1]) - 16, 903.3 * xyz[:, 1])
    return np.column_stack((light * 255 / 100, 500 * (f[:, 0] - f[:, 1]) + 128, 200 * (f[:, 1] - f[:, 2]) + 128))


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue (0 to 180), saturation and value (0 to 255)."""
    top, low = rgb.max(1), rgb.min(1)
    span = np.maximum(top - low, 1e-12)
    r, g, b = rgb.T
    hue = np.where(top == r, 60 * (g - b) / span, np.where(top == g, 120 + 60 * (b - r) / span, 240 + 60 * (r - g) / span)) % 360
    return np.column_stack((np.where(top == low, 0, hue) / 2, np.where(top > 0, 255 * (top - low) / np.maximum(top, 1e-12), 0), top))


def kmeans(x: np.ndarray, k: int = 2, seed: int = 42, tries: int = 10, rounds: int = 100, eps: float = 0.2, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of several seeded runs, as many side by side as ``cells`` distances allow."""
    rng = np.random.default_rng(seed)
    starts = np.array([x[rng.choice(len(x), k, replace=len(x) < k)] for _ in range(tries)], float)
    best = (np.inf, np.zeros(len(x), int), starts[0])
    at_once = max(1, min(tries, cells // max(1, len(x) * k)))
    square = np.square(x).sum(1)
    far_of = lambda c: square[:, None] - 2 * x @ c.reshape(-1, x.shape[1]).T + np.square(c).sum(2).ravel()
    for i in range(0, tries, at_once):
        centres = starts[i : i + at_once]
        for _ in range(rounds):
            labels = far_of(centres).reshape(len(x), -1, k).argmin(2)
            member = np.stack([labels == j for j in range(k)], 2).reshape(len(x), -1).astype(float)
            count = member.sum(0)
            moved = np.where(count[:, None] > 0, member.T @ x / np.maximum(count, 1)[:, None], centres.reshape(-1, x.shape[1])).reshape(centres.shape)
            shift, centres = np.abs(moved - centres).max(), moved
            if shift <= eps * 1e-3:
                break
        far = far_of(centres).reshape(len(x), -1, k)
        costs = far.min(2).sum(0)
        for j in np.flatnonzero(costs < best[0] - 1e-9):
            if costs[j] < best[0] - 1e-9:
                best = (costs[j], far[:, j].argmin(1), centres[j])
    return best[1], best[2]


def gaussian_mixture(x: np.ndarray, k: int = 2, seed: int = 42, rounds: int = 100, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Labels and means of a full-covariance mixture, started from k-means."""
    labels, _ = kmeans(x, k, seed)
    member = np.eye(k)[labels]
    last = -np.inf
    for _ in range(rounds):
        n = member.sum(0) + 1e-12
        means = member.T @ x / n[:, None]
        log = np.empty((len(x), k))
        for j in range(k):
            d = x - means[j]
            cov = (member[:, j, None] * d).T @ d / n[j] + max(ridge, 1e-6 * x.var()) * np.eye(x.shape[1])
            _, det = np.linalg.slogdet(cov)
            log[:, j] = np.log(n[j] / len(x)) - 0.5 * (det + np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d))
        top = log.max(1, keepdims=True)
        total = top + np.log(np.exp(log - top).sum(1, keepdims=True))
        member = np.exp(log - total)
        if total.sum() - last < 1e-3:
            break
        last = total.sum()
    return member.argmax(1), means


def _join(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the classes of ``left[i]`` and ``right[i]``; a label is the least index of its class."""
    while left.size:
        a, b = labels[left], labels[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not left.size:
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def dbscan(x: np.ndarray, eps: float = 0.5, least: int = 10, block: int = 512) -> np.ndarray:
    """Density clusters, -1 for noise; a border point goes to the cluster of its least core neighbour.

    Points are looked for in their own cell of width ``eps`` and the cells around it only.
    """
    n = len(x)
    if not n:
        return np.zeros(0, int)
    cells, of = np.unique(np.floor((x - x.min(0)) / eps).astype(np.int64), axis=0, return_inverse=True)
    of = of.ravel()
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])

    def parts():
        """Blocks of a cell's points with all that may be near, ascending, and whether they are."""
        for c, rows in enumerate(members):
            around = np.flatnonzero((np.abs(cells - cells[c]) <= 1).all(1))
            other = np.sort(np.concatenate([members[i] for i in around]))
            for i in range(0, len(rows), block):
                part = rows[i : i + block]
                yield part, other, np.square(x[part, None] - x[other]).sum(2) <= eps * eps

    core = np.zeros(n, bool)
    for rows, _, near in parts():
        core[rows] = near.sum(1) >= least
    labels, border = np.arange(n), np.full(n, -1)
    for rows, other, near in parts():
        near = near & core[other]
        u, v = np.nonzero(near & core[rows][:, None])
        _join(labels, rows[u], other[v])
        edge = ~core[rows] & near.any(1)
        border[rows[edge]] = other[near[edge].argmax(1)]
    out = np.where(core, labels, np.where(border >= 0, labels[border], -1))
    return np.where(out < 0, -1, np.searchsorted(np.unique(out[out >= 0]), out))


def _leading(multiply: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int, width: int = 6, steps: int = 14) -> np.ndarray:
    """The ``k`` leading eigenvectors of a symmetric operator, from a block Krylov space."""
    basis = [np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(width, n))))[0]]
    for _ in range(min(steps, n // width)):
        new = multiply(basis[-1])
        for _ in range(2):
            for b in basis:
                new = new - b @ (b.T @ new)
        q, r = np.linalg.qr(new)
        q = q[:, np.abs(np.diag(r)) > 1e-10]
        if not q.shape[1]:
            break
        basis.append(q)
    whole = np.concatenate(basis, 1)
    _, inner = np.linalg.eigh(whole.T @ multiply(whole))
    return whole @ inner[:, -k:]


def spectral(x: np.ndarray, k: int = 2, gamma: float = 1.0, seed: int = 42, samples: int = 10000, neighbours: int = 5, direct: int = 1500, block: int = 512) -> np.ndarray:
    """Clusters of the normalised affinity's leading vectors; beyond ``samples`` rows the rest take their neighbours' label.

    Up to ``direct`` rows the matrix is decomposed as a whole; beyond, it is multiplied a block of rows at a time.
    """
    rng = np.random.default_rng(seed)
    chosen = np.sort(rng.choice(len(x), samples, replace=False)) if len(x) > samples else np.arange(len(x))
    s = x[chosen]
    square = np.square(s).sum(1)
    near = lambda i: np.exp(-gamma * np.maximum(0, square[i : i + block, None] - 2 * s[i : i + block] @ s.T + square))
    rows = range(0, len(s), block)
    scale = 1 / np.sqrt(np.concatenate([near(i).sum(1) for i in rows]))
    if len(s) <= direct:
        lead = np.linalg.eigh(np.concatenate([near(i) for i in rows]) * scale[:, None] * scale)[1][:, -k:]
    else:
        lead = _leading(lambda v: np.concatenate([near(i) @ (scale[:, None] * v) for i in rows]) * scale[:, None], len(s), k, seed)
    lead = lead * scale[:, None]
    lead = lead / np.maximum(1e-12, np.abs(lead).max(0))
    labels, _ = kmeans(lead, k, seed, eps=1e-3)
    if len(chosen) == len(x):
        return labels
    out = np.empty(len(x), int)
    for i in range(0, len(x), block):
        order = ((x[i : i + block, None] - s) ** 2).sum(2).argsort(1, kind="stable")[:, :neighbours]
        out[i : i + block] = [np.bincount(v, minlength=k).argmax() for v in labels[order]]
    return out


def _by(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Classes 1 and 2 of labels 0 and 1, the lower mean value first."""
    if (labels == 0).any() and (labels == 1).any() and values[labels == 0].mean() > values[labels == 1].mean():
        labels = 1 - labels
    return labels + 1


def _kmeans_classes(rgb: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = lab(rgb)
    return _by(x[:, 0], kmeans(x)[0])


def _gmm_classes(rgb: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = hsv(rgb)
    return _by(x[:, 0], gaussian_mixture(x)[0])


def _dbscan_classes(rgb: np.ndarray, at: np.ndarray, spatial: float = 0.01) -> np.ndarray:
    """The largest cluster is class 1, the second class 2, the rest none; without two clusters all pixels are class 1."""
    x = np.column_stack((lab(rgb), at * spatial))
    labels = dbscan((x - x.mean(0)) / np.maximum(x.std(0), 1e-12))
    names, counts = np.unique(labels[labels >= 0], return_counts=True)
    if len(names) < 2:
        return np.ones(len(x), int)
    out = np.zeros(len(x), int)
    for cls, j in enumerate(np.argsort(-counts, kind="stable")[:2], 1):
        out[labels == names[j]] = cls
    return out


def _spectral_classes(rgb: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = lab(rgb)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    return _by(x[:, 0], spectral(z))


#: method -> (classes of green pixels, green pixels it needs)
METHODS: dict[str, tuple[Callable, int]] = {"kmeans": (_kmeans_classes, 1), "gmm": (_gmm_classes, 101), "dbscan": (_dbscan_classes, 101), "spectral": (_spectral_classes, 101)}


def vegetation_classes(pixels: DataFrame, method: str = "kmeans", image: str = "image", threshold: float = 0.38, least: int | None = None) -> DataFrame:
    """One row per image: ratio, mean, deviation and norm of its green pixels and of two classes of them.

    ``pixels`` has ``image, prow, pcol, r, g, b``; an unknown method is taken as k-means.
    """
    name = method if method in METHODS else "kmeans"
    names = [f"{part}_{m}" for part in ("green", "class1", "class2") for m in ("ratio", "mean", "std", "norm")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prow", "pcol"])
        rgb = pdf[["r", "g", "b"]].to_numpy(float)
        total = rgb.sum(1)
        gcc = np.where(total > 0, rgb[:, 1] / np.maximum(total, 1e-10), 0.0)
        green = gcc > threshold
        classes = np.zeros(len(pdf), int)
        f, enough = METHODS[name]
        if green.sum() >= max(1, enough if least is None else least):
            classes[green] = f(rgb[green], pdf[["pcol", "prow"]].to_numpy(float)[green])

        def metrics(mask: np.ndarray) -> list[float]:
            g = gcc[mask]
            return [mask.mean(), g.mean(), g.std(), g.sum() / len(g)] if len(g) else [0.0] * 4

        values = metrics(green) + metrics(classes == 1) + metrics(classes == 2)
        return pd.DataFrame([[pdf[image].iloc[0], *map(float, values), name]], columns=[image, *names, "method"])

    schema = T.StructType([pixels.schema[image], *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("method", T.StringType())])
    return pixels.select(image, "prow", "pcol", "r", "g", "b").groupBy(image).applyInPandas(one, schema)


def kmeans_threshold(pixels: DataFrame, image: str = "image", share: float = 0.6) -> DataFrame:
    """``image, threshold``: a point between the two centres of an image's green shares.

    Two classes of numbers are split at one place of their order, so running sums
    over the distinct shares give the best of all splits; the lowest on ties.
    """
    green = F.col("g") / (F.col("r") + F.col("g") + F.col("b") + 1e-10)
    counted = pixels.select(image, green.alias("x")).where("x is not null").groupBy(image, "x").agg(F.count("*").alias("n"))
    up = Window.partitionBy(image).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(image)
    sums = counted.withColumns({"n0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("x")).over(up), "na": F.sum("n").over(whole), "sa": F.sum(F.col("n") * F.col("x")).over(whole)})
    n1, s1 = F.col("na") - F.col("n0"), F.col("sa") - F.col("s0")
    low = F.col("s0") / F.col("n0")
    high = F.when(n1 > 0, s1 / F.nullif(n1, F.lit(0))).otherwise(low)  # of one value both centres are it
    gain = F.round(F.col("s0") * low + s1 * high, 9)
    best = sums.groupBy(image).agg(F.max(F.struct(gain.alias("gain"), (-F.col("x")).alias("x"), low.alias("low"), high.alias("high"))).alias("b"))
    return best.select(image, (F.col("b.low") + share * (F.col("b.high") - F.col("b.low"))).alias("threshold"))
