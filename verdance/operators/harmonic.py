"""Harmonic time-series models and continuous change detection, one pixel's series at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 0.99 quantiles of chi-squared by degrees of freedom.
CHI2_99 = {1: 6.634897, 2: 9.210340, 3: 11.344867, 4: 13.276704, 5: 15.086272}


def basis(t: np.ndarray) -> np.ndarray:
    """1, t and cosine and sine of one, two and three cycles a year."""
    w = 2 * np.pi * t
    return np.column_stack([np.ones_like(t), t, *(f(k * w) for k in (1, 2, 3) for f in (np.cos, np.sin))])


def fit(t: np.ndarray, y: np.ndarray, penalty: float = 0.0, terms: int = 8, rounds: int = 10000) -> np.ndarray:
    """Eight coefficients by least squares, or by coordinate descent under an absolute penalty; unused terms are zero."""
    a = basis(t)[:, :terms]
    out = np.zeros(8)
    if penalty <= 0:
        out[:terms] = np.linalg.lstsq(a, y, rcond=None)[0]
        return out
    mean, scale = a.mean(0), np.maximum(a.std(0), 1e-12)
    mean[0], scale[0] = 0.0, 1.0
    z = (a - mean) / scale
    n, w = len(t), np.zeros(terms)
    gram, target = z.T @ z / n, z.T @ y / n
    for _ in range(rounds):
        before = w.copy()
        for j in range(terms):
            r = target[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = r / gram[j, j] if j == 0 else np.sign(r) * max(abs(r) - penalty, 0) / max(gram[j, j], 1e-12)
        if np.abs(w - before).max() < 1e-9:
            break
    out[:terms] = w / scale
    out[0] = w[0] - (out[1:terms] * mean[1:]).sum()
    return out


def predict(t: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    return basis(t) @ coefs


def screened(t: np.ndarray, y: np.ndarray, limit: float = 4.685, rounds: int = 5) -> np.ndarray:
    """Observations that a robust yearly model leaves far out in any column: clouds and shadows that masks missed.

    Iterated bisquare weights; far is beyond ``limit`` scaled median deviations.
    """
    out = np.zeros(len(t), bool)
    if len(t) < 8:
        return out
    a = basis(t)[:, :4]
    for v in y.T:
        w = np.ones(len(t))
        for _ in range(rounds):
            c = np.linalg.lstsq(a * w[:, None], v * w, rcond=None)[0]
            res = v - a @ c
            scale = max(1.4826 * np.median(np.abs(res - np.median(res))), 1e-9)
            u = np.clip(res / (limit * scale), -1, 1)
            w = np.sqrt((1 - u**2) ** 2)
        out |= np.abs(res) > limit * scale
    return out


def _terms(n: int) -> int:
    """Terms that ``n`` observations support: three for each harmonic's pair and the trend."""
    return 8 if n >= 24 else 6 if n >= 18 else 4 if n >= 12 else 2


def segments(
    t: np.ndarray, y: np.ndarray, least: int = 6, chi2: float | None = None, min_years: float = 1.33, penalty: float = 0.002, rounds: int = 10000
) -> list[dict]:
    """Stable stretches of a series (columns of ``y`` are bands) and the breaks that end them.

    A stretch starts with a window of ``least`` observations and ``min_years`` whose
    model leaves its ends in range.  It grows one observation at a time; a break is
    certain once ``least`` observations in a row leave the range, while fewer are
    dropped as outliers.
    """
    limit = CHI2_99[min(5, y.shape[1])] if chi2 is None else chi2
    out, start, n = [], 0, len(t)
    gone = np.zeros(n, bool)

    def model(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coefs = np.array([fit(t[rows], y[rows, b], penalty, _terms(len(rows)), rounds) for b in range(y.shape[1])])
        res = y[rows] - np.column_stack([predict(t[rows], c) for c in coefs])
        return coefs, np.maximum(np.sqrt((res**2).sum(0) / max(1, len(rows) - _terms(len(rows)))), 1e-6)

    def off(i, coefs, rmse) -> np.ndarray:
        return (((y[i] - np.column_stack([predict(np.atleast_1d(t[i]), c) for c in coefs])) / rmse) ** 2).sum(-1)

    while start < n:
        end = start + 2 * least
        while end <= n and t[end - 1] - t[start] < min_years:
            end += 1
        rows = np.flatnonzero(~gone[:n] & (np.arange(n) >= start) & (np.arange(n) < min(end, n)))
        if end > n or len(rows) < least:
            rows = np.flatnonzero(~gone & (np.arange(n) >= start))
            if len(rows) >= least:
                coefs, rmse = model(rows)
                out.append({"first": rows[0], "last": rows[-1], "t_break": None, "prob": 0.0, "magnitude": None, "coefs": coefs, "rmse": rmse, "n": len(rows)})
            break
        coefs, rmse = model(rows)
        if out and off(rows[[0, -1]], coefs, rmse).max() > 4 * limit and end < n:
            start += 1  # not stable yet
            continue
        i, fitted, broke = end, len(rows), False
        while i < n:
            ahead = np.arange(i, min(n, i + least))
            if (off(ahead, coefs, rmse) > limit).all() and len(ahead) == least:
                broke = True
                break
            if off(np.array([i]), coefs, rmse)[0] > limit:
                gone[i] = True
            else:
                rows = np.append(rows, i)
                if len(rows) >= 1.33 * fitted or _terms(len(rows)) != _terms(fitted):
                    coefs, rmse = model(rows)
                    fitted = len(rows)
            i += 1
        coefs, rmse = model(rows)
        seg = {"first": rows[0], "last": rows[-1], "t_break": None, "prob": 0.0, "magnitude": None, "coefs": coefs, "rmse": rmse, "n": len(rows)}
        if broke:
            ahead = np.arange(i, i + least)
            jump = np.median(y[ahead] - np.column_stack([predict(t[ahead], c) for c in coefs]), axis=0)
            seg |= {"t_break": float(t[i]), "prob": 1.0, "magnitude": jump}
            out.append(seg)
            start = i
        else:
            out.append(seg)
            break
    return out


def _from_sums(gram: np.ndarray, target: np.ndarray, square: np.ndarray, n: np.ndarray, penalty: float, rounds: int = 10000) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and root mean square errors of many series from their sums of products."""
    if penalty <= 0:
        coefs = (np.linalg.pinv(gram, rcond=1e-13, hermitian=True) @ target[:, :, None])[:, :, 0]
    else:
        mean = gram[:, 0] / n[:, None]
        scale = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2) / n[:, None] - mean**2, 0))
        scale = np.maximum(scale, 1e-12)
        z = (gram / n[:, None, None] - mean[:, :, None] * mean[:, None]) / (scale[:, :, None] * scale[:, None])
        goal = (target / n[:, None] - mean * target[:, :1] / n[:, None]) / scale
        w = np.zeros(target.shape)
        for _ in range(rounds):
            before = w.copy()
            for j in range(1, w.shape[1]):
                r = goal[:, j] - (z[:, j, 1:] * w[:, 1:]).sum(1) + z[:, j, j] * w[:, j]
                w[:, j] = np.sign(r) * np.maximum(np.abs(r) - penalty, 0) / np.maximum(z[:, j, j], 1e-12)
            if np.abs(w - before).max() < 1e-9:
                break
        coefs = w / scale
        coefs[:, 0] = target[:, 0] / n - (coefs[:, 1:] * mean[:, 1:]).sum(1)
    left = square - 2 * (coefs * target).sum(1) + ((coefs[:, None] @ gram)[:, 0] * coefs).sum(1)
    return coefs, np.sqrt(np.maximum(left, 0) / n)


def harmonic_fit(df: DataFrame, keys: tuple[str, ...], t: str = "t", value: str = "value", penalty: float = 0.0, least: int = 12) -> DataFrame:
    """``keys, n, coefs`` (eight) and ``rmse`` of each key's series; short series have NULL coefficients.

    Sums of products are aggregated where the rows are, so no task holds a series;
    what is left is an 8 x 8 system for each key.  Times count from the earliest
    whole one, which keeps the systems well conditioned.
    """
    good = F.col(t).isNotNull() & F.col(value).isNotNull() & ~F.isnan(t) & ~F.isnan(value)
    first = df.where(good).agg(F.floor(F.min(t))).first()[0] or 0
    x = F.col(t).cast("double")
    waves = [f(F.lit(2 * np.pi * k) * x) for k in (1, 2, 3) for f in (F.cos, F.sin)]
    terms = [F.lit(1.0), x - F.lit(float(first)), *waves]
    y = F.col(value).cast("double")
    pairs = [(i, j) for i in range(8) for j in range(i, 8)]
    total = lambda c, name: F.sum(F.when(good, c)).alias(name)
    sums = [total(terms[i] * terms[j], f"__g{i}{j}") for i, j in pairs] + [total(a * y, f"__t{i}") for i, a in enumerate(terms)]
    summed = df.groupBy(*keys).agg(F.count_if(good).alias("n"), total(y * y, "__s"), *sums)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[list(keys)].copy()
            out["n"] = part["n"].fillna(0).astype("int64")
            out["coefs"], out["rmse"] = None, None
            full = (out["n"] >= least).to_numpy()
            if full.any():
                rows = part[full]
                gram = np.zeros((len(rows), 8, 8))
                for i, j in pairs:
                    gram[:, i, j] = gram[:, j, i] = rows[f"__g{i}{j}"]
                target = rows[[f"__t{i}" for i in range(8)]].to_numpy(float)
                coefs, rmse = _from_sums(gram, target, rows["__s"].to_numpy(float), rows["n"].to_numpy(float), penalty)
                coefs[:, 0] -= coefs[:, 1] * first
                at = np.flatnonzero(full)
                column = np.full(len(out), None, object)
                for i, c in zip(at, coefs):
                    column[i] = c.tolist()
                out["coefs"] = column
                error = np.full(len(out), np.nan)
                error[at] = rmse
                out["rmse"] = pd.Series(error, out.index).astype("Float64").where(full)
            yield out

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("coefs", T.ArrayType(T.DoubleType())), T.StructField("rmse", T.DoubleType())])
    return summed.mapInPandas(solve, schema)


def ccdc(df: DataFrame, keys: tuple[str, ...], t: str = "t", bands: tuple[str, ...] = ("value",), screen: tuple[str, ...] = (), **parameters) -> DataFrame:
    """Segments of each key's series; observations that ``screen`` bands show to be clouded are left out first.

    One row per segment: ``keys, segment, t_start, t_end, t_break, prob, magnitude, rmse, coefs, n`` (magnitude, rmse and coefs of the first band)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf.dropna(subset=[t, *bands, *screen]).sort_values([t, *bands])
        if screen:
            good = good[~screened(good[t].to_numpy(float), good[list(screen)].to_numpy(float))]
        x, y = good[t].to_numpy(float), good[list(bands)].to_numpy(float)
        rows = []
        for s, seg in enumerate(segments(x, y, **parameters)):
            jump = None if seg["magnitude"] is None else float(seg["magnitude"][0])
            rows.append([*(pdf[k].iloc[0] for k in keys), s + 1, float(x[seg["first"]]), float(x[seg["last"]]), seg["t_break"], seg["prob"], jump, float(seg["rmse"][0]), seg["coefs"][0].tolist(), seg["n"]])
        return pd.DataFrame(rows, columns=[*keys, "segment", "t_start", "t_end", "t_break", "prob", "magnitude", "rmse", "coefs", "n"])

    double = [T.StructField(n, T.DoubleType()) for n in ("t_start", "t_end", "t_break", "prob", "magnitude", "rmse")]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("segment", T.LongType()), *double, T.StructField("coefs", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    return df.select(*keys, t, *bands, *(c for c in screen if c not in bands)).groupBy(*keys).applyInPandas(one, schema)
