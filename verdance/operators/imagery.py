"""Whole-image operators: decoding, capture times, frame detection, gap filling by interpolation."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pixels_of(images: DataFrame, image: str = "image") -> DataFrame:
    """Rows ``file, prow, pcol, b, g, r`` of Spark's image source; images that can't be read have none."""
    fields = images.select(F.col(f"{image}.origin").alias("file"), F.col(f"{image}.height").alias("h"), F.col(f"{image}.width").alias("w"), F.col(f"{image}.nChannels").alias("n"), F.col(f"{image}.data").alias("data"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                if row.h <= 0 or row.w <= 0:
                    continue
                a = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.n)
                b, g, r = (a[..., 0],) * 3 if row.n < 3 else (a[..., 0], a[..., 1], a[..., 2])
                y, x = np.mgrid[: row.h, : row.w]
                yield pd.DataFrame({"file": row.file, "prow": y.ravel(), "pcol": x.ravel(), "b": b.ravel().astype(float), "g": g.ravel().astype(float), "r": r.ravel().astype(float)})

    return fields.mapInPandas(run, "file string, prow long, pcol long, b double, g double, r double")


def exif_time(raw: bytes | None) -> str | None:
    """The original or, lacking that, the modification time of a JPEG, in ISO form; text of another form as it is."""
    if not raw or raw[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tiff_time(body[6:])
        if raw[at + 1] == 0xDA:
            return None
        at += 2 + size
    return None


def _tiff_time(tiff: bytes) -> str | None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return None
    found: dict[int, str] = {}
    todo, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, _, count, value = struct.unpack(order + "HHII", entry)
            if tag == 0x8769:
                todo.append(value)
            elif tag in (0x9003, 0x0132):
                text = entry[8 : 8 + count] if count <= 4 else tiff[value : value + count]
                found[tag] = text.split(b"\0")[0].decode("ascii", "replace").strip()
    text = found.get(0x9003) or found.get(0x0132)
    if not text:
        return None
    try:
        return pd.to_datetime(text, format="%Y:%m:%d %H:%M:%S").strftime("%Y-%m-%d %H:%M:%S")
    except ValueError:
        return text


def capture_times(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """``path`` and ``datetime`` of binary files."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({path: part[path], "datetime": [exif_time(c) for c in part[content]]})

    return files.select(path, content).mapInPandas(run, f"{path} string, datetime string")


def photo_metrics(images: DataFrame, files: DataFrame | None = None, threshold: float = 0.38, image: str = "image") -> DataFrame:
    """One row per photo: ``filename, datetime, green_ratio, green_mean, green_std, status, error``.

    ``images`` come from Spark's image source with invalid ones kept: a photo that
    can't be read is a row of NULL figures (``NA`` in delimited files) with status
    ``failed``.  ``files`` (whole files) give the capture times.
    """
    fields = images.select(F.col(f"{image}.origin").alias("filename"), *(F.col(f"{image}.{c}").alias(c) for c in ("height", "width", "nChannels", "data")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part.itertuples(index=False):
                size = p.height * p.width * p.nChannels if p.height > 0 and p.width > 0 else 0
                if not size or p.data is None or len(p.data) != size:
                    rows.append((p.filename, None, None, None, "failed", "Could not read image"))
                    continue
                a = np.frombuffer(p.data, np.uint8).reshape(p.height, p.width, p.nChannels).astype(float)
                a = a[..., :3] if p.nChannels >= 3 else a.repeat(3, axis=2)[..., :3]
                total = a.sum(2)
                gcc = np.divide(a[..., 1], total, out=np.zeros_like(total), where=total > 0)
                green = gcc[gcc > threshold]
                rows.append((p.filename, green.size / gcc.size, green.mean() if green.size else 0.0, green.std() if green.size else 0.0, "ok", None))
            yield pd.DataFrame(rows, columns=["filename", "green_ratio", "green_mean", "green_std", "status", "error"])

    out = fields.mapInPandas(run, "filename string, green_ratio double, green_mean double, green_std double, status string, error string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  both sources name local files, each in its way
    if files is None:
        out = out.withColumn("datetime", F.lit(None).cast("string"))
    else:
        taken = capture_times(files).select(plain("path").alias("__path"), "datetime")
        out = out.withColumn("__path", plain("filename")).join(taken, "__path", "left")
    return out.select("filename", "datetime", "green_ratio", "green_mean", "green_std", "status", "error")


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, padded)
    return a


def _slide(a: np.ndarray, size: int, f) -> np.ndarray:
    half = size // 2
    edge = np.pad(a, half, mode="edge")
    return f(np.lib.stride_tricks.sliding_window_view(edge, (size, size)), axis=(2, 3))


def _otsu(a: np.ndarray, bins: int = 256) -> float:
    n, edges = np.histogram(a, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    w0 = np.cumsum(n)
    w1 = n.sum() - w0
    s = np.cumsum(n * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = s / w0 - (s[-1] - s) / w1
    return float(mid[np.argmax(np.nan_to_num(w0 * w1 * gap**2))])


def _components(mask: np.ndarray) -> np.ndarray:
    """Least linear index of each pixel's component (eight neighbours)."""
    labels = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        low = np.where(mask, _slide(labels, 3, np.min), mask.size)
        flat = np.append(low.ravel(), mask.size)
        low = np.where(mask, flat[low], mask.size)  # jump to the label's own label
        if np.array_equal(low, labels):
            return labels
        labels = low


def sobel(a: np.ndarray) -> np.ndarray:
    """Root mean square of the two Sobel derivatives (weights sum to one), edges repeated."""
    smooth, slope = np.array([0.25, 0.5, 0.25]), np.array([0.5, 0.0, -0.5])
    b = np.pad(a, 1, mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")
    part = lambda r, c: sum(r[i] * c[j] * b[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3))
    return np.sqrt((part(slope, smooth) ** 2 + part(smooth, slope) ** 2) / 2)


def frame_box(gray: np.ndarray, least: int = 1000, inset: int = 100, sigma: float = 3.0) -> tuple[int, int, int, int] | None:
    """``x1, y1, x2, y2`` of a bright frame, inset; None if no large edge is found.

    Blur, gradient, threshold, opening, erosion, removal of small parts, bounding box.
    """
    edge = sobel(_blur(gray.astype(float), sigma))
    if edge.max() - edge.min() < 1e-9:
        return None
    mask = edge > _otsu(edge)
    for f in (np.min, np.min, np.max, np.max):
        mask = _slide(mask.astype(np.uint8), 5, f).astype(bool)
    mask = _slide(mask.astype(np.uint8), 3, np.min).astype(bool)
    labels = _components(mask)
    names, counts = np.unique(labels[mask], return_counts=True)
    y, x = np.nonzero(np.isin(labels, names[counts >= least]) & mask)
    if not len(x):
        return None
    return int(x.min() + inset), int(y.min() + inset), int(x.max() - inset), int(y.max() - inset)


def frames(pixels: DataFrame, image: str = "image", least: int = 1000, inset: int = 100) -> DataFrame:
    """``image, x1, y1, x2, y2`` of each image's frame, NULL if there is none."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        gray = np.zeros((int(pdf.prow.max()) + 1, int(pdf.pcol.max()) + 1))
        gray[pdf.prow, pdf.pcol] = 0.299 * pdf.r + 0.587 * pdf.g + 0.114 * pdf.b
        box = frame_box(gray, least, inset) or (None,) * 4
        return pd.DataFrame([[pdf[image].iloc[0], *box]], columns=[image, "x1", "y1", "x2", "y2"]).astype({c: "Int64" for c in ("x1", "y1", "x2", "y2")})

    schema = T.StructType([pixels.schema[image], *(T.StructField(c, T.LongType()) for c in ("x1", "y1", "x2", "y2"))])
    return pixels.groupBy(image).applyInPandas(one, schema)
