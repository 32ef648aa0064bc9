"""GeoTIFF, NumPy, shapefile and workbook readers and writers without further libraries.

Rasters are read by windows through ``pyarrow``'s file systems; other files by Spark
as bytes, so any store works, and decoded one at a time on the executors.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_bytes

# TIFF tags and types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, NODATA = 33550, 33922, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


@dataclass
class Raster:
    """Bands by rows by columns with the affine placement of the upper left pixel."""

    bands: np.ndarray
    x0: float = 0.0
    y0: float = 0.0
    px: float = 1.0
    py: float = 1.0
    nodata: float | None = None


def lzw_decode(data: bytes) -> bytes:
    """TIFF's variant of LZW: most significant bit first, code width grown one entry early."""
    out, table, width, last = [], [], 9, b""
    value = bits = 0
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = value >> bits & ((1 << width) - 1)
            value &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return b"".join(out)
            if not last:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    value = bits = 0

    def put(code: int, width: int) -> None:
        nonlocal value, bits
        value, bits = (value << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits & 255)
        value &= (1 << bits) - 1

    fresh = {bytes([i]): i for i in range(256)}
    table, width, word = dict(fresh), 9, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        size = len(table) + 2
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256, width)
            table, width = dict(fresh), 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        size = len(table) + 3
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257, width)
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def _predicted(raw: bytes, rows: int, cols: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """Samples of a block, differencing undone."""
    size = dtype.itemsize
    if predictor == 3:
        b = np.frombuffer(raw, np.uint8)[: rows * cols * samples * size].reshape(rows, cols * size, samples)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, samples).astype(dtype.newbyteorder("="))
    a = np.frombuffer(raw, dtype)[: rows * cols * samples].reshape(rows, cols, samples).astype(dtype.newbyteorder("="))
    return np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a


class Ranged:
    """A file of any store that ``pyarrow`` opens, read by slices only."""

    def __init__(self, uri: str):
        filesystem, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
        self.file = filesystem.open_input_file(path)

    def __getitem__(self, part: slice) -> bytes:
        return self.file.read_at(part.stop - part.start, part.start)


@dataclass
class Layout:
    """Where the blocks of a TIFF lie and how they are stored."""

    w: int
    h: int
    samples: int
    dtype: np.dtype
    planes: int
    tiled: bool
    bw: int
    bh: int
    offsets: tuple
    sizes: tuple
    compression: int
    predictor: int
    place: tuple
    nodata: float | None


def tiff_layout(raw) -> Layout:
    """The layout of the first image of a classic or big TIFF; ``raw`` is bytes or :class:`Ranged`."""
    order = {b"II": "<", b"MM": ">"}[raw[0:2]]
    magic = struct.unpack(order + "H", raw[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    # Big TIFFs have 8-byte counts and places: sizes of the count of entries, of an entry and of its inline value.
    many, entry_size, inline, word = (2, 12, 4, "I") if magic == 42 else (8, 20, 8, "Q")
    start = 4 if magic == 42 else 8
    at = struct.unpack(order + word, raw[start : start + inline])[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(order + {2: "H", 8: "Q"}[many], raw[at : at + many])[0]):
        entry = raw[at + many + entry_size * i : at + many + entry_size * (i + 1)]
        tag, kind, count = struct.unpack(order + "HH" + word, entry[: 4 + inline])
        if kind not in _TYPES:
            continue
        form = f"{order}{count}{_TYPES[kind]}"
        size = struct.calcsize(form)
        place = struct.unpack(order + word, entry[4 + inline :])[0]
        tags[tag] = struct.unpack(form, entry[4 + inline : 4 + inline + size] if size <= inline else raw[place : place + size])
    get = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, samples, bits = get(WIDTH, 0), get(HEIGHT, 0), get(SAMPLES, 1), get(BITS, 8)
    dtype = np.dtype({1: f"{order}u{bits // 8}", 2: f"{order}i{bits // 8}", 3: f"{order}f{bits // 8}"}[get(FORMAT, 1)])
    tiled = TILES in tags
    bw, bh = (get(TILE_WIDTH, w), get(TILE_HEIGHT, h)) if tiled else (w, min(h, get(ROWS, h)))
    x0 = y0 = 0.0
    px = py = 1.0
    if SCALE in tags and TIE in tags:
        px, py = tags[SCALE][:2]
        x0, y0 = tags[TIE][3] - tags[TIE][0] * px, tags[TIE][4] + tags[TIE][1] * py
    nodata = tags.get(NODATA, (None,))[0]
    try:
        nodata = None if nodata is None else float(nodata.split(b"\0")[0])
    except ValueError:
        nodata = None
    offsets, sizes = (tags[TILES], tags[TILE_SIZES]) if tiled else (tags[STRIPS], tags[STRIP_SIZES])
    return Layout(w, h, samples, dtype, samples if get(PLANAR, 1) == 2 else 1, tiled, bw, bh, offsets, sizes, get(COMPRESSION, 1), get(PREDICTOR, 1), (x0, y0, px, py), nodata)


def decode_tiff(raw, window: tuple[int, int, int, int] | None = None, layout: Layout | None = None) -> Raster:
    """The first image of a TIFF or a window ``(row0, row1, col0, col1)`` of it, ends left out: only blocks in the window are read.

    Strips or tiles, plain, LZW or deflate, all predictors, both planar layouts.
    """
    t = layout or tiff_layout(raw)
    r0, r1, c0, c1 = window or (0, t.h, 0, t.w)
    r1, c1 = min(r1, t.h), min(c1, t.w)
    inner = 1 if t.planes > 1 else t.samples
    across, down = -(-t.w // t.bw), -(-t.h // t.bh)
    top, left = r0 // t.bh, c0 // t.bw
    under, beyond = -(-max(r1, r0) // t.bh), -(-max(c1, c0) // t.bw)
    out = np.zeros((t.samples, max(0, under - top) * t.bh, max(0, beyond - left) * t.bw), t.dtype.newbyteorder("="))
    for plane in range(t.planes):
        for r in range(top, under):
            for c in range(left, beyond):
                n = plane * across * down + r * across + c
                part = raw[t.offsets[n] : t.offsets[n] + t.sizes[n]]
                if t.compression == 5:
                    part = lzw_decode(part)
                elif t.compression in (8, 32946):
                    part = zlib.decompress(part)
                elif t.compression != 1:
                    raise ValueError(f"compression {t.compression}")
                rows = t.bh if t.tiled else min(t.bh, t.h - r * t.bh)
                a = _predicted(part, rows, t.bw, inner, t.dtype, t.predictor)
                target = slice(plane, plane + 1) if t.planes > 1 else slice(None)
                y, x = (r - top) * t.bh, (c - left) * t.bw
                out[target, y : y + rows, x : x + t.bw] = a.transpose(2, 0, 1)
    x0, y0, px, py = t.place
    out = out[:, r0 - top * t.bh : r1 - top * t.bh, c0 - left * t.bw : c1 - left * t.bw]
    return Raster(out, x0 + c0 * px, y0 - r0 * py, px, py, t.nodata)


def encode_tiff(r: Raster, tile: int = 256) -> bytes:
    """A tiled float32 GeoTIFF, LZW with the floating-point predictor, bands apart."""
    bands, h, w = r.bands.shape
    across, down = -(-w // tile), -(-h // tile)
    padded = np.zeros((bands, down * tile, across * tile), np.float32)
    padded[:, :h, :w] = r.bands
    blocks = []
    for b in range(bands):
        for i in range(down):
            for j in range(across):
                a = padded[b, i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].astype(">f4")
                rows = np.ascontiguousarray(a).view(np.uint8).reshape(tile, tile, 4).transpose(0, 2, 1).reshape(tile, 4 * tile)
                blocks.append(lzw_encode(np.diff(rows, axis=1, prepend=np.zeros((tile, 1), np.uint8)).astype(np.uint8).tobytes()))
    head = 8
    offsets = []
    for block in blocks:
        offsets.append(head)
        head += len(block)
    head += head % 2
    entries = [
        (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [32] * bands), (COMPRESSION, "H", [5]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [2]), (PREDICTOR, "H", [3]),
        (TILE_WIDTH, "H", [tile]), (TILE_HEIGHT, "H", [tile]), (TILES, "I", offsets), (TILE_SIZES, "I", [len(b) for b in blocks]), (FORMAT, "H", [3] * bands),
        (SCALE, "d", [r.px, r.py, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, r.x0, r.y0, 0.0]),
    ]
    if r.nodata is not None:
        entries.append((NODATA, "s", [str(r.nodata).encode() + b"\0"]))
    codes = {v: k for k, v in _TYPES.items()}
    body, extra, place = b"", b"", head + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        data = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        count = len(data) if kind == "s" else len(values)
        if len(data) > 4:
            body += struct.pack("<HHII", tag, codes[kind], count, place + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            body += struct.pack("<HHI", tag, codes[kind], count) + data.ljust(4, b"\0")
    out = b"II*\0" + struct.pack("<I", head) + b"".join(blocks)
    return out.ljust(head, b"\0") + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0) + extra


_UNREADABLE = (ValueError, KeyError, IndexError, OSError, struct.error, zlib.error)


def read_geotiff(spark: SparkSession, path: str, bands: dict[int, str], names: str = "*.{tif,tiff,TIF,TIFF}", window: tuple[int, int, int, int] | None = None, size: int = 1024) -> DataFrame:
    """Rows ``file, prow, pcol, x, y`` and the named bands (numbered from 1); missing values are NULL, unreadable files have no rows.

    Spark lists the files; tasks then read headers and, dealt by windows of ``size``
    rows and columns, the blocks of a window each, so a file of any size is spread
    over tasks.  ``window`` ``(row0, row1, col0, col1)`` leaves out all others.
    """
    wanted = sorted(bands)

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file in part["path"]:
                try:
                    t = tiff_layout(Ranged(file))
                except _UNREADABLE:
                    continue
                r0, r1, c0, c1 = window or (0, t.h, 0, t.w)
                rows += [(file, r, min(r + size, r1, t.h), c, min(c + size, c1, t.w)) for r in range(r0, min(r1, t.h), size) for c in range(c0, min(c1, t.w), size)]
            yield pd.DataFrame(rows, columns=["path", "r0", "r1", "c0", "c1"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part.itertuples(index=False):
                try:
                    r = decode_tiff(Ranged(p.path), (p.r0, p.r1, p.c0, p.c1))
                except _UNREADABLE:
                    continue
                rows, cols = (a.ravel() for a in np.mgrid[p.r0 : p.r1, p.c0 : p.c1])
                out = {"file": p.path, "prow": rows, "pcol": cols, "x": r.x0 + (cols - p.c0 + 0.5) * r.px, "y": r.y0 - (rows - p.r0 + 0.5) * r.py}
                for b in wanted:
                    v = r.bands[b - 1].astype(float).ravel() if b <= len(r.bands) else np.full(rows.size, np.nan)
                    out[bands[b]] = np.where(v == r.nodata, np.nan, v) if r.nodata is not None else v
                yield pd.DataFrame(out)

    schema = "file string, prow long, pcol long, x double, y double, " + ", ".join(f"`{bands[b]}` double" for b in wanted)
    listed = read_bytes(spark, path, names).select("path").mapInPandas(windows, "path string, r0 long, r1 long, c0 long, c1 long")
    rows = listed.repartition("path", "r0", "c0").mapInPandas(run, schema)
    return rows.select("file", "prow", "pcol", "x", "y", *(F.nanvl(F.col(f"`{bands[b]}`"), F.lit(None).cast("double")).alias(bands[b]) for b in wanted))


def geotiffs(pixels: DataFrame, image: str, bands: list[str], x0: float = 0.0, y0: float = 0.0, px: float = 1.0, py: float = 1.0, tile: int = 256) -> DataFrame:
    """``image, content``: one GeoTIFF per image of a pixel table, NULL as NaN."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((len(bands), int(pdf.prow.max()) + 1, int(pdf.pcol.max()) + 1), np.nan, np.float32)
        for i, b in enumerate(bands):
            grid[i, pdf.prow, pdf.pcol] = pdf[b]
        return pd.DataFrame({image: [pdf[image].iloc[0]], "content": [encode_tiff(Raster(grid, x0, y0, px, py, float("nan")), tile)]})

    kind = pixels.schema[image].dataType.simpleString()
    return pixels.select(image, "prow", "pcol", *bands).groupBy(image).applyInPandas(one, f"`{image}` {kind}, content binary")


def read_npy(spark: SparkSession, path: str, axes: tuple[str, ...], value: str = "v") -> DataFrame:
    """Rows ``file``, one index per axis and ``value`` of NumPy array files; NaN is NULL."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, raw in zip(part["path"], part["content"]):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                places = np.indices(a.shape).reshape(a.ndim, -1)
                yield pd.DataFrame({"file": file, **dict(zip(axes, places)), value: a.astype(float).ravel()})

    rows = read_bytes(spark, path, "*.npy").select("path", "content").mapInPandas(run, "file string, " + ", ".join(f"{a} long" for a in axes) + f", {value} double")
    return rows.withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def npys(df: DataFrame, key: str, axes: tuple[str, ...], value: str = "v") -> DataFrame:
    """``key, content``: one NumPy array file for each key of a table with an index per axis; absent cells and NULL are NaN."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full([int(pdf[a].max()) + 1 for a in axes], np.nan)
        grid[tuple(pdf[a] for a in axes)] = pdf[value]
        out = io.BytesIO()
        np.save(out, grid, allow_pickle=False)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [out.getvalue()]})

    return df.select(key, *axes, value).groupBy(key).applyInPandas(one, f"`{key}` {df.schema[key].dataType.simpleString()}, content binary")


def polygons_of(shp: bytes) -> list[list[tuple[float, float, float, float]]]:
    """Edges of each polygon record of a shapefile; records of other kinds are empty."""
    out, at = [], 100
    while at + 12 <= len(shp):
        size = 2 * struct.unpack(">I", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + size]
        edges: list[tuple[float, float, float, float]] = []
        if struct.unpack("<I", body[:4])[0] in (5, 15, 25):
            n_parts, n_points = struct.unpack("<II", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}I", body[44 : 44 + 4 * n_parts]), n_points]
            flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            points = list(zip(flat[::2], flat[1::2]))
            for a, b in zip(starts, starts[1:]):
                edges += [(*p, *q) for p, q in zip(points[a:b], points[a + 1 : b])]
        out.append(edges)
        at += 8 + size
    return out


def names_of(dbf: bytes, field: str) -> list[str]:
    """A text column of a shapefile's attribute table."""
    count, head, size = struct.unpack("<IHH", dbf[4:12])
    at, place = 32, 1
    while dbf[at] != 13:
        name, width = dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]
        if name == field:
            return [dbf[head + i * size + place : head + i * size + place + width].decode("utf-8", "replace").strip() for i in range(count)]
        at, place = at + 32, place + width
    raise ValueError(f"no field {field!r}")


def encode_polygons(polygons: list[list[tuple[float, float]]]) -> bytes:
    """A shapefile of closed rings."""
    records = b""
    for i, ring in enumerate(polygons):
        xs, ys = zip(*ring)
        body = struct.pack("<I4dIII", 5, min(xs), min(ys), max(xs), max(ys), 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        records += struct.pack(">II", i + 1, len(body) // 2) + body
    xs, ys = zip(*[p for ring in polygons for p in ring])
    return struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<II4d4d", 1000, 5, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0) + records


def read_polygons(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``poly, name, edges`` of a shapefile, its attribute table read beside it; a file is bounded by its format (2 GB)."""
    stem = re.sub(r"\.shp$", "", path)
    raw = spark.read.format("binaryFile").load([f"{stem}.shp", f"{stem}.dbf"]).select("path", "content")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {p.rsplit(".", 1)[1].lower(): c for p, c in zip(pdf["path"], pdf["content"])}
        edges, names = polygons_of(part["shp"]), names_of(part["dbf"], field)
        keys = ("x1", "y1", "x2", "y2")
        return pd.DataFrame({"poly": range(len(edges)), "name": names, "edges": [[dict(zip(keys, e)) for e in es] for es in edges]})

    return raw.withColumn("file", F.lit(0)).groupBy("file").applyInPandas(one, "poly long, name string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Rows of a workbook's sheet as text, its first row naming the columns; dates come as day counts.

    The column names are read first, as a schema must be known to plan.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")
    content = bytes(raw.first().content)
    rows = sheet_rows(content, sheet)
    head = [str(c) if c is not None else f"column{i}" for i, c in enumerate(rows[0])] if rows else []
    width = len(head)
    data = [tuple((r + [None] * width)[:width]) for r in rows[1:]]
    return spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in head) or "empty string")


def sheet_rows(raw: bytes, sheet: str) -> list[list[str | None]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(link) for s in book.find("m:sheets", ns)}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(ids)}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[ids[sheet]].lstrip("/")
        page = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    out = []
    for row in page.iter(f"{{{ns['m']}}}row"):
        cells: list[str | None] = []
        for c in row:
            letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
            at = len(cells)
            if letters:
                at = 0
                for ch in letters.group():
                    at = at * 26 + ord(ch) - 64
                at -= 1
            cells += [None] * (at - len(cells))
            v = c.find("m:v", ns)
            if c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
            else:
                cells.append(None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text)
        out.append(cells)
    return out
