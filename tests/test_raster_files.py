import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import joins
from verdance.sources import rasters as R


@pytest.mark.parametrize("n", [0, 1, 300, 70000])
@pytest.mark.parametrize("kind", ["zeros", "few", "random"])
def test_lzw_round_trip(n, kind):
    rng = np.random.default_rng(n)
    data = bytes(n) if kind == "zeros" else rng.integers(0, 3 if kind == "few" else 256, n).astype(np.uint8).tobytes()
    assert R.lzw_decode(R.lzw_encode(data)) == data


def test_geotiff_round_trip_and_placement():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2, 70, 45)).astype(np.float32)
    a[0, 3, 4] = np.nan
    got = R.decode_tiff(R.encode_tiff(R.Raster(a, 5e5, 7.5e6, 30.0, 30.0, -9999.0), 32))
    assert np.array_equal(got.bands, a, equal_nan=True) and (got.x0, got.y0, got.px, got.py, got.nodata) == (5e5, 7.5e6, 30.0, 30.0, -9999.0)


def plain_tiff(a, compression, predictor):
    """A two-strip big-endian 16-bit image with interleaved bands."""
    h, w, n = a.shape
    strips = []
    for part in (a[: h // 2], a[h // 2 :]):
        p = np.diff(part, axis=1, prepend=0) if predictor == 2 else part
        raw = p.astype(">u2").tobytes()
        strips.append(raw if compression == 1 else zlib.compress(raw) if compression == 8 else R.lzw_encode(raw))
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16] * n), (259, 3, [compression]), (262, 3, [1]), (273, 4, [0, 0]), (277, 3, [n]), (278, 3, [h // 2]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
    at = 8
    places = []
    for s in strips:
        places.append(at)
        at += len(s)
    entries[5] = (273, 4, places)
    extra_at, body, extra = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        data = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        body += struct.pack(">HHI", tag, kind, len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", extra_at + len(extra)))
        extra += data if len(data) > 4 else b""
    return b"MM\0*" + struct.pack(">I", at) + b"".join(strips) + struct.pack(">H", len(entries)) + body + struct.pack(">I", 0) + extra


@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize("predictor", [1, 2])
def test_strips(compression, predictor):
    a = np.random.default_rng(2).integers(0, 65536, (10, 7, 3))
    assert np.array_equal(R.decode_tiff(plain_tiff(a, compression, predictor)).bands, a.transpose(2, 0, 1))


def test_windows_are_parts_of_the_whole():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2, 70, 45)).astype(np.float32)
    raw = R.encode_tiff(R.Raster(a, 5e5, 7.5e6, 30.0, 30.0, None), 16)
    strips = plain_tiff(rng.integers(0, 65536, (10, 7, 3)), 8, 2)
    whole = R.decode_tiff(strips).bands

    class Counted:
        read = 0

        def __getitem__(self, part):
            Counted.read += part.stop - part.start
            return raw[part]

    for w in ((0, 70, 0, 45), (3, 20, 17, 31), (64, 70, 40, 45), (69, 99, 0, 1), (16, 32, 16, 32)):
        got = R.decode_tiff(raw, w)
        assert np.array_equal(got.bands, a[:, w[0] : w[1], w[2] : w[3]]) and (got.x0, got.y0) == (5e5 + 30 * w[2], 7.5e6 - 30 * w[0])
    for w in ((0, 5, 0, 7), (4, 9, 2, 3)):
        assert np.array_equal(R.decode_tiff(strips, w).bands, whole[:, w[0] : w[1], w[2] : w[3]])
    R.decode_tiff(Counted(), (0, 10, 0, 10))
    assert Counted.read < len(raw) / 5  # one tile of fifteen in each band, and the header


def test_big_tiff():
    a = np.arange(12, dtype=np.uint16).reshape(3, 4)
    entries = [(256, 3, [4]), (257, 3, [3]), (258, 3, [16]), (259, 3, [1]), (273, 16, [16]), (277, 3, [1]), (278, 3, [3]), (279, 16, [24])]
    body = b"".join(struct.pack("<HHQ", t, k, len(v)) + struct.pack("<H" if k == 3 else "<Q", *v).ljust(8, b"\0") for t, k, v in entries)
    raw = b"II" + struct.pack("<HHHQ", 43, 8, 0, 40) + a.tobytes() + struct.pack("<Q", len(entries)) + body + struct.pack("<Q", 0)
    assert np.array_equal(R.decode_tiff(raw).bands[0], a)


def test_npy_round_trip(spark, tmp_path):
    df = spark.range(24).selectExpr("id div 12 as k", "(id % 12) div 4 as i", "id % 4 as j", "if(id = 5, null, id * 0.5D) as v")
    for r in R.npys(df, "k", ("i", "j")).collect():
        (tmp_path / f"{r.k}.npy").write_bytes(r.content)
    got = R.read_npy(spark, str(tmp_path), ("i", "j"))
    back = got.selectExpr("cast(substring(file, -5, 1) as long) as k", "i", "j", "v")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_geotiff_tables(spark, tmp_path):
    px = spark.range(600).selectExpr("id div 300 as image", "(id % 300) div 20 as prow", "id % 20 as pcol", "if(id = 7, null, id * 0.25D) as v")
    for r in R.geotiffs(px, "image", ["v"], 100.0, 200.0, 10.0, 10.0, 16).collect():
        (tmp_path / f"{r.image}.tif").write_bytes(r.content)
    (tmp_path / "bad.tif").write_bytes(b"II*\0 no")
    got = R.read_geotiff(spark, str(tmp_path), {1: "v"})
    assert got.count() == 600 and got.agg(F.sum("v")).first()[0] == px.agg(F.sum("v")).first()[0]
    part = R.read_geotiff(spark, str(tmp_path), {1: "v"}, window=(2, 9, 3, 20), size=5)
    assert sorted(map(str, part.collect())) == sorted(map(str, got.where("prow >= 2 and prow < 9 and pcol >= 3").collect()))
    one = got.where("file like '%0.tif' and prow = 2 and pcol = 3").first()
    assert (one.x, one.y, one.v) == (135.0, 175.0, 43 * 0.25) and got.where("v is null").count() == 1


def test_npy(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    a[1, 2, 3] = np.nan
    np.save(tmp_path / "rd.npy", a)
    got = R.read_npy(spark, str(tmp_path), ("year", "prow", "pcol"), "rd")
    assert got.where("year = 1 and prow = 0 and pcol = 2").first().rd == 14.0 and got.where("rd is null").count() == 1 and got.count() == 24


def test_shapefile(spark, tmp_path):
    rings = [[(0.5, 0.5), (9.5, 0.5), (9.5, 9.5), (0.5, 9.5), (0.5, 0.5)], [(20.0, 20.0), (21.0, 20.0), (20.0, 21.0), (20.0, 20.0)]]
    (tmp_path / "p.shp").write_bytes(R.encode_polygons(rings))
    width, names = 10, ["birch", "bog"]
    head = 32 + 32 + 1
    dbf = struct.pack("<4BIHH20x", 3, 120, 1, 1, 2, head, width + 1) + b"Classname".ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) + b"\r"
    (tmp_path / "p.dbf").write_bytes(dbf + b"".join(b" " + n.encode().ljust(width) for n in names))
    got = R.read_polygons(spark, str(tmp_path / "p.shp"), "Classname")
    assert [(r.poly, r.name, len(r.edges)) for r in got.orderBy("poly").collect()] == [(0, "birch", 4), (1, "bog", 3)]
    pix = spark.range(400).selectExpr("id % 20 as x", "id div 20 as y")
    assert joins.zonal(pix, got.select("poly", "edges"), "x", "y").count() == 81


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="all" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>date</t></si><si><t>total</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>2020-06-01</t></is></c><c r="B2"><v>12.5</v></c></row><row><c r="B3"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "i.xlsx").write_bytes(raw.getvalue())
    assert list(map(tuple, R.read_sheet(spark, str(tmp_path / "i.xlsx"), "all").collect())) == [("2020-06-01", "12.5"), (None, "3")]
    with pytest.raises(ValueError):
        R.read_sheet(spark, str(tmp_path / "i.xlsx"), "none")
