"""Hand-computed values for rules that are easy to get wrong, and invariants."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance import app
from verdance.functions import bands as B
from verdance.operators import breaks, cluster, harmonic, imagery, joins, ordered, raster, stats, temporal
from verdance.sources import files

DAY = dt.date(2020, 1, 1)


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x


def test_zero_sum_policies(spark):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    zero = {"r": 0.0, "g": 0.0, "b": 0.0}
    assert one(spark, B.gcc(r, g, b), **zero) is None
    assert one(spark, B.gcc(r, g, b, "add"), **zero) == 0.0 and one(spark, B.gcc(r, g, b, "floor"), **zero) == 0.0
    assert one(spark, B.gcc(r, g, b), r=1.0, g=2.0, b=1.0) == one(spark, B.gcc(r, g, b), r=10.0, g=20.0, b=10.0) == 0.5
    with pytest.raises(ValueError):
        B.gcc(r, g, b, "other")
    with pytest.raises(ValueError):
        B.index("slavi", r, g, b, r)


def test_masks_and_scales(spark):
    q = spark.createDataFrame([(i,) for i in range(16)], "f int").where(B.bits_clear(F.col("f"), 14))
    assert sorted(r.f for r in q.collect()) == [0, 1]
    dn = spark.createDataFrame([(0.0,), (1.0,), (32767.0,), (32768.0,), (65535.0,), (30000.0,)], "d double")
    assert [r.x is None for r in dn.select(B.calibrated(F.col("d")).alias("x")).collect()] == [True, False, False, True, True, False]
    assert [r.x is None for r in dn.select(B.celsius(F.col("d")).alias("x")).collect()] == [True, False, False, False, True, False]
    rd = spark.createDataFrame([(-1.0,), (1.0,), (1.0001,), (0.0,)], "d double")
    assert [r.x for r in rd.select(B.within(F.col("d"), -1, 1).alias("x")).collect()] == [-1.0, 1.0, None, 0.0]
    assert [r.x for r in rd.select(B.within(F.col("d"), -1, 0, True).alias("x")).collect()] == [-1.0, None, None, None]
    nan = files.without_nan(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int"))
    assert nan.agg(F.avg("v"), F.count("v")).first()[:] == (2.0, 1)


def test_solar_elevation(spark):
    for when, want in (((2022, 6, 21, 10, 44), 45.09), ((2022, 12, 21, 10, 42), -1.78)):
        assert abs(one(spark, B.solar_elevation(F.col("t").cast("timestamp_ntz")), t=dt.datetime(*when)) - want) < 0.1


def test_hsv_and_lab(spark):
    h, s, v = B.hsv(F.col("r"), F.col("g"), F.col("b"))
    row = spark.createDataFrame([(0.0, 255.0, 0.0), (128.0, 128.0, 128.0), (0.0, 0.0, 0.0)], "r double, g double, b double").select(h.alias("h"), s.alias("s"), v.alias("v")).collect()
    assert [tuple(r) for r in row] == [(60, 255, 255.0), (0, 0, 128.0), (0, 0, 0.0)]
    white, black = cluster.lab(np.array([[255.0, 255, 255], [0, 0, 0]]))
    assert abs(white - [255, 128, 128]).max() < 0.5 and abs(black - [0, 128, 128]).max() < 0.5


def test_calendar_has_empty_days(spark):
    df = spark.createDataFrame([(1, DAY, 1.0), (1, DAY + dt.timedelta(3), 3.0), (1, DAY, 2.0)], "k int, day date, v double")
    got = temporal.daily_mean(df, {"v": F.col("v")}, keys=("k",), fill=True).orderBy("day").collect()
    assert [r.v for r in got] == [1.5, None, None, 3.0]


def test_sigma_rules_at_equality(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, None), (3, -2.0)], "k int, v double")
    kept = lambda **o: sorted((r.k, r.kept) for r in temporal.beyond_sigma(df, "v", ("k",), **o).where("kept is not null").collect())
    assert kept() == [(1, -1.0), (2, 0.0), (2, 0.0), (3, -2.0)]  # at sigma, zero kept
    assert kept(strict=True) == [(3, -2.0)]
    assert kept(negative=False) == [(1, -1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, -2.0)]
    out = temporal.extent(temporal.beyond_sigma(df, "v", ("k",)), ("k",)).orderBy("k").collect()
    assert [r.extent for r in out] == [0.5, 1.0, 0.5]  # of all rows, NULL ones too


def test_fences_are_strict(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 7, 8)], "k int, v double")
    assert [r.v for r in stats.outside_iqr(df, ("k",), "v", 0.25).orderBy("v").collect()] == [1.0, 8.0]
    mad = stats.outside_mad(df, ("k",), "v", 1.0).orderBy("v").collect()
    assert [r.v for r in mad] == [1.0, 7.0, 8.0]  # median 3.5, deviation 2


def test_p_values():
    for r, n, want in ((0.5, 10, 0.14111), (0.9, 5, 0.03739), (0.0, 20, 1.0), (-0.3, 100, 0.002422)):
        assert abs(stats.p_value(r, n) - want) < 1e-4
    assert stats.p_value(1.0, 5) == 0.0 and stats.p_value(0.3, 2) is None and stats.p_value(None, 9) is None


def series(spark, values, key=1):
    return spark.createDataFrame([(key, DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "k int, day date, v double")


def test_fill_both_ways(spark):
    got = ordered.fill_both_ways(series(spark, [None, 1.0, None, None, 4.0, None]), ("k",), "day", "v").orderBy("day")
    assert [r.filled for r in got.collect()] == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]


def test_savgol_coefficients_and_short_series(spark):
    rows = ordered.savgol_rows() * 429
    assert np.allclose(rows[5], [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]) and np.allclose(rows[0][:4], [339, 144, 24, -36])
    cubic = [float(i**3 - 5 * i) for i in range(20)]
    got = [r.smooth for r in ordered.savgol(series(spark, cubic), ("k",), "day", "v").orderBy("day").collect()]
    assert np.allclose(got, cubic)  # a cubic is its own fit, ends included
    for n in (4, 10, 11):
        v = [float((-1) ** i) for i in range(n)]
        got = [r.smooth for r in ordered.savgol(series(spark, v), ("k",), "day", "v").orderBy("day").collect()]
        assert (got == v) == (n < 11)


def test_gradient_and_phenology(spark):
    v = [0.0, 1.0, 4.0, 9.0, 9.0, 3.0, 2.0]
    got = [r.slope for r in ordered.gradient(series(spark, v), ("k",), "day", "v").orderBy("day").collect()]
    assert got == np.gradient(v).tolist()
    p = ordered.phenology(series(spark, v), ("k",), "day", "v").first()
    assert (p.sos_date.day, p.pos_date.day, p.eos_date.day, p.ordered) == (3, 4, 6, True)  # first of tied peaks
    assert ordered.phenology(series(spark, v[:4]), ("k",), "day", "v").count() == 0
    assert ordered.phenology(series(spark, [1.0] * 8), ("k",), "day", "v").count() == 0


def test_breaks(spark):
    seg = "array<struct<t_break:double,prob:double,magnitude:double>>"
    rows = [(0, []), (1, [(2016.5, 1.0, -0.2)]), (3, [(2020.0, 1.0, 0.3), (2015.0, 1.0, -0.3), (2014.0, 1.0, 9.0), (2018.0, 0.5, 5.0), (2021.0, 1.0, 0.1)])]
    got = {r.k: tuple(r)[1:] for r in breaks.break_stats(spark.createDataFrame(rows, f"k int, segments {seg}"), ("k",)).collect()}
    assert got == {0: (0, None, None, None, None), 1: (1, 2016.5, 2016.5, -0.2, 2016.5), 3: (3, 2015.0, 2021.0, -0.3, 2015.0)}


def test_asof_segment(spark):
    d = lambda n: DAY + dt.timedelta(n)
    segs = spark.createDataFrame([(1, 7, d(0), d(5)), (1, 8, d(10), d(20))], "k int, s int, t_start date, t_end date")
    pts = spark.createDataFrame([(1, d(-1)), (1, d(5)), (1, d(7)), (1, d(30)), (2, d(1))], "k int, day date")
    assert [r.s for r in joins.asof_segment(pts, segs, ("k",)).orderBy("k", "day").collect()] == [7, 7, 8, 8, None]


def chip(spark, grid):
    return spark.createDataFrame([(1, i, j, None if v is None else float(v)) for i, row in enumerate(grid) for j, v in enumerate(row)], "image int, prow long, pcol long, v double")


def test_resampling(spark):
    grid = np.arange(49).reshape(7, 7)
    df = chip(spark, grid)
    got = {(r.brow, r.bcol): r for r in raster.resample(df, ("image",), 3, ("sum", "average", "med", "rms")).collect()}
    assert len(got) == 4 and got[1, 1].sum == grid[3:6, 3:6].sum() and got[0, 0].med == 8.0  # seventh row and column dropped
    assert abs(got[0, 1].rms - math.sqrt((grid[:3, 3:6] ** 2).mean())) < 1e-9
    whole = raster.resample(chip(spark, grid[:6, :6]), ("image",), 3, ("sum",)).agg(F.sum("sum")).first()[0]
    assert whole == grid[:6, :6].sum()
    with pytest.raises(ValueError):
        raster.resample(df, ("image",), 3, ("gauss",))
    for kernel in raster.KERNELS:
        flat = raster.resample_kernel(chip(spark, np.full((8, 8), 5.0)), ("image",), 2, kernel).collect()
        assert len(flat) == 16 and all(abs(r.v - 5) < 1e-9 for r in flat)


def test_resampling_by_resolution(spark):
    df = chip(spark, np.arange(100).reshape(10, 10))
    same = raster.resample_to(df, ("image",), 0.5, 0.5, "average")
    assert same.count() == 100
    odd = raster.resample_to(df, ("image",), 1.0, 2.5, "max").orderBy("brow", "bcol").collect()
    assert len(odd) == 16 and odd[0].v == 22.0 and odd[-1].v == 99.0  # blocks of 3 and 2 pixels
    every = raster.sweep(df, ("image",), 1.0, (2, 5), (*raster.AGGREGATES, "mode", *raster.KERNELS))
    counts = {(r.resolution, r.method): r["count"] for r in every.groupBy("resolution", "method").count().collect()}
    assert len(counts) == 28 and set(counts.values()) == {25, 4}
    for bad in ({"method": "gauss"}, {"method": "max", "projected": False}):
        with pytest.raises(ValueError):
            raster.resample_to(df, ("image",), 1.0, 2.5, **bad)
    with pytest.raises(ValueError):
        raster.resample_to(df, ("image",), 1.0, 0.5, "max")


@pytest.mark.parametrize("scale", [2, 2.5, 5, 0.5])
def test_kernels_are_widened_on_the_way_down(spark, scale):
    rng = np.random.default_rng(7)
    grid = rng.normal(size=(11, 13))
    grid[3, 4] = grid[8, 8:12] = np.nan
    rows = [[None if np.isnan(v) else v for v in r] for r in grid]
    sinc = lambda x: np.sinc(x) * np.sinc(x / 3)
    kernels = {
        "bilinear": (1, lambda x: 1 - x), "lanczos": (3, sinc),
        "cubic": (2, lambda x: np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2)),
    }
    for method, (reach, f) in kernels.items():
        got = {(r.brow, r.bcol): r.v for r in raster.resample_kernel(chip(spark, rows), ("image",), scale, method).collect()}
        assert len(got) == int(11 / scale) * int(13 / scale)
        for (a, b), v in got.items():
            top = bottom = 0.0
            for i in range(11):
                for j in range(13):
                    y, x = (abs((k + 0.5) * scale - 0.5 - p) / max(1, scale) for k, p in ((a, i), (b, j)))
                    if y < reach and x < reach and not np.isnan(grid[i, j]):
                        w = float(f(np.float64(y)) * f(np.float64(x)))
                        top, bottom = top + w * grid[i, j], bottom + w
            assert abs(v - top / bottom) < 1e-7
    near = {(r.brow, r.bcol): r.v for r in raster.resample_kernel(chip(spark, rows), ("image",), scale, "nearest").collect()}
    for (a, b), v in near.items():
        want = grid[int((a + 0.5) * scale), int((b + 0.5) * scale)]
        assert v == want or (v is None and np.isnan(want))


def test_texture_of_constant_and_known_images(spark):
    flat = raster.glcm(raster.grey_levels(chip(spark, np.ones((8, 8))), ("image",)), ("image",)).first()
    assert (flat.contrast, flat.dissimilarity, flat.homogeneity, flat.energy, flat.correlation, flat.asm) == (0, 0, 1, 1, None, 1)
    board = np.indices((8, 8)).sum(0) % 2
    assert raster.glcm(raster.grey_levels(chip(spark, board), ("image",)), ("image",)).first().contrast is None  # 32 pixels above zero
    b = raster.glcm(raster.grey_levels(chip(spark, board), ("image",)), ("image",), least=31).first()
    assert b.contrast == 255**2 and abs(b.correlation + 1) < 1e-9 and b.asm == 0.5
    rng = np.random.default_rng(0)
    grid = rng.normal(size=(6, 5))
    grid[2, 3] = np.nan
    z = np.where(np.isnan(grid), 0, grid - np.nanmean(grid))
    cross = weights = 0
    for i in range(6):
        for j in range(5):
            for a in (-1, 0, 1):
                for c in (-1, 0, 1):
                    if (a or c) and 0 <= i + a < 6 and 0 <= j + c < 5:
                        cross += z[i, j] * z[i + a, j + c]
                        weights += not (np.isnan(grid[i, j]) or np.isnan(grid[i + a, j + c]))
    m = raster.moran(chip(spark, [[None if np.isnan(v) else v for v in row] for row in grid]), ("image",)).first()
    assert abs(m.moran_i_ref - 29 / 8 * cross / (z**2).sum()) < 1e-9 and abs(m.moran_i - 29 / weights * cross / (z**2).sum()) < 1e-9


def test_gap_filling(spark):
    got = {(r.prow, r.pcol): r.v for r in raster.fill_nearest(chip(spark, [[1, None, 3], [None, None, 9], [7, 8, 9]]), ("image",)).collect()}
    assert got[0, 1] == 1.0 and got[1, 0] == 1.0 and got[1, 1] == 9.0
    rng = np.random.default_rng(9)
    grid = np.where(rng.random((19, 14)) < 0.12, rng.normal(size=(19, 14)), np.nan)
    as_rows = lambda g: [[None if np.isnan(v) else v for v in r] for r in g]
    known = sorted((i, j) for i, j in zip(*np.nonzero(~np.isnan(grid))))
    got = {(r.prow, r.pcol): r.v for r in raster.fill_nearest(chip(spark, as_rows(grid)), ("image",)).collect()}
    for i in range(19):
        for j in range(14):
            a, b = min(known, key=lambda k: ((k[0] - i) ** 2 + (k[1] - j) ** 2, k))
            assert got[i, j] == grid[a, b]
    assert all(r.v is None for r in raster.fill_nearest(chip(spark, [[None, None]]), ("image",)).collect())
    assert raster.fill_nearest(chip(spark, [[None]]).limit(0), ("image",)).collect() == []
    plane = np.add.outer(np.arange(6.0), 2 * np.arange(6.0))
    holed = plane.copy()
    holed[2, 2:4] = holed[4, 1] = np.nan
    back = lambda df: np.array([r.v for r in df.orderBy("prow", "pcol").collect()], float)
    for method in ("linear", "cubic"):
        assert np.allclose(back(raster.fill_interpolated(chip(spark, as_rows(holed)), ("image",), method=method)), plane.ravel())
    bent = np.add.outer(np.arange(8.0) ** 3, 2 * np.arange(8.0) ** 2)
    holed8 = bent.copy()
    holed8[3, 4] = np.nan
    assert np.allclose(back(raster.fill_interpolated(chip(spark, as_rows(holed8)), ("image",), method="cubic")), bent.ravel())
    few = np.full((3, 3), np.nan)
    few[0, 0] = 5
    assert (back(raster.fill_interpolated(chip(spark, as_rows(few)), ("image",))) == 5).all()
    kept = chip(spark, as_rows(holed)).withColumn("sea", F.expr("prow = 2 and pcol = 2"))
    assert [(r.prow, r.pcol) for r in raster.fill_interpolated(kept, ("image",), keep="sea").where("v is null").collect()] == [(2, 2)]
    assert [(r.prow, r.pcol) for r in raster.fill_nearest(kept, ("image",), keep="sea").where("v is null").collect()] == [(2, 2)]


def test_samples(spark):
    df = spark.range(20000).withColumn("v", F.col("id") * 2)
    one = stats.draw_rows(df, ("id",), 0.05, 700).collect()
    assert len(one) == 700 and sorted(one) == sorted(stats.draw_rows(df.repartition(5), ("id",), 0.05, 700).collect())
    assert stats.draw_rows(df, ("id",), 0.02, 10**6).count() == 400 and stats.draw_rows(df.limit(3), ("id",), 0.1, 5).count() == 0
    often = stats.draw_rows(spark.range(50), ("id",), 1.0, 50).groupBy("id").count().agg(F.max("count")).first()[0]
    assert often > 1  # with replacement
    assert stats.choose_rows(df, ("id",), 30).distinct().count() == 30


def test_band_expressions(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 0.0)], "x double, y double")
    got = lambda text: [r.z for r in df.select(B.expression(text, a=F.col("x"), b=F.col("y")).alias("z")).collect()]
    assert got("(a - b) / b") == [2.0, None] and got("-a ** 2 + max(a, 2)") == [-6.0, 1.0] and got("a > b") == [True, True]
    for bad in ("c + 1", "a.real", "__import__('os')", "a if b else 1", "(a", "'x'", "sqrt(x=a)"):
        with pytest.raises(ValueError):
            B.expression(bad, a=F.col("x"), b=F.col("y"))


def test_otsu(spark):
    df = spark.createDataFrame([(1, 0.1)] * 50 + [(1, 0.5)] * 50 + [(2, 0.05)] * 5 + [(2, 0.06)] * 5, "k int, gcc double")
    got = {r.k: r.threshold for r in raster.otsu(df, ("k",)).collect()}
    assert got == {1: 0.2, 2: 0.2}
    high = raster.otsu(spark.createDataFrame([(1, 0.3)] * 9 + [(1, 0.6)] * 9, "k int, gcc double"), ("k",)).first().threshold
    assert high == math.floor(0.3 * 255) / 255


def test_spectral_angle(spark):
    u, v = F.col("u"), F.col("v")
    assert one(spark, B.spectral_angle(u, v), u=[0.0, 0.0], v=[1.0, 2.0]) == 90.0
    assert abs(one(spark, B.spectral_angle(u, v), u=[1.0, 0.0], v=[1.0, 1.0]) - 45) < 1e-9


def test_polygon_and_zonal(spark):
    square = [(0.5, 0.5, 20.5, 0.5), (20.5, 0.5, 20.5, 20.5), (20.5, 20.5, 0.5, 20.5), (0.5, 20.5, 0.5, 0.5)]
    edges = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    poly = spark.createDataFrame([("a", square), ("none", [(0.1, 0.1, 0.2, 0.1), (0.2, 0.1, 0.1, 0.2), (0.1, 0.2, 0.1, 0.1)])], f"poly string, edges {edges}")
    pix = spark.range(900).selectExpr("id % 30 as x", "id div 30 as y")
    got = joins.zonal(pix, poly, "x", "y").groupBy("poly").count().collect()
    assert [tuple(r) for r in got] == [("a", 400)]
    touched = joins.zonal(pix, poly, "x", "y", all_touched=True).groupBy("poly").count().collect()
    assert {tuple(r) for r in touched} == {("a", 22 * 22), ("none", 1)}  # the rim runs along pixel borders


def test_harmonic_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(2015, 2020, 200))
    c = np.array([3.0, -0.001, 0.3, -0.2, 0.1, 0.05, -0.02, 0.01])
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, harmonic.predict(t, c))], "k int, t double, value double")
    got = harmonic.harmonic_fit(df, ("k",)).first()
    assert got.n == 200 and got.rmse < 1e-6 and np.allclose(got.coefs[2:], c[2:], atol=1e-6)
    assert harmonic.harmonic_fit(df.limit(5), ("k",)).first().coefs is None
    noisy = df.withColumn("value", F.col("value") + 0.1 * F.rand(3)).unionByName(df.selectExpr("2 as k", "t", "value")).unionByName(df.limit(1).selectExpr("3 as k", "t", "cast(null as double) as value")).cache()
    for penalty in (0.0, 0.002):
        rows = {r.k: r for r in harmonic.harmonic_fit(noisy, ("k",), penalty=penalty).collect()}
        assert rows[3].n == 0 and rows[3].coefs is None and rows[3].rmse is None
        for k in (1, 2):
            part = noisy.where(F.col("k") == k).toPandas()
            x, y = part.t.to_numpy(), part.value.to_numpy()
            assert np.abs(harmonic.predict(x, np.array(rows[k].coefs)) - harmonic.predict(x, harmonic.fit(x, y, penalty))).max() < 1e-5
    lasso = harmonic.fit(t, harmonic.predict(t, c), 0.002)
    assert np.abs(harmonic.predict(t, lasso) - harmonic.predict(t, c)).max() < 0.05


def test_change_detection_finds_a_planted_break(spark):
    rng = np.random.default_rng(2)
    t = np.arange(2014, 2022, 1 / 24)
    y = 0.4 + 0.1 * np.cos(2 * np.pi * t) + rng.normal(0, 0.01, t.size)
    y[t >= 2018.3] -= 0.2
    y[30] += 0.5  # one outlier is no break
    rows = [(1, float(a), float(b)) for a, b in zip(t, y)] + [(2, float(a), float(b)) for a, b in zip(t, 0.4 + rng.normal(0, 0.01, t.size))]
    got = harmonic.ccdc(spark.createDataFrame(rows, "k int, t double, value double"), ("k",)).orderBy("k", "segment").collect()
    broken = [r for r in got if r.t_break is not None]
    assert [r.k for r in broken] == [1] and abs(broken[0].t_break - 2018.3) < 0.1 and abs(broken[0].magnitude + 0.2) < 0.05 and broken[0].prob == 1.0
    assert [r.segment for r in got if r.k == 2] == [1]


def test_clouded_observations_are_screened(spark):
    rng = np.random.default_rng(6)
    t = np.arange(2015, 2020, 1 / 30)
    y = 0.4 + 0.1 * np.cos(2 * np.pi * t) + rng.normal(0, 0.01, t.size)
    swir = 0.2 + rng.normal(0, 0.01, t.size)
    clouds = rng.choice(t.size, 12, replace=False)
    swir[clouds] += 0.3
    assert set(clouds) <= set(np.flatnonzero(harmonic.screened(t, swir[:, None]))) and harmonic.screened(t, swir[:, None]).sum() < 20
    rows = [(1, float(a), float(b), float(c)) for a, b, c in zip(t, y, swir)]
    got = harmonic.ccdc(spark.createDataFrame(rows, "k int, t double, value double, swir double"), ("k",), screen=("swir",)).collect()
    assert len(got) == 1 and got[0].t_break is None and got[0].n <= t.size - 12


def test_clusters():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 0.1, (60, 3)), rng.normal(3, 0.1, (40, 3))
    x = np.concatenate((a, b))
    for labels in (cluster.kmeans(x)[0], cluster.gaussian_mixture(x)[0], cluster.dbscan(x), cluster.spectral(x), cluster.spectral(x, samples=50)):
        assert len(set(labels[:60])) == 1 and len(set(labels[60:])) == 1 and labels[0] != labels[-1]
    many = np.concatenate((rng.normal(0, 0.3, (1200, 3)), rng.normal(4, 0.3, (900, 3))))
    apart = cluster.spectral(many, direct=100)  # by multiplication
    assert len(set(apart[:1200])) == 1 and len(set(apart[1200:])) == 1 and apart[0] != apart[-1]
    loose = rng.normal(0, 1, (400, 4))
    near = np.square(loose[:, None] - loose).sum(2) <= 0.6**2
    core = near.sum(1) >= 6
    names = np.arange(400)
    for _ in range(400):
        names = np.where(core, np.where(near & core, names, 400).min(1).clip(max=names), names)
    want = [names[i] if core[i] else (names[np.flatnonzero(near[i] & core)[0]] if (near[i] & core).any() else -1) for i in range(400)]
    got = cluster.dbscan(loose, 0.6, 6)
    assert len({(a, b) for a, b in zip(got.tolist(), want)}) == len(set(want)) == len(set(got.tolist()))
    noise = cluster.dbscan(np.concatenate((a, [[50.0, 50, 50]])))
    assert noise[-1] == -1 and (noise[:-1] == 0).all()


@pytest.mark.parametrize("method", [*cluster.METHODS, "unknown"])
def test_vegetation_classes(spark, method):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(20):
        for j in range(20):
            r, g, b = (90, 90, 90) if i < 8 else (30, 70, 30) if j < 10 else (80, 190, 60)
            rows.append((1, i, j, *(float(v + rng.integers(0, 6)) for v in (r, g, b))))
    m = cluster.vegetation_classes(spark.createDataFrame(rows, "image int, prow long, pcol long, r double, g double, b double"), method).first()
    assert m.method == ("kmeans" if method == "unknown" else method) and abs(m.green_ratio - 0.6) < 1e-9
    assert abs(m.class1_ratio + m.class2_ratio - m.green_ratio) < 0.02 and 0.2 < m.class1_ratio < 0.4
    assert m.green_mean == m.green_norm


def test_density_classes_of_images_without_two_clusters(spark):
    def image(k, height, width, light):
        at = [(i, j) for i in range(height) for j in range(width)]
        return [(k, i, j, *((80.0, 190.0, 60.0) if light(j) else (30.0, 70.0, 30.0))) for i, j in at]

    # One cluster; noise only (seven rows are half a deviation apart); 96 green pixels are too few for classes.
    rows = image(1, 20, 20, lambda j: False) + image(2, 7, 16, lambda j: j > 5) + image(3, 6, 16, lambda j: j > 5)
    got = {m.image: m for m in cluster.vegetation_classes(spark.createDataFrame(rows, "image int, prow long, pcol long, r double, g double, b double"), "dbscan").collect()}
    for k in (1, 2):
        m = got[k]
        assert (m.class1_ratio, m.class1_mean, m.class1_std, m.class1_norm) == (m.green_ratio, m.green_mean, m.green_std, m.green_norm) and m.green_ratio == 1
        assert m.class2_ratio == m.class2_mean == 0
    assert got[3].green_ratio == 1 and got[3].class1_ratio == got[3].class2_ratio == 0


def test_threshold_of_two_classes_is_the_best_split(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for image in range(6):
        g = rng.integers(1, 200, rng.integers(1, 30)).astype(float)
        rows += [(image, 50.0, float(v), 30.0) for v in g]
        x = np.sort(g / (80 + g + 1e-10))
        cost, best = min((x[:k].var() * k + x[k:].var() * (len(x) - k), k) for k in range(1, len(x))) if len(x) > 1 else (0, 0)
        want[image] = x[0] if not best else x[:best].mean() + 0.6 * (x[best:].mean() - x[:best].mean())
    got = {r.image: r.threshold for r in cluster.kmeans_threshold(spark.createDataFrame(rows, "image int, r double, g double, b double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def exif(text, tag=0x9003):
    body = struct.pack("<HHHII", 1, tag, 2, len(text) + 1, 26) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + body + text.encode() + b"\0"
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


def test_capture_times():
    assert imagery.exif_time(exif("2022:06:21 12:30:00")) == "2022-06-21 12:30:00"
    assert imagery.exif_time(exif("2022:06:21 12:30:00", 0x0132)) == "2022-06-21 12:30:00"
    assert imagery.exif_time(exif("some time in June")) == "some time in June"
    assert imagery.exif_time(b"junk") is None and imagery.exif_time(None) is None


def test_frame_box():
    gray = np.zeros((160, 200))
    gray[40:120, 50:150] = 255
    x1, y1, x2, y2 = imagery.frame_box(gray, least=50, inset=0, sigma=8.0)
    assert max(abs(x1 - 50), abs(y1 - 40), abs(x2 - 150), abs(y2 - 120)) <= 16
    inner = imagery.frame_box(gray, least=50, inset=5, sigma=8.0)
    assert inner == (x1 + 5, y1 + 5, x2 - 5, y2 - 5)
    assert imagery.frame_box(gray, least=10**6, inset=0, sigma=8.0) is None
    assert imagery.frame_box(np.zeros((40, 40))) is None


def png(pixels):
    import zlib

    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    rgb = np.random.default_rng(5).integers(0, 256, (4, 3, 3)).astype(np.uint8)
    (tmp_path / "West").mkdir()
    (tmp_path / "West" / "a.PNG").write_bytes(png(rgb))
    (tmp_path / "bad.jpg").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    got = imagery.pixels_of(files.read_images(spark, str(tmp_path))).orderBy("prow", "pcol").collect()
    assert [(r.r, r.g, r.b) for r in got] == [tuple(map(float, p)) for p in rgb.reshape(-1, 3)]
    assert files.read_bytes(spark, str(tmp_path)).count() == 2


def test_photo_rows_with_failures(spark, tmp_path):
    rgb = np.zeros((4, 5, 3), np.uint8)
    rgb[..., 0], rgb[..., 1], rgb[..., 2] = 30, 90, 30
    rgb[:2] = 80
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "b.jpg").write_bytes(exif("2022:06:21 12:30:00") + b"junk")
    got = imagery.photo_metrics(files.read_images(spark, str(tmp_path), drop_invalid=False), files.read_bytes(spark, str(tmp_path))).orderBy("filename").collect()
    assert [(r.status, r.datetime, r.error) for r in got] == [("ok", None, None), ("failed", "2022-06-21 12:30:00", "Could not read image")]
    assert abs(got[0].green_ratio - 0.5) < 1e-12 and abs(got[0].green_mean - 0.6) < 1e-12 and got[1].green_ratio is None
    out = str(tmp_path / "out")
    for _ in range(2):  # rows are appended
        files.write_table(spark.createDataFrame(got), out, mode="append")
    lines = [x for p in (tmp_path / "out").glob("*.csv") for x in p.read_text().splitlines()]
    assert sum("NA,NA,NA,failed" in x for x in lines) == 2


def test_delimited_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Date;Species;Plot_ID;Total_BVOC;GreenRatio\n2020-01-01;birch;P1;NA;0.5\n2020-01-02;birch;P2;nan;NA\n")
    got = files.read_table(spark, str(tmp_path / "b.csv"), "bvoc", file_name=True).orderBy("Date").collect()
    assert [(r.Total_BVOC, r.GreenRatio, r.source_file) for r in got] == [(None, 0.5, "b.csv"), (None, None, "b.csv")]
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "filename string, green_ratio double")
    files.write_table(df, str(tmp_path / "out"))
    assert "a,NA" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "out"), "closeup_green_ratio").collect())) == [("a", None), ("b", 1.5)]


def test_tiled_rasters(spark, tmp_path):
    px = spark.range(40000).selectExpr("id div 200 as prow", "id % 200 as pcol", "id * 0.5 as v")
    files.write_raster(px, str(tmp_path / "r"), tile=64, parameters={"lambda": 0.002})
    got = files.read_raster(spark, str(tmp_path / "r"), ["v"], (60, 70, 0, 10), 64)
    assert got.count() == 100 and got.columns == ["prow", "pcol", "v"]
    assert len(got.inputFiles()) <= 16 and "PartitionFilters: [" in got._jdf.queryExecution().toString()
    assert spark.read.parquet(str(tmp_path / "r_parameters")).first().value == "0.002"


def test_application(spark):
    obs = spark.createDataFrame([(0, 1, dt.date(1997 + y, 6, 1), 0.4 + 0.1 * (y == 3)) for y in range(4)], "prow long, pcol long, day date, gcc double")
    pred = obs.selectExpr("prow", "pcol", "day", "0.4D as predicted", "0.05D as rmse").unionByName(obs.limit(1).selectExpr("prow", "pcol", "date'2001-01-01' as day", "0.3D as predicted", "0.05D as rmse"))
    s = app.series_at(obs, pred, 45.0, -10.0, (0.0, 0.0, 30.0, 30.0)).orderBy("day").collect()
    assert len(s) == 5 and abs(s[3].rd - 0.25) < 1e-9 and abs(s[3].score - 2) < 1e-9 and s[4].value is None
    m = app.map_on(obs, "2000-06-01").first()
    assert abs(m.rd - 0.25) < 1e-9 and abs(m.predicted - 0.4) < 1e-9


def test_streamed_days_equal_batch(spark, tmp_path):
    from verdance.sources.adapters import camera
    from verdance.streaming import daily

    sf = "/root/testdata/sf0.001"
    want = camera(spark, sf).groupBy("day", "imgroup").agg(F.count("*").alias("n")).collect()
    got = daily.run_batchwise(spark, f"{sf}/events.parquet").select("day", "imgroup", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    daily.append_only(daily.camera_stream(spark, f"{sf}/events.parquet"), out, state).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() > 0
