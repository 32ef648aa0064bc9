"""Scans, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..sources.adapters import camera, chips, read, scenes, series
from .registry import query, r6

BANDS = ("blue", "green", "red", "nir")


@query("SELECT scene, part, day, round(green, 6) AS green FROM scenes WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' AND prow BETWEEN 1 AND 3 AND pcol BETWEEN 2 AND 6", "scenes")
def scene_scan_filter(spark, sf_dir):
    """Half-open time filter and bounding box."""
    inside = (F.col("ts") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("prow").between(1, 3) & F.col("pcol").between(2, 6)
    return scenes(spark, sf_dir).where(inside).select("scene", "part", "day", r6("green").alias("green"))


@query(
    "SELECT scene, count(*) AS n FROM scenes WHERE orbit = 'A' GROUP BY scene HAVING list_contains(list(DISTINCT sensor), 'F')", "scenes"
)
def scene_property_filter(spark, sf_dir):
    """Scenes whose list of sensors holds F, of one orbit."""
    one = scenes(spark, sf_dir).where(F.col("orbit") == "A").groupBy("scene").agg(F.collect_set("sensor").alias("sensors"), F.count("*").alias("n"))
    return one.where(F.array_contains("sensors", "F")).select("scene", "n")


@query("SELECT CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month, count(*) AS n FROM scenes WHERE month(day) BETWEEN 6 AND 8 AND year(day) BETWEEN 1996 AND 1999 GROUP BY 1, 2", "scenes")
def calendar_range(spark, sf_dir):
    """Recurring months within a range of years."""
    d = scenes(spark, sf_dir).select(F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month"))
    return d.where(F.col("month").between(6, 8) & F.col("year").between(1996, 1999)).groupBy("year", "month").agg(F.count("*").alias("n"))


#: Band of each name by sensor; the mapping is data.
SENSOR_BANDS = {"O": {"b2": "blue", "b3": "green", "b4": "red", "b5": "nir"}, "F": {"b1": "blue", "b2": "green", "b3": "red", "b4": "nir"}}


@query(
    """SELECT sensor, scene, part, round(blue, 6) AS b_blue, round(green, 6) AS b_green, round(red, 6) AS b_red FROM scenes WHERE sensor = 'O' AND (fmask & 14) = 0
    UNION ALL SELECT sensor, scene, part, round(blue, 6), round(green, 6), round(red, 6) FROM scenes WHERE sensor = 'F' AND (fmask & 14) = 0""",
    "scenes",
)
def band_rename_union(spark, sf_dir):
    """Two sensors with bands of their own names, brought to common names and joined end to end."""
    out = None
    for sensor, names in SENSOR_BANDS.items():
        raw = scenes(spark, sf_dir).where((F.col("sensor") == sensor) & B.bits_clear(F.col("fmask"), 14))
        raw = raw.select("sensor", "scene", "part", *(F.col(common).alias(own) for own, common in names.items()))
        named = raw.select("sensor", "scene", "part", *(r6(own).alias(f"b_{common}") for own, common in names.items() if common != "nir"))
        out = named if out is None else out.unionByName(named)
    return out


@query("SELECT sensor, count(*) AS n, round(avg(green), 6) AS green FROM scenes WHERE (fmask & 14) = 0 GROUP BY sensor", "scenes")
def qa_bitmask(spark, sf_dir):
    """Pixels whose cloud, shadow and water bits are all clear."""
    return scenes(spark, sf_dir).where(B.bits_clear(F.col("fmask"), 14)).groupBy("sensor").agg(F.count("*").alias("n"), r6(F.avg("green")).alias("green"))


@query("SELECT scene, part, round(green * 2.75e-5 - 0.2, 6) AS green, round(nir * 0.00341802 + 149, 6) AS thermal FROM scenes WHERE (fmask & 31) = 0 AND part % 2 = 0", "scenes")
def landsat_qa_scale(spark, sf_dir):
    """Quality bits 0 to 4 clear and no saturation; optical and thermal bands rescaled."""
    good = scenes(spark, sf_dir).where(B.bits_clear(F.col("fmask"), 31) & (F.col("part") % 2 == 0))
    return good.select("scene", "part", r6(F.col("green") * 2.75e-5 - 0.2).alias("green"), r6(F.col("nir") * 0.00341802 + 149).alias("thermal"))


@query("SELECT scene, part, round(CASE WHEN v > 0 AND v < 1 THEN v END, 6) AS reflectance FROM (SELECT scene, part, nir * 50000 / 32768 AS v FROM scenes)", "scenes")
def dn_calibration(spark, sf_dir):
    """Reflectance of digital numbers, NULL outside (0, 1)."""
    return scenes(spark, sf_dir).select("scene", "part", r6(B.calibrated(F.col("nir") * 50000)).alias("reflectance"))


@query("SELECT scene, part, round(CASE WHEN dn > 0 AND dn <> 65535 THEN dn / 100.0 - 273.15 END, 6) AS celsius FROM (SELECT scene, part, CASE WHEN fmask = 3 THEN 65535 WHEN fmask = 5 THEN 0 ELSE 25000 + green * 5000 END AS dn FROM scenes)", "scenes")
def thermal_celsius(spark, sf_dir):
    """Degrees of thermal numbers with two kinds of missing values."""
    dn = F.when(F.col("fmask") == 3, 65535.0).when(F.col("fmask") == 5, 0.0).otherwise(25000 + F.col("green") * 5000)
    return scenes(spark, sf_dir).select("scene", "part", r6(B.celsius(dn)).alias("celsius"))


@query(
    """SELECT sensor, sum(CAST(background AS BIGINT))::BIGINT AS background, sum(CAST(invalid AND NOT background AS BIGINT))::BIGINT AS invalid, count(*) AS n
    FROM (SELECT sensor, red = 0 OR blue = 0 OR green = 0 AS background, red >= 0.5 OR green >= 0.98 AS invalid FROM scenes) GROUP BY sensor""",
    "scenes",
)
def validity_masks(spark, sf_dir):
    """Background where any band is zero; invalid pixels besides."""
    zero = F.greatest(*((F.col(b) == 0).cast("int") for b in ("red", "blue", "green"))) == 1
    m = scenes(spark, sf_dir).select("sensor", zero.alias("b"), ((F.col("red") >= 0.5) | (F.col("green") >= 0.98)).alias("i"))
    return m.groupBy("sensor").agg(F.count_if("b").alias("background"), F.count_if(F.col("i") & ~F.col("b")).alias("invalid"), F.count("*").alias("n"))


@query(
    "SELECT s.prow, s.pcol, count(green) AS n, round(avg(green), 6) AS green FROM (SELECT s.prow, s.pcol, CASE WHEN m.water <> 0 THEN s.green END AS green FROM scenes s JOIN mask m ON s.prow = m.prow AND s.pcol = m.pcol) s GROUP BY s.prow, s.pcol",
    "scenes", "mask AS (SELECT DISTINCT prow, pcol, CASE WHEN (prow * 10 + pcol) % 7 = 0 THEN 0 ELSE 1 END AS water FROM scenes)",
)
def water_mask(spark, sf_dir):
    """A static mask of one row per pixel of the raster blanks water.

    The mask has as many rows as the raster has pixels; Catalyst broadcasts it only below its size threshold.
    """
    s = scenes(spark, sf_dir)
    mask = s.select("prow", "pcol").distinct().withColumn("water", F.when((F.col("prow") * 10 + F.col("pcol")) % 7 == 0, 0).otherwise(1))
    wet = s.join(mask, ["prow", "pcol"]).withColumn("green", F.when(F.col("water") != 0, F.col("green")))
    return wet.groupBy("prow", "pcol").agg(F.count("green").alias("n"), r6(F.avg("green")).alias("green"))


@query("SELECT site, count(*) AS n, count(value) AS valid FROM series WHERE value IS NULL OR value BETWEEN 0.2 AND 0.8 GROUP BY site", "series")
def invalid_row_drop(spark, sf_dir):
    """A value out of range takes its whole row with it."""
    v = F.col("value")
    return series(spark, sf_dir).where(v.isNull() | v.between(0.2, 0.8)).groupBy("site").agg(F.count("*").alias("n"), F.count("value").alias("valid"))


@query("SELECT obs, site, day, round(value, 6) AS value FROM series WHERE month(day) IN (6, 7, 8) AND site IN (1, 5, 9)", "series")
def summer_filter(spark, sf_dir):
    """List filters on month and site."""
    return series(spark, sf_dir).where(F.month("day").isin(6, 7, 8) & F.col("site").isin(1, 5, 9)).select("obs", "site", "day", r6("value").alias("value"))


@query("SELECT imgroup, count(*) AS n FROM camera WHERE NOT (ts > TIMESTAMP '2024-01-17' AND contains(imgroup, 'West')) GROUP BY imgroup", "camera")
def exclude_after_date_group(spark, sf_dir):
    """Negated compound predicate with a substring."""
    late = (F.col("ts") > F.lit("2024-01-17").cast("timestamp_ntz")) & F.col("imgroup").contains("West")
    return camera(spark, sf_dir).where(~late).groupBy("imgroup").agg(F.count("*").alias("n"))


_SUN = """sun AS (SELECT image, imgroup, CAST(epoch_us(ts + INTERVAL 150 DAY) AS DOUBLE) / 86400e6 - 10957.5 AS n FROM camera),
 s2 AS (SELECT *, radians(357.528 + 0.9856003 * n) AS g, radians(23.439 - 4e-7 * n) AS eps FROM sun),
 s3 AS (SELECT *, radians(280.460 + 0.9856474 * n + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS lam FROM s2),
 s4 AS (SELECT *, degrees(atan2(cos(eps) * sin(lam), cos(lam))) AS alpha, asin(sin(eps) * sin(lam)) AS delta FROM s3),
 s5 AS (SELECT *, radians(15 * (18.697374558 + 24.06570982441908 * n) + 19.051 - alpha) AS h, radians(68.348) AS phi FROM s4),
 s6 AS (SELECT *, degrees(asin(sin(phi) * sin(delta) + cos(phi) * cos(delta) * cos(h))) AS el FROM s5)"""


@query("SELECT imgroup, count(*) AS n, round(max(el), 3) AS highest FROM s6 WHERE el > 5 GROUP BY imgroup", "camera", _SUN)
def daylight_filter(spark, sf_dir):
    """Frames taken with the sun more than five degrees up (150 days on: the test frames are of polar night)."""
    lit = camera(spark, sf_dir).withColumn("el", B.solar_elevation(F.col("ts") + F.expr("INTERVAL 150 DAY"))).where(F.coalesce(F.col("el") > 5, F.lit(False)))
    return lit.groupBy("imgroup").agg(F.count("*").alias("n"), F.round(F.max("el"), 3).alias("highest"))


@query("SELECT image, imgroup, CASE WHEN plot % 3 = 0 THEN NULL ELSE plot END AS plot FROM camera WHERE (CASE WHEN green_ratio < 0.5 THEN green_ratio END) IS NOT NULL", "camera")
def dropna_subset(spark, sf_dir):
    """Rows with a value in the named column; NULLs elsewhere stay."""
    c = camera(spark, sf_dir).select("image", "imgroup", F.when(F.col("plot") % 3 != 0, F.col("plot")).alias("plot"), F.when(F.col("green_ratio") < 0.5, F.col("green_ratio")).alias("g"))
    return c.na.drop(subset=["g"]).drop("g")


@query(
    "SELECT sensor, round(min(pcol) * 30e0 + 500000, 6) AS x_min, round((max(pcol) + 1) * 30e0 + 500000, 6) AS x_max, round(7500000 - (max(prow) + 1) * 30e0, 6) AS y_min, round(7500000 - min(prow) * 30e0, 6) AS y_max FROM scenes GROUP BY sensor", "scenes"
)
def raster_extent(spark, sf_dir):
    """Extent from an affine transform with 30 m pixels."""
    x, y = F.col("pcol") * 30.0 + 500000, 7500000 - F.col("prow") * 30.0
    return scenes(spark, sf_dir).groupBy("sensor").agg(r6(F.min(x)).alias("x_min"), r6(F.max(x) + 30).alias("x_max"), r6(F.min(y) - 30).alias("y_min"), r6(F.max(y)).alias("y_max"))


@query("SELECT scene, part, round(green / nullif(red + green + blue, 0), 6) AS gcc, round(green / (red + green + blue + 1e-10), 6) AS gcc_add, round(red / greatest(red + blue, 1e-10), 6) AS red_floor FROM scenes", "scenes")
def gcc(spark, sf_dir):
    """Green chromatic coordinate under three policies for a zero sum."""
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    return scenes(spark, sf_dir).select("scene", "part", r6(B.gcc(r, g, b)).alias("gcc"), r6(B.gcc(r, g, b, "add")).alias("gcc_add"), r6(B.gcc(b, r, F.lit(0.0), "floor")).alias("red_floor"))


@query(
    """SELECT scene, part, round((nir - red) / nullif(nir + red, 0), 6) AS ndvi, CASE WHEN abs(nir + 6 * red - 7.5 * blue + 1) > 1e-6 THEN round(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1), 4) END AS evi,
    round((nir - green) / nullif(nir + green, 0), 6) AS gndvi, round((2 * green - blue - red) / nullif(2 * green + blue + red, 0), 6) AS gli,
    round(green / nullif(red + green + blue, 0), 6) AS gcc, CASE WHEN abs(blue + nir - 2 * green) > 1e-6 THEN round((blue - nir) / (blue + nir - 2 * green), 4) END AS lai FROM scenes""",
    "scenes",
)
def veg_indices(spark, sf_dir):
    """All indices of the registry; one whose denominator nearly vanishes is NULL."""
    b, g, r, n = (F.col(x) for x in BANDS)
    near_zero = {"evi": n + 6 * r - 7.5 * b + 1, "lai": b + n - 2 * g}
    column = lambda name: F.round(B.index(name, b, g, r, n), 4 if name in near_zero else 6)
    safe = lambda name: F.when(F.abs(near_zero[name]) > 1e-6, column(name)) if name in near_zero else column(name)
    return scenes(spark, sf_dir).select("scene", "part", *(safe(name).alias(name) for name in B.INDICES))


@query(
    "SELECT scene, part, round(pow(10.0, vh / 10) / pow(10.0, vv / 10), 6) AS linear_ratio, round(vh / nullif(vv, 0), 6) AS db_ratio FROM (SELECT scene, part, -35 + 30 * green AS vv, -30 + 20 * red AS vh FROM scenes) WHERE vv >= -30", "scenes"
)
def radar_ratio(spark, sf_dir):
    """Radar ratio of powers and of decibels, without edge pixels below -30 dB."""
    s = scenes(spark, sf_dir).select("scene", "part", (-35 + 30 * F.col("green")).alias("vv"), (-30 + 20 * F.col("red")).alias("vh")).where("vv >= -30")
    return s.select("scene", "part", r6(B.radar_ratio(F.col("vv"), F.col("vh"))).alias("linear_ratio"), r6(B.radar_ratio(F.col("vv"), F.col("vh"), False)).alias("db_ratio"))


@query("SELECT obs, round(ln(value), 6) AS ln_value, round(ln(1 + value), 6) AS ln1p_value, round(value * 1000 / 1000.0, 10) AS unit, CASE WHEN value >= 0.5 THEN 1 ELSE 0 END::BIGINT AS high FROM series WHERE value > 0", "series")
def log_transform(spark, sf_dir):
    """Logarithms and unit conversion."""
    v = F.col("value")
    return series(spark, sf_dir).where(v > 0).select("obs", r6(F.ln(v)).alias("ln_value"), r6(F.log1p(v)).alias("ln1p_value"), r6(v * 1000 / 1000, 10).alias("unit"), (v >= 0.5).cast("long").alias("high"))


@query("SELECT scene, part, round((nir - green) / nullif(nir + green, 0), 6) AS a, round(2.5 * (nir - 0.1::DOUBLE) + pow(green, 2), 10) AS b FROM scenes", "scenes")
def band_expression(spark, sf_dir):
    """Bands computed from expressions given as text."""
    s = scenes(spark, sf_dir)
    first = B.expression("(near - g) / (near + g)", near=F.col("nir"), g=F.col("green"))
    second = B.expression("2.5 * (near - floor_) + g ** 2", near=F.col("nir"), g=F.col("green"), floor_=F.lit(0.1))
    return s.select("scene", "part", r6(first).alias("a"), r6(second, 10).alias("b"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS last_part, CASE WHEN len(string_split(url, '/')) >= 3 THEN list_extract(string_split(url, '/'), -3) END AS camera_group FROM pages")
def path_parts(spark, sf_dir):
    """Parts of a path counted from its end."""
    parts = F.split("url", "/")
    return read(spark, sf_dir, "pages").select("page_id", F.try_element_at(parts, F.lit(-1)).alias("last_part"), F.try_element_at(parts, F.lit(-3)).alias("camera_group"))


@query(
    "SELECT scene, part, CAST(try_strptime(replace(string_split(name, '_')[3], '.tif', ''), '%Y-%m-%d') AS DATE) AS day FROM (SELECT scene, part, CASE WHEN fmask = 7 THEN 'GCC_site_none.tif' ELSE 'GCC_site_' || strftime(day, '%Y-%m-%d') || '.tif' END AS name FROM scenes)", "scenes"
)
def filename_date(spark, sf_dir):
    """Date of a file name; NULL if it holds none."""
    name = F.when(F.col("fmask") == 7, "GCC_site_none.tif").otherwise(F.concat(F.lit("GCC_site_"), F.date_format("day", "yyyy-MM-dd"), F.lit(".tif")))
    s = scenes(spark, sf_dir).select("scene", "part", name.alias("name"))
    return s.select("scene", "part", F.try_to_date(F.replace(F.try_element_at(F.split("name", "_"), F.lit(3)), F.lit(".tif"), F.lit("")), "yyyy-MM-dd").alias("day"))


@query(
    "SELECT image, CAST(try_strptime(string_split(replace(name, ' ', '_'), '_')[1], '%d-%m-%Y') AS DATE) AS day, split_part(split_part(replace(name, ' ', '_'), '_', 2), '.', 1) AS grp, substr(split_part(replace(name, ' ', '_'), '_', 2), 1, 1) AS letter FROM (SELECT image, strftime(day, '%d-%m-%Y') || CASE WHEN image % 2 = 0 THEN ' ' ELSE '_' END || imgroup || '.JPG' AS name FROM camera)", "camera"
)
def filename_group(spark, sf_dir):
    """Date, group and letter of names such as 31-12-2020_West.JPG, a space for the line allowed."""
    name = F.concat(F.date_format("day", "dd-MM-yyyy"), F.when(F.col("image") % 2 == 0, " ").otherwise("_"), F.col("imgroup"), F.lit(".JPG"))
    c = camera(spark, sf_dir).select("image", F.replace(name, F.lit(" "), F.lit("_")).alias("name"))
    token = F.split_part("name", F.lit("_"), F.lit(2))
    return c.select("image", F.try_to_date(F.split_part("name", F.lit("_"), F.lit(1)), "dd-MM-yyyy").alias("day"), F.split_part(token, F.lit("."), F.lit(1)).alias("grp"), F.substr(token, F.lit(1), F.lit(1)).alias("letter"))


@query("SELECT image, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS dom, CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute FROM camera", "camera")
def date_parts(spark, sf_dir):
    """Calendar parts of a time."""
    parts = {"year": F.year, "month": F.month, "dom": F.dayofmonth, "doy": F.dayofyear, "hour": F.hour, "minute": F.minute}
    return camera(spark, sf_dir).select("image", *(f("ts").cast("long").alias(n) for n, f in parts.items()))


@query("SELECT CAST(make_timestamp(ms * 1000) AS DATE) AS day, round(avg(v), 6) AS v, count(*) AS n FROM (SELECT epoch_ms(ts) AS ms, green_ratio AS v FROM camera) GROUP BY 1", "camera")
def epoch_daily(spark, sf_dir):
    """Daily means of a series timed in epoch milliseconds."""
    ms = camera(spark, sf_dir).select(B.utc_millis(F.col("ts")).alias("ms"), "green_ratio")
    return ms.groupBy(B.utc_day(F.col("ms")).alias("day")).agg(r6(F.avg("green_ratio")).alias("v"), F.count("*").alias("n"))


#: Wavelengths (nm) of the bands.
WAVELENGTHS = {"blue": 475, "green": 560, "red": 668, "nir": 842}


@query(
    "SELECT band, CASE band WHEN 'blue' THEN 475 WHEN 'green' THEN 560 WHEN 'red' THEN 668 WHEN 'nir' THEN 842 END::BIGINT AS wavelength, round(avg(v), 6) AS mean FROM (UNPIVOT (SELECT blue, green, red, nir FROM scenes) ON blue, green, red, nir INTO NAME band VALUE v) GROUP BY band", "scenes"
)
def recode_map(spark, sf_dir):
    """Band names recoded to wavelengths by a map."""
    codes = F.create_map(*(x for k, v in WAVELENGTHS.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    long = scenes(spark, sf_dir).select(*BANDS).unpivot([], list(BANDS), "band", "v")
    return long.groupBy("band").agg(r6(F.avg("v")).alias("mean")).select("band", F.try_element_at(codes, F.col("band")).alias("wavelength"), "mean")


@query("SELECT image, pos, round((v - avg(v) OVER (PARTITION BY image)) / nullif(stddev_pop(v) OVER (PARTITION BY image), 0), 5) AS z FROM chips", "chips")
def standard_scale(spark, sf_dir):
    """Values scaled by mean and population deviation of their image."""
    from pyspark.sql import Window

    w = Window.partitionBy("image")
    return chips(spark, sf_dir).select("image", "pos", F.round(B.ratio(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)), 5).alias("z"))


_RGB = """rgb AS (SELECT image, prow, pcol, 1.0 * ((pos * 37 + image * 11) % 256) AS r, CAST(floor(least(255, greatest(0, v * 600 + 128))) AS DOUBLE) AS g, 1.0 * ((pos * 91 + image * 7) % 200) AS b FROM chips)"""


@query(
    """SELECT image, round(avg(CASE WHEN h BETWEEN 35 AND 85 AND s BETWEEN 40 AND 255 AND v BETWEEN 40 AND 255 THEN 1.0 ELSE 0.0 END), 6) AS green_ratio FROM
    (SELECT image, CAST(round(hh / 2) AS INT) % 180 AS h, CAST(round(CASE WHEN v = 0 THEN 0 ELSE 255 * span / nullif(v, 0) END) AS INT) AS s, v FROM
      (SELECT *, CASE WHEN hue < 0 THEN hue + 360 ELSE hue END AS hh FROM
        (SELECT *, CASE WHEN span = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / nullif(span, 0) WHEN v = g THEN 120 + 60 * (b - r) / nullif(span, 0) ELSE 240 + 60 * (r - g) / nullif(span, 0) END AS hue FROM
          (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS span FROM rgb)))) GROUP BY image""",
    "chips", _RGB,
)
def hsv_green_ratio(spark, sf_dir):
    """Share of pixels in a box of hue, saturation and value."""
    h, s, v = B.hsv(F.col("r"), F.col("g"), F.col("b"))
    green = h.between(35, 85) & s.between(40, 255) & v.between(40, 255)
    return rgb(spark, sf_dir).groupBy("image").agg(r6(F.avg(green.cast("double"))).alias("green_ratio"))


def rgb(spark, sf_dir):
    """Chips as 8-bit colour images."""
    c = chips(spark, sf_dir)
    g = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("v") * 600 + 128))).cast("double")
    return c.select("image", "prow", "pcol", ((F.col("pos") * 37 + F.col("image") * 11) % 256).cast("double").alias("r"), g.alias("g"), ((F.col("pos") * 91 + F.col("image") * 7) % 200).cast("double").alias("b"))
