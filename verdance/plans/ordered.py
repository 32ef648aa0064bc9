"""Ordered series and segment arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breaks as K
from ..operators import ordered as W
from ..operators import temporal as O
from ..operators.ordered import savgol_rows
from ..functions import bands as B
from ..sources.adapters import camera, scenes, series
from .registry import query, r6, r10

_CAL = """means AS (SELECT site, day, avg(value) AS value FROM series GROUP BY ALL),
 spine AS (SELECT site, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM series GROUP BY site),
 cal AS (SELECT s.site, s.day, m.value FROM spine s LEFT JOIN means m ON s.site = m.site AND s.day = m.day),
 filled AS (SELECT site, day, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM cal)"""


def filled(spark, sf_dir):
    """Daily series of each site on a full calendar, gaps filled."""
    cal = O.daily_mean(series(spark, sf_dir), {"value": F.col("value")}, keys=("site",), fill=True)
    return W.fill_both_ways(cal, ("site",), "day", "value")


@query("SELECT site, day, round(filled, 10) AS filled FROM filled", "series", _CAL)
def ffill_bfill(spark, sf_dir):
    """Gaps filled forward, then backward."""
    return filled(spark, sf_dir).select("site", "day", r10("filled").alias("filled"))


def _savgol_sql() -> str:
    rows = savgol_rows()
    inner = " + ".join(f"{rows[5][k]!r} * lag(filled, {5 - k}) OVER w" if k < 5 else (f"{rows[5][k]!r} * filled" if k == 5 else f"{rows[5][k]!r} * lead(filled, {k - 5}) OVER w") for k in range(11)).replace("np.float64(", "(")
    first = [" + ".join(f"{float(rows[i][k])!r} * nth_value(filled, {k + 1}) OVER u" for k in range(11)) for i in range(5)]
    last = [" + ".join(f"{float(rows[10 - i][10 - k])!r} * nth_value(filled, {k + 1}) OVER d" for k in range(11)) for i in range(5)]
    cases = " ".join(f"WHEN i = {i} THEN {first[i]} WHEN i = n - {i + 1} THEN {last[i]}" for i in range(5))
    return f"""SELECT site, day, round(CASE WHEN n < 11 THEN filled {cases} ELSE {inner} END, 8) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY site) AS n FROM filled)
     WINDOW w AS (PARTITION BY site ORDER BY day), u AS (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), d AS (PARTITION BY site ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query(_savgol_sql(), "series", _CAL)
def savgol_smooth(spark, sf_dir):
    """Savitzky-Golay smoothing over the whole series."""
    return W.savgol(filled(spark, sf_dir), ("site",), "day", "filled").select("site", "day", r6("smooth", 8).alias("smooth"))


@query(
    "SELECT site, year, day, round(CASE WHEN b IS NULL THEN a - filled WHEN a IS NULL THEN filled - b ELSE (a - b) / 2 END, 10) AS slope FROM (SELECT *, lag(filled) OVER w AS b, lead(filled) OVER w AS a FROM (SELECT *, CAST(year(day) AS BIGINT) AS year FROM filled) WINDOW w AS (PARTITION BY site, year ORDER BY day))", "series", _CAL
)
def gradient(spark, sf_dir):
    """First derivative by site and year."""
    f = filled(spark, sf_dir).withColumn("year", F.year("day").cast("long"))
    return W.gradient(f, ("site", "year"), "day", "filled").select("site", "year", "day", r10("slope").alias("slope"))


@query(
    """SELECT site, year, sos_date, pos_date, eos_date, CAST(dayofyear(sos_date) AS BIGINT) AS sos_doy, CAST(dayofyear(pos_date) AS BIGINT) AS pos_doy, CAST(dayofyear(eos_date) AS BIGINT) AS eos_doy, sos_date < pos_date AND pos_date < eos_date AS ordered FROM
    (SELECT site, year, count(*) AS n, stddev_pop(filled) AS sd, first(day ORDER BY round(slope, 9) DESC NULLS LAST, day) AS sos_date, first(day ORDER BY round(filled, 9) DESC, day) AS pos_date, first(day ORDER BY round(slope, 9) ASC NULLS LAST, day) AS eos_date FROM
      (SELECT *, CASE WHEN b IS NULL THEN a - filled WHEN a IS NULL THEN filled - b ELSE (a - b) / 2 END AS slope FROM (SELECT *, lag(filled) OVER w AS b, lead(filled) OVER w AS a FROM (SELECT *, CAST(year(day) AS BIGINT) AS year FROM filled) WINDOW w AS (PARTITION BY site, year ORDER BY day)))
     GROUP BY site, year) WHERE n >= 5 AND sd >= 1e-9""",
    "series", _CAL,
)
def phenology_dates(spark, sf_dir):
    """Start, peak and end of each site's season by year."""
    f = filled(spark, sf_dir).withColumn("year", F.year("day").cast("long"))
    return W.phenology(f, ("site", "year"), "day", "filled")


@query(
    """SELECT site, year, day, round(CASE WHEN b IS NULL THEN a - slope WHEN a IS NULL THEN slope - b ELSE (a - b) / 2 END, 10) AS curve FROM (SELECT *, lag(slope) OVER w AS b, lead(slope) OVER w AS a FROM
    (SELECT site, year, day, CASE WHEN b IS NULL THEN a - filled WHEN a IS NULL THEN filled - b ELSE (a - b) / 2 END AS slope FROM (SELECT *, lag(filled) OVER w AS b, lead(filled) OVER w AS a FROM (SELECT *, CAST(year(day) AS BIGINT) AS year FROM filled) WINDOW w AS (PARTITION BY site, year ORDER BY day)))
     WINDOW w AS (PARTITION BY site, year ORDER BY day))""", "series", _CAL
)
def second_derivative(spark, sf_dir):
    """The derivative of the derivative by site and year."""
    f = filled(spark, sf_dir).withColumn("year", F.year("day").cast("long"))
    slope = W.gradient(f, ("site", "year"), "day", "filled")
    return W.gradient(slope, ("site", "year"), "day", "slope", "curve").select("site", "year", "day", r10("curve").alias("curve"))


_BR = """seg AS (SELECT site, year, 1995 + (year - 1995) + 0.5 AS t_break, CASE WHEN n % 3 = 0 THEN 0.5 ELSE 1.0 END AS prob, m AS magnitude FROM (SELECT site, year(day) AS year, count(*) AS n, avg(value) - 0.45 AS m FROM series GROUP BY site, year(day))),
 hit AS (SELECT site, CAST(t_break AS DOUBLE) AS t_break, magnitude FROM seg WHERE t_break > 1996 AND t_break <= 2000.5 AND prob = 1)"""


@query(
    "SELECT s.site, count(h.t_break) AS n_breaks, min(h.t_break) AS first_break, max(h.t_break) AS last_break, round(first(h.magnitude ORDER BY abs(h.magnitude) DESC, h.t_break), 10) AS max_magnitude, first(h.t_break ORDER BY abs(h.magnitude) DESC, h.t_break) AS max_break FROM (SELECT DISTINCT site FROM series) s LEFT JOIN hit h ON h.site = s.site GROUP BY s.site", "series", _BR
)
def break_stats(spark, sf_dir):
    """Count, first, last and greatest break of each site's segments."""
    year = F.year("day")
    seg = series(spark, sf_dir).groupBy("site", year.alias("year")).agg(F.count("*").alias("n"), (F.avg("value") - 0.45).alias("magnitude"))
    seg = seg.select("site", (F.col("year") + 0.5).cast("double").alias("t_break"), F.when(F.col("n") % 3 == 0, 0.5).otherwise(1.0).alias("prob"), "magnitude")
    arrays = seg.groupBy("site").agg(F.collect_list(F.struct("t_break", "prob", "magnitude")).alias("segments"))
    return K.break_stats(arrays, ("site",), low=1996.0, high=2000.5).withColumn("max_magnitude", r10("max_magnitude"))


@query(
    """SELECT obs, round(c[1] + c[2] * t + c[3] * cos(w * t) + c[4] * sin(w * t) + c[5] * cos(2 * w * t) + c[6] * sin(2 * w * t) + c[7] * cos(3 * w * t) + c[8] * sin(3 * w * t), 6) AS predicted FROM
    (SELECT obs, [0.3 + site / 100.0, 0.0001, 0.05, -0.1, 0.02, 0.01, -0.005, 0.003]::DOUBLE[] AS c, year(day) + (dayofyear(day) - 1.0::DOUBLE) / dayofyear(make_date(year(day), 12, 31)) AS t, 2 * pi() AS w FROM series)""",
    "series",
)
def harmonic_predict(spark, sf_dir):
    """The harmonic model's value at each observation, from given coefficients."""
    coefs = F.array((F.col("site") / 100 + 0.3).cast("double"), *(F.lit(c) for c in (0.0001, 0.05, -0.1, 0.02, 0.01, -0.005, 0.003)))
    return series(spark, sf_dir).select("obs", r6(B.harmonic(coefs, B.fractional_year(F.col("day")))).alias("predicted"))
