"""Column expressions over band, quality and camera columns.

Missing values are NULL throughout; :func:`no_nan` is applied where data enters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OMEGA = 2 * math.pi


def no_nan(x: Column) -> Column:
    """NULL for NaN, so that aggregates skip it and comparisons are false."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return a / F.nullif(b, F.lit(0.0))


def gcc(red: Column, green: Column, blue: Column, policy: str = "null") -> Column:
    """Green share of the three visible bands; ``policy`` says what a zero sum gives.

    null: NULL.  add: 1e-10 is added to the sum.  floor: the sum is 1e-10 at least.
    """
    total = red + green + blue
    if policy == "null":
        return ratio(green, total)
    if policy == "add":
        return green / (total + F.lit(1e-10))
    if policy == "floor":
        return green / F.greatest(total, F.lit(1e-10))
    raise ValueError(f"unknown policy {policy!r}")


#: name -> expression of (blue, green, red, nir)
INDICES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "ndvi": lambda b, g, r, n: ratio(n - r, n + r),
    "evi": lambda b, g, r, n: ratio(2.5 * (n - r), n + 6 * r - 7.5 * b + 1),
    "gndvi": lambda b, g, r, n: ratio(n - g, n + g),
    "gli": lambda b, g, r, n: ratio(2 * g - b - r, 2 * g + b + r),
    "gcc": lambda b, g, r, n: gcc(r, g, b),
    "lai": lambda b, g, r, n: ratio(b - n, b + n - 2 * g),
}


def index(name: str, blue: Column, green: Column, red: Column, nir: Column) -> Column:
    """A vegetation index by name; unknown names are an error."""
    if name.lower() not in INDICES:
        raise ValueError(f"unknown index {name!r}; known: {', '.join(INDICES)}")
    return INDICES[name.lower()](blue, green, red, nir)


def bits_clear(flags: Column, mask: int) -> Column:
    """Whether none of the mask's bits is set."""
    return flags.bitwiseAND(F.lit(mask)) == 0


def calibrated(dn: Column, scale: float = 32768.0) -> Column:
    """Reflectance of a digital number; NULL outside (0, 1)."""
    v = dn / F.lit(scale)
    return F.when((v > 0) & (v < 1), v)


def celsius(dn: Column) -> Column:
    """Degrees of a thermal digital number; NULL for the missing value 65535 and below 1."""
    return F.when((dn > 0) & (dn != 65535), dn / F.lit(100.0) - F.lit(273.15))


def within(x: Column, low: float, high: float, open_high: bool = False) -> Column:
    """The value where it lies in the range, else NULL."""
    return F.when((x >= low) & ((x < high) if open_high else (x <= high)), x)


def radar_ratio(vv: Column, vh: Column, linear: bool = True) -> Column:
    """VH to VV: of powers, or of decibels as they are."""
    return F.pow(F.lit(10.0), vh / 10) / F.pow(F.lit(10.0), vv / 10) if linear else ratio(vh, vv)


def relative_deviation(observed: Column, predicted: Column) -> Column:
    return ratio(observed - predicted, predicted)


def condition_score(observed: Column, predicted: Column, rmse: Column) -> Column:
    return ratio(observed - predicted, rmse)


def fractional_year(ts: Column) -> Column:
    """Year plus the elapsed share of its days."""
    days = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    return F.year(ts) + (F.dayofyear(ts) - 1) / days


def harmonic_basis(t: Column, omega: float = OMEGA) -> list[Column]:
    """1, t and cosine and sine of one, two and three times the yearly frequency."""
    waves = [f(t * F.lit(k * omega)) for k in (1, 2, 3) for f in (F.cos, F.sin)]
    return [F.lit(1.0), t, *waves]


def harmonic(coefs: Column, t: Column, omega: float = OMEGA) -> Column:
    """The model value of eight coefficients at ``t``."""
    return F.aggregate(F.zip_with(coefs, F.array(*harmonic_basis(t, omega)), lambda c, x: c * x), F.lit(0.0), lambda s, x: s + x)


def utc(ts: Column) -> Column:
    """The instant of a time without zone that is meant as UTC, whatever the session's zone."""
    return F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts), F.lit("UTC"))


def utc_millis(ts: Column) -> Column:
    return F.unix_millis(utc(ts))


def utc_day(millis: Column) -> Column:
    """The UTC date of epoch milliseconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / F.lit(86400000)).cast("int"))


def solar_elevation(ts: Column, latitude: float = 68.348, longitude: float = 19.051) -> Column:
    """Degrees of the sun above the horizon (almanac's low-precision form; times are UTC)."""
    n = F.unix_micros(utc(ts)) / F.lit(86400e6) - F.lit(10957.5)
    g = F.radians(357.528 + 0.9856003 * n)
    lam = F.radians(280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    eps = F.radians(23.439 - 4e-7 * n)
    alpha = F.degrees(F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam)))
    delta = F.asin(F.sin(eps) * F.sin(lam))
    hour = F.radians(15 * (18.697374558 + 24.06570982441908 * n) + longitude - alpha)
    phi = F.radians(F.lit(latitude))
    return F.degrees(F.asin(F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.cos(hour)))


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 179), saturation and value (0 to 255) of 8-bit bands."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = top - low
    hue = (
        F.when(span == 0, F.lit(0.0))
        .when(top == red, 60 * (green - blue) / F.nullif(span, F.lit(0.0)))
        .when(top == green, 120 + 60 * (blue - red) / F.nullif(span, F.lit(0.0)))
        .otherwise(240 + 60 * (red - green) / F.nullif(span, F.lit(0.0)))
    )
    hue = F.when(hue < 0, hue + 360).otherwise(hue) / 2
    sat = F.when(top == 0, F.lit(0.0)).otherwise(255 * span / F.nullif(top, F.lit(0.0)))
    return F.round(hue).cast("int") % 180, F.round(sat).cast("int"), top


def spectral_angle(u: Column, v: Column) -> Column:
    """Degrees between two arrays; 90 where one has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    # greatest() and least() skip NULL, so a missing length is decided first.
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.nullif(norm, F.lit(0.0))))
    return F.when(norm > 0, F.degrees(F.acos(cosine))).otherwise(F.lit(90.0))


def utm(lon: Column, lat: Column, zone: int = 34) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees on the northern half of a zone (series good to millimetres)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    c = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    d = F.radians(lon - F.lit(6.0 * zone - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return k0 * radius * east + 500000, k0 * radius * north


def expression(text: str, **bands: Column) -> Column:
    """A column from arithmetic written as text, such as ``(a - b) / b``, with its names bound to columns.

    Numbers, names, ``+ - * / % **``, comparisons and calls of ``FUNCTIONS`` are
    allowed; a zero denominator gives NULL; anything else is an error.
    """
    import ast

    def made(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in bands:
            return bands[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -made(node.operand) if isinstance(node.op, ast.USub) else made(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](made(node.left), made(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARISONS:
            return _COMPARISONS[type(node.ops[0])](made(node.left), made(node.comparators[0]))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*map(made, node.args))
        raise ValueError(f"{ast.unparse(node)!r} is not allowed in a band expression; known names: {', '.join(sorted(bands))}")

    def zero_safe(x: Column) -> Column:
        return F.nullif(x, F.lit(0.0))

    _OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / zero_safe(b), ast.Mod: lambda a, b: a % zero_safe(b), ast.Pow: F.pow}
    _COMPARISONS = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
    try:
        return made(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"{text!r} is no expression") from e


#: Functions that a band expression may call.
FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "min": F.least, "max": F.greatest, "pow": F.pow}
