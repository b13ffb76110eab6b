"""Differences, integrals and interpolation along an axis, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS, GRAVITY = 6.371e6, 9.80665
#: Fixed values of the barometric formula: pressure, temperature, lapse rate, molar mass, gas constant.
P0, T0, LAPSE, MOLAR, GAS = 101325.0, 288.15, 0.0065, 0.0289644, 8.31447


def central_diff(df: DataFrame, keys: list[str], axis: str, value: str = "value", out: str = "d") -> DataFrame:
    """Second-order differences for uneven steps; one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(axis)
    x, f = F.col(axis), F.col(value)
    xm, xp, fm, fp = F.lag(axis).over(w), F.lead(axis).over(w), F.lag(value).over(w), F.lead(value).over(w)
    hm, hp = x - xm, xp - x
    inner = (hm * hm * fp + (hp * hp - hm * hm) * f - hp * hp * fm) / (hm * hp * (hm + hp))
    return df.withColumn(out, F.when(xm.isNull(), (fp - f) / hp).when(xp.isNull(), (f - fm) / hm).otherwise(inner))


def cumtrapz(df: DataFrame, keys: list[str], axis: str, value: str = "value", out: str = "psi") -> DataFrame:
    """Cumulative trapezoid from the first point, where it is 0. From the first gap on the integral is missing, also where the first point
    is the gap; the first point itself is 0, and so are all where every value is missing."""
    w = Window.partitionBy(*keys).orderBy(axis)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(F.struct(F.col(axis).alias("x"), F.col(value).alias("f"))).over(w)
    first = before.isNull()
    part = F.when(~first, (F.col(value) + before["f"]) / 2 * (F.col(axis) - before["x"]))
    staged = df.withColumns({"_part": part, "_gap": (~first & part.isNull()).cast("int"), "_held": F.count(value).over(Window.partitionBy(*keys))})
    whole = F.when(F.max("_gap").over(upto) == 0, F.coalesce(F.sum("_part").over(upto), F.lit(0.0)))
    return staged.withColumn(out, F.when(F.col("_held") == 0, F.lit(0.0)).otherwise(whole)).drop("_part", "_gap", "_held")


def mass_streamfunction(df: DataFrame, keys: list[str]) -> DataFrame:
    """Integral over pressure of u 2 pi R cos(lat) / g. df: ``keys, lat, level, value``."""
    scaled = df.withColumn("value", F.col("value") * (2 * 3.141592653589793 * EARTH_RADIUS / GRAVITY) * F.cos(F.radians("lat")))
    return cumtrapz(scaled, [*keys, "lat"], "level")


def linear_interp(df: DataFrame, keys: list[str], axis: str, step: float, value: str = "value") -> DataFrame:
    """Values at the multiples of ``step`` between each pair of neighbours (each end belongs to the pair it begins; the last to the
    last pair): every row yields the points up to its successor, so no join is needed."""
    w = Window.partitionBy(*keys).orderBy(axis)
    x0, x1, f0, f1 = F.col(axis), F.col("_x1"), F.col(value), F.col("_f1")
    pairs = df.filter(F.col(value).isNotNull()).withColumns({"_x1": F.lead(axis).over(w), "_f1": F.lead(value).over(w), "_end": F.lead(axis, 2).over(w).isNull()}).filter("_x1 is not null")
    first, last = F.ceil(x0 / step), F.when(F.col("_end"), F.floor(x1 / step)).otherwise(F.ceil(x1 / step) - 1)
    points = pairs.filter(last >= first).select(*keys, axis, value, "_x1", "_f1", F.explode(F.sequence(first, last)).alias("_k"))
    at = F.col("_k") * F.lit(float(step))
    return points.select(*keys, at.alias("_at"), (f0 + (f1 - f0) * (at - x0) / (x1 - x0)).alias(value)).withColumnRenamed("_at", axis)


def barometric(height: Column) -> Column:
    """Pressure in hPa at a height in metres."""
    return F.lit(P0 / 100) * F.pow(1 - height * (LAPSE / T0), F.lit(GRAVITY * MOLAR / (GAS * LAPSE)))


def surface_pressure(df: DataFrame, keys: list[str], band: tuple[float, float] = (-5, 5), margin: float = 1.0, step: float = 1.0) -> DataFrame:
    """``keys, lon, value``: the pressure in hPa of the surface along a latitude band, for sections over pressure and longitude. Geopotential
    becomes height and then pressure at each point, the band (with a margin) is averaged by area, and the mean is interpolated to multiples of
    ``step`` in [-180, 180). df: ``keys, lat, lon, value`` with longitudes in [-180, 180)."""
    from gridloom.operators.grid import area_mean

    low, high = band
    points = df.filter(F.col("lat").between(low - margin, high + margin)).withColumn("value", barometric(F.col("value") / GRAVITY))
    return linear_interp(area_mean(points, [*keys, "lon"]), keys, "lon", step).filter(F.col("lon").between(-180, 180 - 1e-9))


def coriolis(lat: Column) -> Column:
    return 2 * 7.292e-5 * F.sin(F.radians(lat))


def wave_activity_flux(df: DataFrame, keys: list[str], pressure: float = 0.2, radius: float = EARTH_RADIUS) -> DataFrame:
    """Horizontal wave-activity flux of a stream-function anomaly in a basic flow. df: ``keys, lat, lon, psi, u, v`` (basic wind);
    adds ``wx, wy``. Winds below 1e-4 give NULL."""
    rad = 3.141592653589793 / 180
    d = central_diff(df, [*keys, "lat"], "lon", "psi", "px")
    d = central_diff(d, [*keys, "lon"], "lat", "psi", "py")
    d = central_diff(d, [*keys, "lat"], "lon", "px", "pxx")
    d = central_diff(d, [*keys, "lon"], "lat", "px", "pxy")
    d = central_diff(d, [*keys, "lon"], "lat", "py", "pyy")
    c = F.cos(F.radians("lat"))
    px, py, pxx, pxy, pyy = (F.col(n) / (rad if len(n) == 2 else rad * rad) for n in ("px", "py", "pxx", "pxy", "pyy"))
    psi, u, v = F.col("psi"), F.col("u"), F.col("v")
    wind = F.sqrt(u * u + v * v)
    xx, xy, yy = px * px - psi * pxx, px * py - psi * pxy, py * py - psi * pyy
    scale = pressure * c / (2 * F.when(wind >= 1e-4, wind) * radius * radius)
    wx = scale * (u / F.nullif(c * c, F.lit(0.0)) * xx + v / F.nullif(c, F.lit(0.0)) * xy)
    wy = scale * (u / F.nullif(c, F.lit(0.0)) * xy + v * yy)
    return d.withColumns({"wx": wx, "wy": wy}).drop("px", "py", "pxx", "pxy", "pyy")


def quasi_geostrophic_psi(z_prime: Column, lat: Column) -> Column:
    f = coriolis(lat)
    return F.when(F.abs(f) > 1e-6, z_prime / f)
