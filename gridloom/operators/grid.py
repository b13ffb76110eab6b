"""Grid algebra on long tables ``time[, level], lat, lon, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def lon_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def in_box(lat_min: float, lat_max: float, lon_min: float, lon_max: float, lat: str = "lat", lon: str = "lon") -> Column:
    """Inclusive box; ``lon_min > lon_max`` crosses the date line."""
    rows = F.col(lat).between(lat_min, lat_max)
    if lon_min <= lon_max:
        return rows & F.col(lon).between(lon_min, lon_max)
    return rows & ((F.col(lon) >= lon_min) | (F.col(lon) <= lon_max))


def in_polygon(vertices: list[tuple[float, float]], lat: str = "lat", lon: str = "lon") -> Column:
    """Strictly within the polygon of ``(lon, lat)`` vertices: even-odd ray casting, points on an edge excluded."""
    x, y = F.col(lon), F.col(lat)
    inside, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        on_edge = on_edge | ((((x - x1) * (y2 - y1)) == ((y - y1) * (x2 - x1))) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            inside = inside + crosses.cast("int")
    return (inside % 2 == 1) & ~on_edge


def select_polygon(df: DataFrame, vertices: list[tuple[float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The rows within a polygon; an error where no cell is. One pass over the cells' coordinates decides."""
    inside = df.filter(in_polygon(vertices, lat, lon))
    if inside.select(lat, lon).isEmpty():
        raise ValueError("No data points fall within the specified polygon.")
    return inside


def domain(domains: DataFrame, name: str) -> dict[str, float]:
    """The bounds of a named box; an error that lists the names where there is none of that name. domains: ``name, lat_min, lat_max,
    lon_min, lon_max``, a dimension table."""
    found = domains.filter(F.col("name") == name).first()
    if found is None:
        names = ", ".join(r.name for r in domains.select("name").distinct().orderBy("name").collect())
        raise KeyError(f"Domain '{name}' not found. Available domains: {names}")
    return {k: v for k, v in found.asDict().items() if k != "name"}


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def sqrt_weight(lat: Column) -> Column:
    return F.sqrt(F.greatest(area_weight(lat), F.lit(0.0)))


def weighted_mean(value: Column, lat: Column) -> Column:
    """Aggregate: mean over valid cells, weighted by the cosine of latitude."""
    w = F.when(value.isNotNull(), area_weight(lat))
    return F.sum(value * area_weight(lat)) / F.nullif(F.sum(w), F.lit(0.0))


def area_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(weighted_mean(F.col(value), F.col("lat")).alias(value))


def domain_means(df: DataFrame, domains: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over the field for all named boxes (a dimension table of a few rows): ``keys, name, value``. Cells are matched to
    boxes first, on the distinct coordinates, so the field itself is joined by equality."""
    cells = df.select("lat", "lon").distinct()
    box = cells.join(F.broadcast(domains), F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.when(F.col("lon_min") <= F.col("lon_max"), F.col("lon").between(F.col("lon_min"), F.col("lon_max"))).otherwise((F.col("lon") >= F.col("lon_min")) | (F.col("lon") <= F.col("lon_max"))))
    return area_mean(df.join(box.select("lat", "lon", "name"), ["lat", "lon"]), [*keys, "name"])


def equatorial_mask(value: Column, lat: Column, degrees: float) -> Column:
    return F.when(F.abs(lat) > degrees, value)


def equatorial_taper(lat: Column, width: float, taper: float) -> Column:
    """0 up to ``width`` degrees, then linear up to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(lat) - width) / taper))


def keep_land(df: DataFrame, sst: DataFrame, keys: list[str]) -> DataFrame:
    """Values only where the sea surface has none."""
    ocean = sst.select(*keys, F.col("value").alias("_sst"))
    return df.join(ocean, keys, "left").select(*df.columns[:-1], F.when(F.col("_sst").isNull(), F.col(df.columns[-1])).alias(df.columns[-1]))


def cyclic_point(df: DataFrame, step: float) -> DataFrame:
    """Adds longitude 180 as a copy of -180 where the grid spans the globe and has no 180."""
    span = df.agg(F.min("lon").alias("lo"), F.max("lon").alias("hi"))
    extra = df.filter(F.col("lon") == -180).join(F.broadcast(span), (F.col("lo") == -180) & (F.col("hi") < 180) & (F.col("hi") + step >= 180)).drop("lo", "hi")
    return df.unionByName(extra.withColumn("lon", F.lit(180.0)))


def zonal_eddy(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Minus the mean over longitude."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def majority_significant(p: Column, threshold: float) -> Column:
    """Aggregate: more than half of a band is significant."""
    return F.avg((p < threshold).cast("double")) > 0.5


def symmetric_levels(high: Column, step: float, rounded: bool = False) -> Column:
    """Levels from -m to m, where m is ``high`` in whole steps (upward, or to the nearest)."""
    n = (F.round if rounded else F.ceil)(F.abs(high) / step).cast("int")
    return F.transform(F.sequence(-n, n), lambda k: k * F.lit(step))


def vector_rescale(df: DataFrame, keys: list[str], quantile: float, stride: int) -> DataFrame:
    """Vectors longer than the quantile of length are shortened to it; every ``stride``-th row and column stays."""
    length = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    cut = df.groupBy(*keys).agg(F.percentile(length, F.lit(quantile)).alias("cut"))
    held = df.join(F.broadcast(cut), keys) if keys else df.crossJoin(F.broadcast(cut))
    factor = F.least(F.lit(1.0), F.col("cut") / F.nullif(length, F.lit(0.0)))
    ranks = held.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy("lat")) - 1).withColumn("col", F.dense_rank().over(Window.partitionBy(*keys).orderBy("lon")) - 1)
    return ranks.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).select(*keys, "lat", "lon", (F.col("u") * F.coalesce(factor, F.lit(1.0))).alias("u"), (F.col("v") * F.coalesce(factor, F.lit(1.0))).alias("v"))


def bilinear(df: DataFrame, targets: DataFrame, step_lat: float, step_lon: float, lat0: float, lon0: float, keys: list[str]) -> DataFrame:
    """Values at the targets' coordinates from the four neighbours on a regular grid; NULL where one is missing.

    Each target names its four neighbours by grid index, so this is an equi-join, not a range join."""
    base_y, base_x = F.floor((F.col("tlat") - lat0) / step_lat), F.floor((F.col("tlon") - lon0) / step_lon)
    fy, fx = (F.col("tlat") - lat0) / step_lat - base_y, (F.col("tlon") - lon0) / step_lon - base_x
    corners = F.array(*(F.struct((base_y + dy).alias("iy"), (base_x + dx).alias("ix"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)))
    want = targets.select("tlat", "tlon", F.explode(corners).alias("c")).select("tlat", "tlon", "c.*").filter("w > 0")
    need = want.groupBy("tlat", "tlon").agg(F.count("*").alias("need"))
    have = df.withColumn("iy", F.round((F.col("lat") - lat0) / step_lat).cast("bigint")).withColumn("ix", F.round((F.col("lon") - lon0) / step_lon).cast("bigint"))
    got = have.filter("value is not null").join(want, ["iy", "ix"]).groupBy(*keys, "tlat", "tlon").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.count("*").alias("got"))
    return got.join(need, ["tlat", "tlon"]).select(*keys, "tlat", "tlon", F.when(F.col("got") == F.col("need"), F.col("s")).alias("value"))


def finite_or_zero(value: Column) -> Column:
    """0 for what is missing, no number or infinite."""
    return F.when(F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True)), 0.0).otherwise(value)


def line_width(df: DataFrame, keys: list[str], most: float = 3.0, out: str = "width") -> DataFrame:
    """``most`` times the speed of ``u, v`` over the greatest speed of the keys; 0 where a vector is missing or all are."""
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    top = F.max(F.when(~F.isnan(speed), speed)).over(Window.partitionBy(*keys))
    return df.withColumn(out, finite_or_zero(most * speed / F.nullif(top, F.lit(0.0))))


def band_means(df: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, band, lon, value``: the means over the latitudes of each band, for all bands in one pass. bands: ``band, lat_min, lat_max``, a
    few rows; latitudes meet them first, so the field is joined by equality."""
    lats = df.select("lat").distinct().join(F.broadcast(bands), F.col("lat").between(F.col("lat_min"), F.col("lat_max"))).select("lat", "band")
    return df.join(F.broadcast(lats), "lat").groupBy(*keys, "band", "lon").agg(F.avg("value").alias("value"))
