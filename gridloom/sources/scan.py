"""Scans of field tables with coordinate normalisation, and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid

#: Coordinate names and the names they are read under; columns that are dropped.
RENAMES = {"latitude": "lat", "longitude": "lon", "valid_time": "time", "pressure_level": "level"}
DROPPED = {"number", "expver", "time_bnds", "lat_bnds", "lon_bnds"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_nan(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def normalise(df: DataFrame, var: str | None = None, scale: float = 1.0, transform: Callable[[Column], Column] | None = None, level: int | None = None, mean_levels: tuple[int, int] | None = None, lat: tuple[float, float] | None = None, drop: tuple[str, ...] = (), wrap_lon: bool = True) -> DataFrame:
    """A raw scan as ``time[, level], lat, lon, value``: coordinates renamed, helper columns dropped, one variable (the first data
    column if none is named) scaled and transformed, one level or the mean of a layer, latitudes cut, longitudes in [-180, 180), NaN as NULL."""
    for old, new in RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.drop(*(DROPPED & set(df.columns)), *drop)
    keys = [c for c in ("time", "level", "lat", "lon") if c in df.columns]
    var = var or next(c for c in df.columns if c not in keys)
    df = df.select(*keys, no_nan(F.col(var).cast("double")).alias("value"))
    if level is not None:
        df = df.filter(F.col("level") == level).drop("level")
    if lat is not None:
        df = df.filter(F.col("lat").between(*sorted(lat)))
    if mean_levels is not None:
        df = df.filter(F.col("level").between(*sorted(mean_levels))).groupBy("time", "lat", "lon").agg(F.avg("value").alias("value"))
    if wrap_lon:
        df = df.withColumn("lon", grid.wrap_lon(F.col("lon")))
    value = F.col("value") * scale
    return df.withColumn("value", transform(value) if transform else value)


def scan_many(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """The union of several files, each normalised on its own (columns may differ)."""
    out = None
    for path in paths:
        part = normalise(spark.read.parquet(path), **how)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def wind_pair(u: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
    return u.select(*keys, F.col("value").alias("u")).join(v.select(*keys, F.col("value").alias("v")), keys)


def results(spark: SparkSession, root: str, **parts: str | int) -> DataFrame:
    """A partitioned result table, pruned to the named partitions."""
    df = spark.read.parquet(root)
    for k, v in parts.items():
        df = df.filter(F.col(k) == v)
    return df


#: The two wind components by lower level; any other level is that of 10 m.
LOWER_WINDS = {"WAF": ("WAFx_200", "WAFy_200"), "10m": ("U_10m", "V_10m"), "850": ("U_850", "V_850")}


def wind_bundle(spark: SparkSession, root: str, lower: str, upper: str, cell: list[str], **parts: str | int) -> DataFrame:
    """``cell, layer, u, v, p_u, p_v``: the wind coefficients of a regression at a lower and an upper level, one scan of the partitions
    that hold the four fields. A field that is not there is NULL. root: results partitioned by ``var`` (and ``parts``), with ``coef, p_value``."""
    names = {"lower": LOWER_WINDS.get(lower, LOWER_WINDS["10m"]), "upper": (f"U_{upper}", f"V_{upper}")}
    found = results(spark, root, **parts).filter(F.col("var").isin([v for pair in names.values() for v in pair]))
    layers = F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.lit(u).alias("_u"), F.lit(v).alias("_v")) for k, (u, v) in names.items())))
    each = found.select(*cell, "var", "coef", "p_value", layers.alias("l")).select(*cell, "var", "coef", "p_value", "l.*").filter(F.col("var").isin(F.col("_u"), F.col("_v")))
    own = lambda side, c: F.max(F.when(F.col("var") == F.col(side), F.col(c)))
    return each.groupBy(*cell, "layer").agg(own("_u", "coef").alias("u"), own("_v", "coef").alias("v"), own("_u", "p_value").alias("p_u"), own("_v", "p_value").alias("p_v"))


def year_months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """``year, month`` (two digits) from ``YYYY-MM`` to ``YYYY-MM``, both included."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))).alias("d"))
    return months.select(F.year("d").alias("year"), F.lpad(F.month("d").cast("string"), 2, "0").alias("month"))


def months_of(years: DataFrame) -> DataFrame:
    """``year, month`` (two digits) of all twelve months of each year. years: ``year``, each once."""
    return years.select("year", F.explode(F.array(*(F.lit(f"{m:02d}") for m in range(1, 13)))).alias("month"))


def missing_years(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select("year").distinct(), "year", "left_anti")


#: Leading bytes of grid file formats.
SIGNATURES = {b"CDF\x01": "netcdf3", b"CDF\x02": "netcdf3-64bit", b"\x89HDF": "netcdf4/hdf5", b"GRIB": "grib", b"PAR1": "parquet"}


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, format`` by the leading bytes; unknown ones are NULL. Only the first four bytes leave the scan."""
    head = F.substring("content", 1, 4)
    kind = F.coalesce(*(F.when(head == F.lit(bytearray(k)), v) for k, v in SIGNATURES.items()))
    return spark.read.format("binaryFile").load(path).select("path", "length", kind.alias("format"))


#: Kinds of download errors by what their message holds, whether to try again, and after how many seconds.
ERRORS = [("timeout", ("timeout", "timed out"), True, 60), ("rate_limit", ("429", "rate limit", "too many requests"), True, 300), ("server", ("500", "502", "503", "504", "server error"), True, 120), ("network", ("connection", "network", "unreachable"), True, 30), ("auth", ("401", "403", "unauthorized", "forbidden"), False, 0), ("request", ("400", "invalid", "bad request"), False, 0), ("disk", ("disk", "no space"), False, 0)]


def error_class(message: Column) -> Column:
    said, out = F.lower(message), None
    for kind, marks, again, wait in ERRORS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(said, F.lit(m))
        row = F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retry"), F.lit(wait).alias("wait_s"))
        out = F.when(hit, row) if out is None else out.when(hit, row)
    return out.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(True).alias("retry"), F.lit(60).alias("wait_s")))


def error_kind(message: str) -> tuple[str, bool, int]:
    """``error_class`` of one message, where it is at hand: kind, whether to try again, and after how many seconds."""
    said = message.lower()
    return next(((kind, again, wait) for kind, marks, again, wait in ERRORS if any(m in said for m in marks)), ("unknown", True, 60))


def valid_grid(step: tuple[float, float]) -> bool:
    return len(step) == 2 and all(0 < s <= 10 for s in step)


def valid_area(area: tuple[float, float, float, float]) -> bool:
    """north, west, south, east"""
    north, west, south, east = area
    return -90 <= south < north <= 90 and -180 <= west <= 360 and -180 <= east <= 360 and west != east


def grid_ok(step: Column) -> Column:
    """``valid_grid`` of a column of arrays, for tables of requests."""
    return F.coalesce((F.size(step) == 2) & F.forall(step, lambda s: (s > 0) & (s <= 10)), F.lit(False))


def area_ok(area: Column) -> Column:
    """``valid_area`` of a column of arrays: north, west, south, east."""
    north, west, south, east = (F.get(area, F.lit(i)) for i in range(4))
    return F.coalesce((south >= -90) & (south < north) & (north <= 90) & west.between(-180, 360) & east.between(-180, 360) & (west != east), F.lit(False))


def parameter_hash(parameters: Column) -> Column:
    return F.substring(F.md5(F.to_json(parameters)), 1, 8)


def write_field(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned by ``by`` and ordered within files so that coordinate filters prune row groups."""
    order = [*by, *(c for c in ("time", "level", "lat", "lon") if c in df.columns)]
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def curve_key(df: DataFrame, columns: list[str], bits: int = 10) -> Column:
    """The place on a space-filling curve (Morton order) of the columns, each cut into ``2^bits`` steps from its least to its greatest value; times
    by their day. NULL counts as the least. The range is taken from the data, in one pass."""
    as_number = {c: F.unix_date(F.col(c).cast("date")).cast("double") if df.schema[c].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double") for c in columns}
    ends = df.agg(*(f(x).alias(f"{n}_{c}") for c, x in as_number.items() for n, f in (("low", F.min), ("high", F.max)))).first()
    out = F.lit(0).cast("long")
    for k, (c, x) in enumerate(as_number.items()):
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        if low is None or low == high:
            continue
        step = F.coalesce(F.floor((x - low) / (high - low) * ((1 << bits) - 1)), F.lit(0)).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(step, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + k))
    return out


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """Parquet whose files, and row groups in them, are pieces of a space-filling curve over the columns: each holds a small range of
    all of them, so a box on any of them skips most by their statistics. An order by one column after the other serves the first alone."""
    keyed = df.withColumn("_place", curve_key(df, columns))
    dealt = keyed.repartitionByRange(files, "_place") if files else keyed.repartitionByRange("_place")
    dealt.sortWithinPartitions("_place").drop("_place").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_edges(df: DataFrame, path: str) -> None:
    """The edge interchange table: capitalised names, four digits."""
    df.select(F.col("cause").alias("Cause"), F.col("effect").alias("Effect"), F.col("lag").alias("Lag"), F.round("effect_size", 4).alias("Causal_Effect"), F.round("p_value", 4).alias("p_value")).write.mode("overwrite").csv(path, header=True)


def write_registry(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def recent(df: DataFrame, n: int, by: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(by).desc()).limit(n)


def write_with_sidecar(df: DataFrame, path: str, script: str, parameters: dict, registry: str | None = None) -> DataFrame:
    """Write a result, and beside it ``<path>.json`` with one row: what made it, with which parameters and their hash, its columns, its rows
    and when. With ``registry`` the row is added there too. Gives the row."""
    spark = df.sparkSession
    write_field(df, path)
    said = json.dumps(parameters, sort_keys=True)
    row = spark.range(1).select(
        F.lit(script).alias("script"),
        F.lit(path).alias("path"),
        F.lit(said).alias("parameters"),
        F.lit(hashlib.md5(said.encode()).hexdigest()[:8]).alias("hash"),
        F.lit(df.schema.simpleString()).alias("columns"),
        F.lit(spark.read.parquet(path).count()).alias("rows"),
        F.current_timestamp().alias("timestamp"),
    )
    row.write.mode("overwrite").json(f"{path}.json")
    kept = spark.read.json(f"{path}.json")
    if registry:
        write_registry(kept, registry)
    return kept


def write_persistence(table: DataFrame, path: str) -> DataFrame:
    """The three results of a persistence analysis: ``persistence`` and ``robust`` as CSV, and ``summary`` as one JSON row, which is given back."""
    spark = table.sparkSession
    table.write.mode("overwrite").csv(f"{path}/persistence", header=True)
    read = spark.read.schema(table.schema).csv(f"{path}/persistence", header=True)
    read.filter("is_robust").write.mode("overwrite").csv(f"{path}/robust", header=True)
    summary = read.agg(
        F.count("*").alias("edges"),
        F.count_if("is_persistent").alias("persistent"),
        F.count_if("is_robust").alias("robust"),
        F.avg("persistence_ratio").alias("mean_ratio"),
        F.median("persistence_ratio").alias("median_ratio"),
    )
    summary.write.mode("overwrite").json(f"{path}/summary")
    return spark.read.json(f"{path}/summary")


def readable(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Whether each Parquet file can be read and has rows. Footers alone are read."""
    out = {}
    for path in paths:
        try:
            out[path] = spark.read.parquet(path).count() > 0
        except (AnalysisException, Py4JJavaError):
            out[path] = False
    return out


def outcomes(results: DataFrame, ok: Column, by: list[str]) -> DataFrame:
    """``by, total, succeeded, failed, exit_code``: how much of some work went well. The code is 0 where all did, 1 where none did and 2
    where some did."""
    s = results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"))
    code = F.when(F.col("succeeded") == F.col("total"), 0).when(F.col("succeeded") == 0, 1).otherwise(2)
    return s.withColumn("failed", F.col("total") - F.col("succeeded")).withColumn("exit_code", code)
