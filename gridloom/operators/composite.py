"""Composites of extreme years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seasons around an event year and the offset of their year.
SEQUENCE = [("JJA_-1", "JJA", -1), ("SON_-1", "SON", -1), ("DJF_0", "DJF", 0), ("MAM_0", "MAM", 0), ("JJA_0", "JJA", 0), ("SON_0", "SON", 0), ("DJF_1", "DJF", 1)]


def stamp_year(year: Column, season: Column, offset: Column) -> Column:
    """The calendar year of a season's stamp: winter of year Y is stamped in January of Y + 1."""
    return year + offset + F.when(season == "DJF", 1).otherwise(0)


def reference_year(year: Column, key: Column) -> Column:
    """The calendar year of a precursor ``SEASON_tag`` of an event year: the tag -1 is the year before, 0 the event's own. Another tag is
    an error when it is run."""
    tag = F.substring_index(key, "_", -1)
    return F.when(tag == "-1", year - 1).when(tag == "0", year).otherwise(F.raise_error(F.concat(F.lit("unknown year tag: "), key)).cast("int"))


def high_low(field: DataFrame, events: DataFrame, cell: list[str], least: int = 1) -> DataFrame:
    """``cell, high, low, diff, t, df`` in one pass. field: ``year, cell, value``; events: ``year, kind`` (a few rows). Sides with less
    than ``least`` slices are NULL."""
    both = field.join(F.broadcast(events), "year")
    own = lambda k: F.when(F.col("kind") == k, F.col("value"))
    s = both.groupBy(*cell).agg(*(f(own(k)).alias(f"{n}_{k}") for k in ("high", "low") for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    mean = {k: F.when(F.col(f"n_{k}") >= least, F.col(f"m_{k}")) for k in ("high", "low")}
    qa, qb = F.col("v_high") / F.nullif("n_high", F.lit(0)), F.col("v_low") / F.nullif("n_low", F.lit(0))
    low = F.nullif(qa * qa / F.nullif(F.col("n_high") - 1, F.lit(0)) + qb * qb / F.nullif(F.col("n_low") - 1, F.lit(0)), F.lit(0.0))
    return s.select(*cell, mean["high"].alias("high"), mean["low"].alias("low"), (mean["high"] - mean["low"]).alias("diff"), ((F.col("m_high") - F.col("m_low")) / F.nullif(F.sqrt(qa + qb), F.lit(0.0))).alias("t"), ((qa + qb) * (qa + qb) / low).alias("df"))


def contributing_years(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("year")), ";").alias("years"), F.count_distinct("year").alias("n"))


def wind_mask(u: Column, v: Column, p_u: Column, p_v: Column, alpha: float) -> tuple[Column, Column]:
    """A vector stays if either component is significant."""
    keep = (p_u < alpha) | (p_v < alpha)
    return F.when(keep, u), F.when(keep, v)


#: The place in ``SEQUENCE`` at which the seasons of a precursor of a season and year tag begin.
STARTS = {"JJA_-1": 0, "SON_-1": 1, "DJF_0": 2, "MAM_0": 3}


def target_seasons(start: str | None = None, wanted: list[str] | None = None) -> list[tuple[str, str, int]]:
    """The seasons that are shown, in order: those wanted by name; else those from a precursor's own season on; else all. A start that is
    unknown begins at the first."""
    if wanted:
        return [s for s in SEQUENCE if s[0] in wanted]
    return SEQUENCE[STARTS.get(start or "", 0) :]


def seasons_to_plot(wanted: list[str] | None, available: list[str], first: int = 0) -> list[str]:
    """The wanted seasons that are there, in the order wanted; without any wanted, all from the first on."""
    return [s for s in wanted if s in available] if wanted else available[first:]


def by_bands(field: DataFrame, bands: DataFrame, events: DataFrame, least: int = 1) -> DataFrame:
    """``band, level, lon, high, low, diff, t, df``: vertical composites of all latitude bands in one pass. field: ``year, level, lat, lon,
    value``; bands: ``band, lat_min, lat_max``; events: ``year, kind``."""
    from gridloom.operators.grid import band_means

    return high_low(band_means(field, bands, ["year", "level"]), events, ["band", "level", "lon"], least)


def significant(composites: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``high_low`` with ``p_value`` of the difference, and ``kept``: the difference where it is significant."""
    from gridloom.operators.stats import t_p_value

    tested = composites.withColumn("p_value", t_p_value(F.col("t"), F.col("df")))
    return tested.withColumn("kept", F.when(F.col("p_value") < alpha, F.col("diff")))


#: Every so many points are drawn, and the lengths that the 5th and 95th percentile of flux vectors get.
STRIDE, FLUX_STRIDE, FLUX_LENGTHS = 5, 7, (0.6, 1.4)


def winds(df: DataFrame, keys: list[str], scaling: str | None = None, masked: bool = True, equator: float | None = None) -> DataFrame:
    """``keys, lat, lon, u, v, width``: the vectors of a composite as they are drawn, one map a key. df: ``keys, lat, lon, u, v, significant``.

    Vectors that are not significant go (unless not ``masked``). With ``scaling`` 'waf' those within ``equator`` degrees of the equator go too,
    and lengths are set between two limits, reached at the 5th and 95th percentile of the map. Points are thinned along both axes, every
    fifth, of fluxes every seventh. ``width`` is 3 times the speed over the map's greatest, before scaling; 0 where there is no vector, NULL on a map
    without any."""
    flux, own = scaling == "waf", Window.partitionBy(*keys)
    keep = F.col("significant") if masked else F.lit(True)
    if flux and equator is not None:
        keep = keep & (F.abs("lat") > equator)
    seen = df.withColumns({c: F.when(keep, F.col(c)) for c in ("u", "v")}).withColumn("_m", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    sizes = seen.groupBy(*keys).agg(F.max("_m").alias("_top"), F.percentile("_m", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    whole = seen.join(sizes, keys) if keys else seen.crossJoin(F.broadcast(sizes))
    step = FLUX_STRIDE if flux else STRIDE
    axes = {f"_{c}": F.dense_rank().over(own.orderBy(c)) - 1 for c in ("lat", "lon")}
    thin = whole.withColumns(axes).filter((F.col("_lat") % step == 0) & (F.col("_lon") % step == 0))
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    a, b = FLUX_LENGTHS
    length = b + (F.least(F.greatest(F.col("_m"), low), high) - high) * ((b - a) / F.nullif(high - low, F.lit(0.0)))
    ratio = F.when(high > low, F.when(F.col("_m") != 0, length / F.col("_m")).otherwise(0.0)).otherwise(1.0) if flux else F.lit(1.0)
    width = F.when(F.col("_top") > 0, F.coalesce(3 * F.col("_m") / F.col("_top"), F.lit(0.0))).when(F.col("_top").isNotNull(), 0.0)
    return thin.select(*keys, "lat", "lon", (F.col("u") * ratio).alias("u"), (F.col("v") * ratio).alias("v"), width.alias("width"))


CASES = ("high", "low", "diff")
#: The parts of a cube: a slice is one case in one season.
SLICE = ["case", "season_lag"]


def slices(field: DataFrame, events: DataFrame, cell: list[str], lag: str = "season_lag", least: int = 1) -> DataFrame:
    """``cell, value, t, df, case, season_lag``: the composites of extreme years as rows, with the statistic of each: of the mean against 0, or
    of the difference. field: ``year, cell, season_lag, value``."""
    own = [*cell, lag]
    both = field.join(F.broadcast(events), "year")
    s = both.groupBy(*own).agg(*(f(F.when(F.col("kind") == k, F.col("value"))).alias(f"{n}_{k}") for k in CASES[:2] for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))))
    one = {k: F.col(f"m_{k}") / F.nullif(F.col(f"s_{k}") / F.sqrt(f"n_{k}"), F.lit(0.0)) for k in CASES[:2]}
    diff = high_low(field, events, own, least).select(*own, "diff", "t", "df")
    enough = {k: F.col(f"n_{k}") >= least for k in CASES[:2]}
    rows = [F.struct(F.lit(k).alias("case"), F.when(enough[k], F.col(f"m_{k}")).alias("value"), F.when(enough[k], one[k]).alias("t"), F.when(enough[k], (F.col(f"n_{k}") - 1).cast("double")).alias("df")) for k in CASES[:2]]
    rows.append(F.struct(F.lit("diff").alias("case"), F.col("diff").alias("value"), "t", "df"))
    return s.join(diff, own).select(*cell, lag, F.explode(F.array(*rows)).alias("r")).select(*cell, "r.value", "r.t", "r.df", "r.case", F.col(lag).alias("season_lag"))


def write_cube(parts: DataFrame, path: str) -> None:
    """Put slices into the cube at ``path``. A slice that is there is replaced as a whole, the others stay, so runs that cover
    parts of the seasons, or the same ones twice, make one cube."""
    from gridloom.sources import progress

    progress.publish(parts, path, SLICE)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``case, season_lag, cells, known, checksum`` of the slices in a cube, told from the cube itself. The checksum does not depend on the order of
    rows."""
    from gridloom.sources import progress

    table = progress.result(spark, path, schema)
    total = F.sum(F.xxhash64(*(c for c in table.columns if c not in SLICE)).cast("decimal(38,0)"))
    return table.groupBy(*SLICE).agg(F.count("*").alias("cells"), F.count("value").alias("known"), total.cast("string").alias("checksum"))


def cube(spark: SparkSession, path: str, schema: str, cell: list[str], lags: list[str]) -> DataFrame:
    """The whole cube: each case and each of ``lags``, in order (``place``), on all cells that any slice has. Slices that no run has made are
    NULL, like cells that a slice lacks."""
    from gridloom.sources import progress

    table = progress.result(spark, path, schema)
    axes = F.explode(F.array(*(F.struct(F.lit(c).alias("case"), F.lit(s).alias("season_lag"), F.lit(i).alias("place")) for c in CASES for i, s in enumerate(lags))))
    frame = table.select(*cell).distinct().select(*cell, axes.alias("a")).select(*cell, "a.*")
    return frame.join(table, [*cell, *SLICE], "left")
