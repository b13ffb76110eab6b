"""Named queries over fields, series and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import calculus, composite, grid, ordered, panel as align, season, stats
from gridloom.plans import carriers as data
from gridloom.plans.carriers import PLACE, sql
from gridloom.plans.registry import query
from gridloom.sources import scan


def r4(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 4) + 0.0).alias(name or (c if isinstance(c, str) else "x"))


@query("seasonal_anomaly", sql("SELECT season, cell, round(anom, 4) AS anom, round(anom / nullif(stddev_pop(anom) OVER (PARTITION BY cell, month(season)), 0), 4) AS z FROM anom"))
def seasonal_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return season.zscore_month(data.anom(spark, d), ["cell"], "anom").select("season", "cell", r4("anom"), r4("z"))


# grid


@query("lon_wrap", "SELECT n_nationkey AS cell, round((n_nationkey * 25.5::DOUBLE + 180) % 360 - 180, 4) AS lon, round((n_nationkey * 25.5::DOUBLE) % 360, 4) AS lon_360 FROM nation")
def lon_wrap(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("n_nationkey") * F.lit(25.5)
    return scan.table(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), r4(grid.wrap_lon(x), "lon"), r4(grid.lon_360(grid.wrap_lon(x)), "lon_360"))


@query("field_scan", sql("SELECT time, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value / 1000, 6) AS value FROM mon WHERE lat BETWEEN -30 AND 30"))
def field_scan(spark: SparkSession, d: str) -> DataFrame:
    m = data.mon(spark, d).select(F.col("time").alias("valid_time"), F.col("lat").alias("latitude"), (F.col("lon") + 360).alias("longitude"), F.lit(0).alias("number"), F.col("value").alias("tp"))
    return scan.normalise(m, "tp", scale=0.001, lat=(-30, 30)).select("time", r4("lat"), r4("lon"), F.round("value", 6).alias("value"))


@query("box_select", sql("SELECT season, cell, round(value, 6) AS value FROM sea WHERE lat BETWEEN -20 AND 30 AND lon BETWEEN -120 AND 120"))
def box_select(spark: SparkSession, d: str) -> DataFrame:
    return data.sea(spark, d).filter(grid.in_box(-20, 30, -120, 120)).select("season", "cell", F.round("value", 6).alias("value"))


@query("dateline_select", sql("SELECT season, cell, round(value, 4) AS value FROM sea WHERE lat BETWEEN -60 AND 60 AND (lon >= 120 OR lon <= -70)"))
def dateline_select(spark: SparkSession, d: str) -> DataFrame:
    return data.sea(spark, d).filter(grid.in_box(-60, 60, 120, -70)).select("season", "cell", r4("value"))


@query("polygon_select", sql("SELECT season, cell, round(value, 4) AS value FROM sea WHERE lat > -35 AND lat < 40 AND lon > -110 AND lon < 90"))
def polygon_select(spark: SparkSession, d: str) -> DataFrame:
    return grid.select_polygon(data.sea(spark, d), [(-110, -35), (90, -35), (90, 40), (-110, 40)]).select("season", "cell", r4("value"))


@query("polygon_mean_significant", sql("SELECT season, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS value FROM sea WHERE lat > -35 AND lat < 40 AND lon > -110 AND lon < 90 AND (cell * 7 % 10) / 10.0 < 0.5 GROUP BY season"))
def polygon_mean_significant(spark: SparkSession, d: str) -> DataFrame:
    inside = data.sea(spark, d).filter(grid.in_polygon([(-110, -35), (90, -35), (90, 40), (-110, 40)]) & (F.col("cell") * 7 % 10 / 10.0 < 0.5))
    return grid.area_mean(inside, ["season"]).select("season", r4("value"))


@query("area_mean", sql("SELECT season, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS value FROM sea GROUP BY season"))
def area_mean(spark: SparkSession, d: str) -> DataFrame:
    return grid.area_mean(data.sea(spark, d), ["season"]).select("season", r4("value"))


@query("sqrt_weighting", sql("SELECT season, cell, round(value * sqrt(cos(radians(lat))), 4) AS value, round(sqrt(cos(radians(lat))), 6) AS weight FROM sea"))
def sqrt_weighting(spark: SparkSession, d: str) -> DataFrame:
    w = grid.sqrt_weight(F.col("lat"))
    return data.sea(spark, d).select("season", "cell", r4(F.col("value") * w, "value"), F.round(w, 6).alias("weight"))


@query("band_mean", sql("SELECT season, round(lon, 4) AS lon, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS value FROM sea WHERE lat BETWEEN -15 AND 15 GROUP BY season, lon"))
def band_mean(spark: SparkSession, d: str) -> DataFrame:
    return grid.area_mean(data.sea(spark, d).filter(F.col("lat").between(-15, 15)), ["season", "lon"]).select("season", r4("lon"), r4("value"))


CYCLIC = "g AS (SELECT season, cell % 5 AS lat, (cell // 5) * 72.0::DOUBLE - 180 AS lon, value FROM sea)"


def _square(spark: SparkSession, d: str) -> DataFrame:
    """The 25 cells as a global 5 x 5 grid."""
    return data.sea(spark, d).select("season", "cell", (F.col("cell") % 5).alias("lat"), (F.floor(F.col("cell") / 5) * F.lit(72.0) - 180).alias("lon"), "value")


@query("cyclic_point", sql("SELECT season, lat, lon, round(value, 4) AS value FROM g UNION ALL SELECT season, lat, 180.0 AS lon, round(value, 4) FROM g WHERE lon = -180 AND (SELECT min(lon) = -180 AND max(lon) < 180 AND max(lon) + 72 >= 180 FROM g)", CYCLIC))
def cyclic_point(spark: SparkSession, d: str) -> DataFrame:
    return grid.cyclic_point(_square(spark, d).drop("cell"), 72.0).select("season", "lat", "lon", r4("value"))


@query("equatorial_taper", sql("SELECT cell, round(least(1.0, greatest(0.0, (abs(lat) - 10) / 15)), 6) AS taper, max(CASE WHEN abs(lat) > 20 THEN round(value, 4) END) AS masked FROM sea GROUP BY cell, lat"))
def equatorial_taper(spark: SparkSession, d: str) -> DataFrame:
    s = data.sea(spark, d)
    return s.groupBy("cell", "lat").agg(F.max(F.round(grid.equatorial_mask(F.col("value"), F.col("lat"), 20), 4)).alias("masked")).select("cell", F.round(grid.equatorial_taper(F.col("lat"), 10, 15), 6).alias("taper"), "masked")


@query("keep_land", sql("SELECT a.season, a.cell, CASE WHEN o.value IS NULL THEN round(a.value, 4) END AS value FROM sea a LEFT JOIN (SELECT season, cell, CASE WHEN cell % 3 <> 0 THEN value END AS value FROM sea) o ON a.season = o.season AND a.cell = o.cell"))
def keep_land(spark: SparkSession, d: str) -> DataFrame:
    s = data.sea(spark, d).select("season", "cell", "value")
    ocean = s.withColumn("value", F.when(F.col("cell") % 3 != 0, F.col("value")))
    return grid.keep_land(s, ocean, ["season", "cell"]).select("season", "cell", r4("value"))


DOMAINS = [("tropics", -20.0, 20.0, -180.0, 180.0), ("dateline", -60.0, 60.0, 100.0, -100.0), ("north", 20.0, 60.0, -120.0, 120.0), ("south", -60.0, -20.0, -180.0, 180.0)]
DOMAIN_SQL = "dom(name, lat_min, lat_max, lon_min, lon_max) AS (VALUES " + ", ".join(str(x) for x in DOMAINS) + "), dm AS (SELECT season, name, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS value FROM sea JOIN dom ON lat BETWEEN lat_min AND lat_max AND CASE WHEN lon_min <= lon_max THEN lon BETWEEN lon_min AND lon_max ELSE lon >= lon_min OR lon <= lon_max END GROUP BY season, name)"


def _domains(spark: SparkSession, d: str) -> DataFrame:
    return grid.domain_means(data.sea(spark, d), spark.createDataFrame(DOMAINS, "name string, lat_min double, lat_max double, lon_min double, lon_max double"), ["season"])


@query("domain_index", sql("SELECT season, name, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 4) AS z FROM dm WINDOW w AS (PARTITION BY name, month(season))", DOMAIN_SQL))
def domain_index(spark: SparkSession, d: str) -> DataFrame:
    return season.zscore_month(_domains(spark, d), ["name"]).select("season", "name", r4("z"))


@query("dipole_index", sql("SELECT season, round((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 4) AS z FROM (SELECT season, max(CASE WHEN name = 'north' THEN value END) - max(CASE WHEN name = 'south' THEN value END) AS x FROM dm GROUP BY season) WINDOW w AS (PARTITION BY month(season))", DOMAIN_SQL))
def dipole_index(spark: SparkSession, d: str) -> DataFrame:
    own = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    x = _domains(spark, d).groupBy("season").agg((own("north") - own("south")).alias("x"))
    return season.zscore_month(x, [], "x").select("season", r4("z"))


@query("zonal_eddy", sql("SELECT season, lat, lon, round(value - avg(value) OVER (PARTITION BY season, lat), 4) AS value FROM g", CYCLIC))
def zonal_eddy(spark: SparkSession, d: str) -> DataFrame:
    return grid.zonal_eddy(_square(spark, d), ["season", "lat"]).select("season", "lat", "lon", r4("value"))


@query("symmetric_levels", sql("SELECT cell, round(-ceil(max(abs(anom)) / 50000) * 50000, 4) AS low, (2 * ceil(max(abs(anom)) / 50000) + 1)::INT AS n FROM anom GROUP BY cell"))
def symmetric_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = grid.symmetric_levels(F.col("top"), 50000.0)
    return data.anom(spark, d).groupBy("cell").agg(F.max(F.abs("anom")).alias("top")).select("cell", r4(levels[0], "low"), F.size(levels).alias("n"))


@query("vector_rescale", sql("""SELECT season, lat, lon, round(u * f, 4) + 0.0 AS u, round(v * f, 4) + 0.0 AS v FROM (
  SELECT *, CASE WHEN sqrt(u * u + v * v) = 0 THEN 1 ELSE least(1.0, cut / sqrt(u * u + v * v)) END AS f, dense_rank() OVER (PARTITION BY season ORDER BY lat) - 1 AS r, dense_rank() OVER (PARTITION BY season ORDER BY lon) - 1 AS c
  FROM uv JOIN (SELECT season, quantile_cont(sqrt(u * u + v * v), 0.8) AS cut FROM uv GROUP BY season) USING (season)) WHERE r % 2 = 0 AND c % 2 = 0""", "uv AS (SELECT season, cell % 5 AS lat, (cell // 5) * 72.0::DOUBLE - 180 AS lon, anom AS u, anom * (cell - 12) / 10.0::DOUBLE AS v FROM anom)"))
def vector_rescale(spark: SparkSession, d: str) -> DataFrame:
    uv = data.anom(spark, d).select("season", (F.col("cell") % 5).alias("lat"), (F.floor(F.col("cell") / 5) * F.lit(72.0) - 180).alias("lon"), F.col("anom").alias("u"), (F.col("anom") * (F.col("cell") - 12) / F.lit(10.0)).alias("v"))
    return grid.vector_rescale(uv, ["season"], 0.8, 2).select("season", "lat", "lon", r4("u"), r4("v"))


# seasons


@query("season_resample", sql("SELECT season, cell, round(value, 4) AS value FROM sea"))
def season_resample(spark: SparkSession, d: str) -> DataFrame:
    return data.sea(spark, d).select("season", "cell", r4("value"))


@query("season_climatology", sql("SELECT cell, month(season)::INT AS month, round(avg(value), 4) AS value, count(*) AS n FROM sea GROUP BY ALL"))
def season_climatology(spark: SparkSession, d: str) -> DataFrame:
    return data.sea(spark, d).groupBy("cell", F.month("season").alias("month")).agg(r4(F.avg("value"), "value"), F.count("*").alias("n"))


@query("zscore_month", sql("SELECT season, cell, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 4) AS z FROM sea WINDOW w AS (PARTITION BY cell, month(season))"))
def zscore_month(spark: SparkSession, d: str) -> DataFrame:
    return season.zscore_month(data.sea(spark, d), ["cell"], ddof=1).select("season", "cell", r4("z"))


@query("zscore_all", sql("SELECT season, cell, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 4) AS z FROM sea WINDOW w AS (PARTITION BY cell)"))
def zscore_all(spark: SparkSession, d: str) -> DataFrame:
    return season.zscore(data.sea(spark, d), ["cell"]).select("season", "cell", r4("z"))


@query("season_shift", sql("SELECT a.season, a.cell, round(a.value, 4) AS value, round(b.value, 4) AS shifted FROM sea a LEFT JOIN sea b ON a.cell = b.cell AND a.season = (b.season + INTERVAL 6 MONTH)::DATE"))
def season_shift(spark: SparkSession, d: str) -> DataFrame:
    return season.shifted(data.sea(spark, d).select("season", "cell", "value"), ["cell"], 2).select("season", "cell", r4("value"), r4("shifted"))


@query("fill_season", sql("SELECT axis.season, name, round(value, 4) AS value FROM axis LEFT JOIN (SELECT * FROM idx WHERE name = 'ASIA' AND month(season) = 10) i ON axis.season = i.season"))
def fill_season(spark: SparkSession, d: str) -> DataFrame:
    series = data.idx(spark, d)
    return season.fill_seasons(season.calendar(series), series.filter("name = 'ASIA'"), 10).select("season", "name", r4("value"))


YEARS = "yr AS (SELECT year(season)::INT AS year, name, avg(value) AS value FROM idx GROUP BY ALL)"


def _years(spark: SparkSession, d: str) -> DataFrame:
    return data.idx(spark, d).groupBy(F.year("season").alias("year"), "name").agg(F.avg("value").alias("value"))


@query("top_bottom_years", sql("SELECT * FROM (SELECT year, round(value, 4) AS value, 'high' AS kind FROM yr WHERE name = 'ASIA' ORDER BY yr.value DESC, year DESC LIMIT 3) UNION ALL SELECT * FROM (SELECT year, round(value, 4), 'low' FROM yr WHERE name = 'ASIA' ORDER BY yr.value, year LIMIT 3)", YEARS))
def top_bottom_years(spark: SparkSession, d: str) -> DataFrame:
    return season.extreme_years(_years(spark, d).filter("name = 'ASIA'").drop("name"), 3).select("year", r4("value"), "kind")


VOTERS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


@query("tercile_vote_3of4", sql("""SELECT year, CASE WHEN up >= 3 AND down = 0 THEN 'upper' WHEN down >= 3 AND up = 0 THEN 'lower' ELSE 'none' END AS vote FROM (
  SELECT year, count(*) FILTER (x > hi) AS up, count(*) FILTER (x < lo) AS down, count(x) AS n FROM sg JOIN (SELECT name, quantile_cont(x, 1/3::DOUBLE) AS lo, quantile_cont(x, 2/3::DOUBLE) AS hi FROM sg GROUP BY name) USING (name) GROUP BY year) WHERE n = 4""", YEARS + ", sg AS (SELECT year, name, value * CASE WHEN name = 'ASIA' THEN -1 ELSE 1 END AS x FROM yr WHERE name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'))"))
def tercile_vote_3of4(spark: SparkSession, d: str) -> DataFrame:
    return season.tercile_vote(_years(spark, d), VOTERS, {"ASIA": -1}, need=3)


@query("ts_cv_folds", sql("SELECT fold::INT AS fold, t::INT AS t, CASE WHEN t >= n - (5 - fold) * (n // 6) THEN 'test' ELSE 'train' END AS part FROM axis, (SELECT max(t) + 1 AS n FROM axis), (SELECT unnest(range(5)) AS fold) WHERE t < n - (5 - fold) * (n // 6) + n // 6"))
def ts_cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return season.cv_folds(season.calendar(data.idx(spark, d)), 5)


@query("pooled_month_std", sql("""SELECT season, cell, round(u / nullif(s, 0), 4) AS u_n, round(v / nullif(s, 0), 4) AS v_n FROM (SELECT season, cell, anom AS u, anom * 0.5 + cell * 100 AS v FROM anom) JOIN
  (SELECT cell, m, stddev_pop(x) AS s FROM (SELECT cell, month(season) AS m, anom AS x FROM anom UNION ALL SELECT cell, month(season), anom * 0.5 + cell * 100 FROM anom) GROUP BY ALL) p USING (cell) WHERE p.m = month(season)"""))
def pooled_month_std(spark: SparkSession, d: str) -> DataFrame:
    uv = data.anom(spark, d).select("season", "cell", F.col("anom").alias("u"), (F.col("anom") * 0.5 + F.col("cell") * 100).alias("v"))
    return season.pooled_std(uv, ["cell"]).select("season", "cell", r4("u_n"), r4("v_n"))


@query("year_months", "SELECT year(x)::INT AS year, lpad(month(x)::VARCHAR, 2, '0') AS month FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS x)")
def year_months(spark: SparkSession, d: str) -> DataFrame:
    first, last = scan.table(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM"), F.date_format(F.max("o_orderdate"), "yyyy-MM")).first()
    return scan.year_months(spark, first, last)


# joins and sets


@query("align_inner", sql("SELECT a.season, round(a.value, 4) AS a, round(b.value, 4) AS b FROM idx a JOIN idx b ON a.season = b.season AND a.name = 'ASIA' AND b.name = 'EUROPE'"))
def align_inner(spark: SparkSession, d: str) -> DataFrame:
    x = data.idx(spark, d)
    return align.align_inner(x.filter("name = 'ASIA'"), x.filter("name = 'EUROPE'"), ["season"]).select("season", r4("a"), r4("b"))


@query("align_exact", sql("SELECT a.season, round(a.value, 4) AS a, round(b.value, 4) AS b FROM idx a JOIN idx b ON a.season = b.season AND a.name = 'ASIA' AND b.name = 'AMERICA'"))
def align_exact(spark: SparkSession, d: str) -> DataFrame:
    x = data.idx(spark, d)
    return align.align_exact(x.filter("name = 'ASIA'"), x.filter("name = 'AMERICA'"), ["season"]).select("season", r4("a"), r4("b"))


@query("reindex_left", sql("SELECT axis.season, round(value, 4) AS value FROM axis LEFT JOIN (SELECT * FROM idx WHERE name = 'AFRICA' AND month(season) IN (1, 7)) i ON axis.season = i.season"))
def reindex_left(spark: SparkSession, d: str) -> DataFrame:
    x = data.idx(spark, d)
    return align.reindex(season.calendar(x), x.filter((F.col("name") == "AFRICA") & F.month("season").isin(1, 7))).select("season", r4("value"))


@query("dataset_outer_pivot", sql("SELECT season, " + ", ".join(f"round(max(CASE WHEN name = '{n}' THEN value END), 4) AS {n.lower()}" for n in VOTERS) + " FROM idx WHERE NOT (name = 'ASIA' AND month(season) = 4) GROUP BY season"))
def dataset_outer_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = data.idx(spark, d).filter(~((F.col("name") == "ASIA") & (F.month("season") == 4)))
    return align.dataset(x, "season", VOTERS).select("season", *(r4(F.col(n), n.lower()) for n in VOTERS))


@query("lag_join", sql("SELECT a.t::INT AS t, round(a.value, 4) AS y, round(b.value, 4) AS x FROM panel a JOIN panel b ON a.t = b.t + 3 WHERE a.var = 'ASIA' AND b.var = 'EUROPE'"))
def lag_join(spark: SparkSession, d: str) -> DataFrame:
    p = data.panel(spark, d)
    return align.lagged(p.filter("var = 'ASIA'").select("t", F.col("value").alias("y")), p.filter("var = 'EUROPE'").select("t", F.col("value").alias("x")), 3).select("t", r4("y"), r4("x"))


@query("asof_nearest", """WITH e AS (SELECT DISTINCT o_orderdate::DATE AS time FROM orders), s AS (SELECT (date_trunc('month', l_shipdate)::DATE + 14)::DATE AS time, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1)
SELECT time, round(value, 2) AS value FROM (SELECT e.time, s.value, row_number() OVER (PARTITION BY e.time ORDER BY abs(date_diff('day', e.time, s.time)), s.time) AS r FROM e JOIN s ON s.time BETWEEN e.time - 80 AND e.time + 80) WHERE r = 1""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = scan.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("time")).distinct()
    s = scan.table(spark, d, "lineitem").groupBy(F.date_add(F.date_trunc("month", "l_shipdate").cast("date"), 14).alias("time")).agg(F.sum("l_extendedprice").alias("value"))
    return ordered.asof_nearest(e, s, "time", "value").select("time", F.round("value", 2).alias("value"))


@query("asof_nearest_gaps", """WITH e AS (SELECT l_orderkey, l_linenumber, l_shipdate::TIMESTAMP AS time FROM lineitem), s AS (SELECT o_orderdate::TIMESTAMP AS time, min(o_totalprice) AS value FROM orders WHERE month(o_orderdate) = 7 AND year(o_orderdate) % 2 = 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, e.time, round(CASE WHEN b.time IS NULL OR a.time - e.time < e.time - b.time THEN a.value ELSE b.value END, 2) AS value
FROM e ASOF LEFT JOIN s b ON e.time >= b.time ASOF LEFT JOIN s a ON e.time <= a.time""")
def asof_nearest_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the largest table against a series that is silent for 23 months of two years."""
    e = scan.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("time"))
    s = scan.table(spark, d, "orders").filter((F.month("o_orderdate") == 7) & (F.year("o_orderdate") % 2 == 0)).select(F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    return ordered.asof_nearest(e, s, "time", "value").select("l_orderkey", "l_linenumber", "time", F.round("value", 2).alias("value"))


@query("missing_anti", "SELECT year FROM (SELECT unnest(range(1990, 2010))::INT AS year) WHERE year NOT IN (SELECT year(o_orderdate) FROM orders)")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(1990, 2010).select(F.col("id").cast("int").alias("year"))
    return scan.missing_years(expected, scan.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")))


MONTHS = [("AFRICA", [1, 4]), ("AMERICA", [7, 10]), ("ASIA", [1]), ("EUROPE", [1, 4, 7, 10])]


@query("season_mask_panel", sql("SELECT t::INT AS t, season, var, round(coalesce(value, 0), 4) AS value, CASE var WHEN 'AFRICA' THEN month(season) NOT IN (1, 4) WHEN 'AMERICA' THEN month(season) NOT IN (7, 10) WHEN 'ASIA' THEN month(season) NOT IN (1) ELSE false END AS masked FROM panel"))
def season_mask_panel(spark: SparkSession, d: str) -> DataFrame:
    months = spark.createDataFrame(MONTHS, "var string, months array<int>")
    return align.season_mask(data.panel(spark, d), months).select("t", "season", "var", r4("value"), "masked")


@query("panel_edge_mask", sql("""SELECT t::INT AS t, var, CASE var WHEN 'AFRICA' THEN t = last - 2 WHEN 'AMERICA' THEN t = last - 1 WHEN 'ASIA' THEN t = last WHEN 'EUROPE' THEN t = 1 ELSE t = 0 END AS masked FROM panel, (SELECT max(t) AS last FROM panel)"""))
def panel_edge_mask(spark: SparkSession, d: str) -> DataFrame:
    p = data.panel(spark, d)
    group = F.element_at(F.create_map(*(F.lit(x) for pair in zip(VOTERS, ("JJA", "SON", "DJF", "EFFECT"), strict=True) for x in pair)), F.col("var"))
    last = F.broadcast(p.agg(F.max("t").alias("last")))
    return p.crossJoin(last).select("t", "var", align.edge_exclusion(F.col("t"), F.col("last"), F.coalesce(group, F.lit("JJA1"))).alias("masked"))


@query("effective_samples", sql("SELECT var, count(*) FILTER (NOT CASE var WHEN 'AFRICA' THEN month(season) NOT IN (1, 4) WHEN 'AMERICA' THEN month(season) NOT IN (7, 10) WHEN 'ASIA' THEN month(season) NOT IN (1) ELSE false END) AS n FROM panel GROUP BY var"))
def effective_samples(spark: SparkSession, d: str) -> DataFrame:
    return align.effective_samples(align.season_mask(data.panel(spark, d), spark.createDataFrame(MONTHS, "var string, months array<int>")))


@query("design_matrix", sql("SELECT y.t::INT AS t, round(y.value, 4) AS y, round(a.value, 4) AS x0, round(b.value, 4) AS x1 FROM panel y LEFT JOIN panel a ON a.var = 'EUROPE' AND a.t = y.t - 3 LEFT JOIN panel b ON b.var = 'ASIA' AND b.t = y.t - 1 WHERE y.var = 'ASIA'"))
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    return align.design_matrix(data.panel(spark, d), "ASIA", [("EUROPE", 3), ("ASIA", 1)]).select("t", r4("y"), r4("x0"), r4("x1"))


# calculus


@query("central_diff", sql("""SELECT season, lat, lon, round(CASE WHEN a IS NULL THEN (fb - f) / (b - x) WHEN b IS NULL THEN (f - fa) / (x - a) ELSE ((x - a) * (x - a) * fb + ((b - x) * (b - x) - (x - a) * (x - a)) * f - (b - x) * (b - x) * fa) / ((x - a) * (b - x) * (b - a)) END, 4) AS d
  FROM (SELECT season, lat, lon, lon AS x, value AS f, lag(lon) OVER w AS a, lead(lon) OVER w AS b, lag(value) OVER w AS fa, lead(value) OVER w AS fb FROM g WINDOW w AS (PARTITION BY season, lat ORDER BY lon)) WHERE coalesce(a, b) IS NOT NULL""", CYCLIC))
def central_diff(spark: SparkSession, d: str) -> DataFrame:
    return calculus.central_diff(_square(spark, d), ["season", "lat"], "lon").filter("d is not null").select("season", "lat", "lon", r4("d"))


@query("cumtrapz", sql("SELECT season, lon, lat, round(sum(coalesce((value + p) / 2 * (lat - q), 0)) OVER (PARTITION BY season, lon ORDER BY lat), 4) AS psi FROM (SELECT *, lag(value) OVER w AS p, lag(lat) OVER w AS q FROM g WINDOW w AS (PARTITION BY season, lon ORDER BY lat))", CYCLIC))
def cumtrapz(spark: SparkSession, d: str) -> DataFrame:
    return calculus.cumtrapz(_square(spark, d), ["season", "lon"], "lat").select("season", "lon", "lat", r4("psi"))


@query("mass_streamfunction", sql("""SELECT season, lat, level, round(sum(coalesce((f + p) / 2 * (level - q), 0)) OVER (PARTITION BY season, lat ORDER BY level) / 1e9, 4) AS psi FROM (
  SELECT *, lag(f) OVER w AS p, lag(level) OVER w AS q FROM (SELECT season, lat, lon + 200 AS level, value * (2 * 3.141592653589793 * 6.371e6 / 9.80665) * cos(radians(lat)) AS f FROM g) WINDOW w AS (PARTITION BY season, lat ORDER BY level))""", CYCLIC))
def mass_streamfunction(spark: SparkSession, d: str) -> DataFrame:
    levels = _square(spark, d).select("season", "lat", (F.col("lon") + 200).alias("level"), "value")
    return calculus.mass_streamfunction(levels, ["season"]).select("season", "lat", "level", r4(F.col("psi") / 1e9, "psi"))


@query("linear_interp", sql("SELECT season, lat, (k * 24.0)::DOUBLE AS lon, round(f0 + (f1 - f0) * (k * 24.0 - x0) / (x1 - x0), 4) AS value FROM (SELECT *, unnest(generate_series(ceil(x0 / 24)::BIGINT, CASE WHEN last THEN floor(x1 / 24)::BIGINT ELSE ceil(x1 / 24)::BIGINT - 1 END)) AS k FROM (SELECT season, lat, lon AS x0, value AS f0, lead(lon) OVER w AS x1, lead(value) OVER w AS f1, lead(lon, 2) OVER w IS NULL AS last FROM g WINDOW w AS (PARTITION BY season, lat ORDER BY lon)) WHERE x1 IS NOT NULL)", CYCLIC))
def linear_interp(spark: SparkSession, d: str) -> DataFrame:
    return calculus.linear_interp(_square(spark, d), ["season", "lat"], "lon", 24.0).select("season", "lat", "lon", r4("value"))


@query("barometric", "SELECT c_custkey AS cell, round(1013.25 * pow(1 - c_custkey % 9000 * (0.0065 / 288.15), 9.80665 * 0.0289644 / (8.31447 * 0.0065)), 4) AS pressure FROM customer")
def barometric(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), r4(calculus.barometric(F.col("c_custkey") % 9000), "pressure"))


@query("bilinear_regrid", sql("""SELECT season, tlat, tlon, CASE WHEN count(value) = any_value(need) THEN round(sum(value * w), 4) END AS value FROM (SELECT *, count(*) OVER (PARTITION BY tlat, tlon) AS need FROM (SELECT tlat, tlon, iy + dy AS iy, ix + dx AS ix, (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) AS w FROM (SELECT tlat, tlon, floor(tlat)::BIGINT AS iy, floor((tlon + 180) / 72)::BIGINT AS ix, tlat - floor(tlat) AS fy, (tlon + 180) / 72 - floor((tlon + 180) / 72) AS fx FROM (SELECT unnest([0.5, 1.25, 3.0])::DOUBLE AS tlat), (SELECT unnest([-150.0, -36.0, 60.0])::DOUBLE AS tlon)), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)) WHERE w > 0) n
  JOIN g ON g.lat = iy AND round((g.lon + 180) / 72)::BIGINT = ix GROUP BY season, tlat, tlon""", CYCLIC))
def bilinear_regrid(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(a, b) for a in (0.5, 1.25, 3.0) for b in (-150.0, -36.0, 60.0)], "tlat double, tlon double")
    return grid.bilinear(_square(spark, d), targets, 1.0, 72.0, 0.0, -180.0, ["season"]).select("season", "tlat", "tlon", r4("value"))


def _diff_sql(out: str, f: str, x: str, keys: str, src: str) -> str:
    a, b, fa, fb = f"lag({x}) OVER w", f"lead({x}) OVER w", f"lag({f}) OVER w", f"lead({f}) OVER w"
    return f"SELECT *, CASE WHEN {a} IS NULL THEN ({fb} - {f}) / ({b} - {x}) WHEN {b} IS NULL THEN ({f} - {fa}) / ({x} - {a}) ELSE (({x} - {a}) * ({x} - {a}) * {fb} + (({b} - {x}) * ({b} - {x}) - ({x} - {a}) * ({x} - {a})) * {f} - ({b} - {x}) * ({b} - {x}) * {fa}) / (({x} - {a}) * ({b} - {x}) * ({b} - {a})) END AS {out} FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {x})"


WAF = (
    "w0 AS (SELECT season, (cell % 5) * 20 + 10.0::DOUBLE AS lat, (cell // 5) * 72.0::DOUBLE - 180 AS lon, anom * 100 AS psi, 10 + (cell % 7)::DOUBLE AS u, (cell % 3) - 1.0::DOUBLE AS v FROM anom), "
    f"w1 AS ({_diff_sql('px', 'psi', 'lon', 'season, lat', 'w0')}), w2 AS ({_diff_sql('py', 'psi', 'lat', 'season, lon', 'w1')}), w3 AS ({_diff_sql('pxx', 'px', 'lon', 'season, lat', 'w2')}), w4 AS ({_diff_sql('pxy', 'px', 'lat', 'season, lon', 'w3')}), w5 AS ({_diff_sql('pyy', 'py', 'lat', 'season, lon', 'w4')}), "
    "w6 AS (SELECT season, lat, lon, u, v, cos(radians(lat)) AS c, 0.2 * cos(radians(lat)) / (2 * sqrt(u * u + v * v) * 6.371e6 * 6.371e6) AS s, (px * px - psi * pxx) / pow(3.141592653589793 / 180, 2) AS xx, (px * py - psi * pxy) / pow(3.141592653589793 / 180, 2) AS xy, (py * py - psi * pyy) / pow(3.141592653589793 / 180, 2) AS yy FROM w5)"
)


@query("waf_flux", sql("SELECT season, lat, lon, round(s * (u / (c * c) * xx + v / c * xy) / 1e6, 4) + 0.0 AS wx, round(s * (u / c * xy + v * yy) / 1e6, 4) + 0.0 AS wy FROM w6", WAF))
def waf_flux(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cell")
    w0 = data.anom(spark, d).select("season", (c % 5 * 20 + F.lit(10.0)).alias("lat"), (F.floor(c / 5) * F.lit(72.0) - 180).alias("lon"), (F.col("anom") * 100).alias("psi"), (10 + (c % 7).cast("double")).alias("u"), (c % 3 - F.lit(1.0)).alias("v"))
    return calculus.wave_activity_flux(w0, ["season"]).select("season", "lat", "lon", r4(F.col("wx") / 1e6, "wx"), r4(F.col("wy") / 1e6, "wy"))


# regression and tests

ONTO = "yx AS (SELECT a.season, a.cell, a.anom AS y, i.value AS x, j.value AS x2 FROM anom a JOIN idx i ON a.season = i.season AND i.name = 'EUROPE' JOIN idx j ON a.season = j.season AND j.name = 'ASIA')"


def _onto(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's anomaly beside two index series (a few hundred rows, joined by season)."""
    x = data.idx(spark, d).filter(F.col("name").isin("EUROPE", "ASIA")).groupBy("season").pivot("name", ["EUROPE", "ASIA"]).agg(F.first("value")).filter("EUROPE is not null and ASIA is not null")
    return data.anom(spark, d).join(x, "season").select("season", "cell", F.col("anom").alias("y"), F.col("EUROPE").alias("x"), F.col("ASIA").alias("x2"))


@query("slope_map", sql("SELECT cell, round(CASE WHEN regr_count(y, x) >= 3 THEN regr_slope(y, x) END, 4) AS slope, round(CASE WHEN regr_count(y, x) >= 3 THEN regr_r2(y, x) END, 4) AS r2, regr_count(y, x)::BIGINT AS n FROM yx GROUP BY cell", ONTO))
def slope_map(spark: SparkSession, d: str) -> DataFrame:
    return stats.slope_map(_onto(spark, d), ["cell"]).select("cell", r4("slope"), r4("r2"), "n")


@query("slope_significance", sql("SELECT cell, round(b, 4) AS slope, round(se, 4) AS se, round(b / nullif(se, 0), 4) AS t, abs(b / nullif(se, 0)) >= 2.0 AS significant FROM (SELECT cell, regr_slope(y, x) AS b, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / nullif(regr_count(y, x) - 2, 0) / nullif(regr_sxx(y, x), 0)) AS se FROM yx GROUP BY cell)", ONTO))
def slope_significance(spark: SparkSession, d: str) -> DataFrame:
    return stats.slope_significance(_onto(spark, d), ["cell"], F.lit(2.0)).select("cell", r4("slope"), r4("se"), r4("t"), "significant")


@query("remove_signal_1", sql("SELECT season, yx.cell, round(y - my - b * (x - mx), 4) AS residual FROM yx JOIN (SELECT cell, avg(y) AS my, avg(x) AS mx, regr_slope(y, x) AS b FROM yx GROUP BY cell) s ON yx.cell = s.cell", ONTO))
def remove_signal_1(spark: SparkSession, d: str) -> DataFrame:
    return stats.remove_signal(_onto(spark, d), ["cell"], ["x"]).select("season", "cell", r4("residual"))


@query("remove_signal_2", sql("""SELECT season, yx.cell, round(y - my - (s01 * s22 - s02 * s12) / det * (x - m1) - (s02 * s11 - s01 * s12) / det * (x2 - m2), 4) AS residual FROM yx JOIN (
  SELECT *, s11 * s22 - s12 * s12 AS det FROM (SELECT cell, avg(y) AS my, avg(x) AS m1, avg(x2) AS m2, covar_pop(y, x) AS s01, covar_pop(y, x2) AS s02, var_pop(x) AS s11, var_pop(x2) AS s22, covar_pop(x, x2) AS s12 FROM yx GROUP BY cell)) s ON yx.cell = s.cell""", ONTO))
def remove_signal_2(spark: SparkSession, d: str) -> DataFrame:
    return stats.remove_signal(_onto(spark, d), ["cell"], ["x", "x2"]).select("season", "cell", r4("residual"))


@query("remove_unless_gaps", sql("SELECT yx.season, yx.cell, round(CASE WHEN yx.cell % 4 = 0 THEN g.y ELSE g.y - my - b * (x - mx) END, 4) AS residual FROM yx JOIN (SELECT season, cell, CASE WHEN cell % 4 = 0 AND month(season) = 7 THEN NULL ELSE y END AS y FROM yx) g ON g.season = yx.season AND g.cell = yx.cell JOIN (SELECT cell, avg(y) AS my, avg(x) AS mx, regr_slope(y, x) AS b FROM yx GROUP BY cell) s ON yx.cell = s.cell", ONTO))
def remove_unless_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = _onto(spark, d).withColumn("y", F.when(~((F.col("cell") % 4 == 0) & (F.month("season") == 7)), F.col("y")))
    return stats.remove_unless_gaps(gaps, ["cell"], "x").select("season", "cell", r4("residual"))


@query("welch_t", sql("""SELECT cell, round((ma - mb) / nullif(sqrt(qa + qb), 0), 4) AS t, round(pow(qa + qb, 2) / nullif(qa * qa / nullif(na - 1, 0) + qb * qb / nullif(nb - 1, 0), 0), 4) AS df FROM (SELECT cell, avg(anom) FILTER (month(season) = 1) AS ma, avg(anom) FILTER (month(season) = 7) AS mb, var_samp(anom) FILTER (month(season) = 1) / count(*) FILTER (month(season) = 1) AS qa, var_samp(anom) FILTER (month(season) = 7) / count(*) FILTER (month(season) = 7) AS qb, count(*) FILTER (month(season) = 1) AS na, count(*) FILTER (month(season) = 7) AS nb FROM (SELECT season, cell, value AS anom FROM sea) GROUP BY cell)"""))
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    s = data.sea(spark, d).withColumn("m", F.month("season"))
    return stats.welch(s, ["cell"], "m", 1, 7).select("cell", r4("t"), r4("df"))


@query("ttest_1samp", sql("SELECT cell, round((avg(value) - 200000) / nullif(stddev_samp(value) / sqrt(count(value)), 0), 4) AS t, count(value) - 1 AS df FROM sea GROUP BY cell"))
def ttest_1samp(spark: SparkSession, d: str) -> DataFrame:
    return stats.ttest_1samp(data.sea(spark, d), ["cell"], mean=200000.0).select("cell", r4("t"), "df")


@query("bh_fdr", sql("SELECT cause, effect, lag, run_idx, round(p_value, 9) AS p_value, round(least(1.0, min(q) OVER (PARTITION BY run_idx ORDER BY p_value DESC, q ROWS UNBOUNDED PRECEDING)), 9) AS q_value FROM (SELECT *, p_value * count(*) OVER (PARTITION BY run_idx) / row_number() OVER (PARTITION BY run_idx ORDER BY p_value, cause, effect, lag) AS q FROM (SELECT * REPLACE (p_value + (hash_no * 1e-7) AS p_value) FROM (SELECT *, row_number() OVER (ORDER BY cause, effect, lag, run_idx) AS hash_no FROM runs)))"))
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    runs = data.runs(spark, d)
    number = F.row_number().over(Window.orderBy("cause", "effect", "lag", "run_idx"))  # a few hundred edges
    p = runs.withColumn("p_value", F.col("p_value") + number * F.lit(1e-7))
    return stats.bh_fdr(p, ["run_idx"]).select("cause", "effect", "lag", "run_idx", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"))


@query("bh_fdr_one_family", """WITH p AS (SELECT l_orderkey, l_linenumber, ((l_extendedprice * 100)::BIGINT % 99991) / 99991.0::DOUBLE * l_discount AS p_value FROM lineitem),
q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, l_orderkey, l_linenumber) AS q FROM p)
SELECT l_orderkey, l_linenumber, round(least(1.0, min(q) OVER (ORDER BY p_value DESC, l_orderkey DESC, l_linenumber DESC ROWS UNBOUNDED PRECEDING)), 7) AS q_value FROM q""")
def bh_fdr_one_family(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the largest table are one family; a tenth of them tie at 0."""
    p = F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(99991)) / F.lit(99991.0) * F.col("l_discount")
    rows = scan.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p_value"))
    return ordered.bh_fdr(rows, []).select("l_orderkey", "l_linenumber", F.round("q_value", 7).alias("q_value"))


@query("lasso_fixed")
def lasso_fixed(spark: SparkSession, d: str) -> DataFrame:
    return stats.lasso_fixed(season.zscore(season.zscore(_onto(spark, d), [], "x", "x"), [], "x2", "x2"), ["cell"], "y", ["x", "x2"], 1000.0)


@query("lasso_cv_alpha_median")
def lasso_cv_alpha_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.lasso_cv_alpha(_onto(spark, d), ["cell"], "y", ["x", "x2"], order="season").agg(F.median("alpha").alias("alpha"))


# composites

EVENTS = YEARS + ", ev AS (SELECT * FROM (SELECT year, 'high' AS kind FROM yr WHERE name = 'ASIA' ORDER BY value DESC, year DESC LIMIT 3) UNION ALL SELECT * FROM (SELECT year, 'low' FROM yr WHERE name = 'ASIA' ORDER BY value, year LIMIT 3))"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return season.extreme_years(_years(spark, d).filter("name = 'ASIA'").drop("name"), 3).select("year", "kind")


@query("composite_high_low_diff", sql("SELECT cell, m, round(avg(anom) FILTER (kind = 'high'), 4) AS high, round(avg(anom) FILTER (kind = 'low'), 4) AS low, round(avg(anom) FILTER (kind = 'high') - avg(anom) FILTER (kind = 'low'), 4) AS diff FROM (SELECT cell, month(season)::INT AS m, year(season) AS year, anom FROM anom) JOIN ev USING (year) GROUP BY cell, m", EVENTS))
def composite_high_low_diff(spark: SparkSession, d: str) -> DataFrame:
    field = data.anom(spark, d).select("cell", F.month("season").alias("m"), F.year("season").alias("year"), F.col("anom").alias("value"))
    return composite.high_low(field, _events(spark, d), ["cell", "m"]).select("cell", "m", r4("high"), r4("low"), r4("diff"))


@query("contributing_years", sql("SELECT kind, string_agg(year::VARCHAR, ';' ORDER BY year) AS years, count(*) AS n FROM ev GROUP BY kind", EVENTS))
def contributing_years(spark: SparkSession, d: str) -> DataFrame:
    return composite.contributing_years(_events(spark, d), ["kind"])


@query("composite_stamps", sql("SELECT year, kind, s, (year + o + CASE WHEN code = 'DJF' THEN 1 ELSE 0 END)::INT AS stamp_year FROM ev, (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in composite.SEQUENCE) + ") q(s, code, o)", EVENTS))
def composite_stamps(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(a).alias("s"), F.lit(b).alias("code"), F.lit(c).alias("o")) for a, b, c in composite.SEQUENCE))
    return _events(spark, d).select("year", "kind", F.explode(steps).alias("q")).select("year", "kind", "q.s", composite.stamp_year(F.col("year"), F.col("q.code"), F.col("q.o")).alias("stamp_year"))


@query("wind_mask_or", sql("SELECT season, cell, CASE WHEN pu < 0.3 OR pv < 0.2 * 1.5 THEN round(anom, 4) END AS u FROM (SELECT *, (cell * 7 % 10) / 10.0::DOUBLE AS pu, (cell * 3 % 10) / 10.0::DOUBLE AS pv FROM anom)"))
def wind_mask_or(spark: SparkSession, d: str) -> DataFrame:
    p = lambda k: F.col("cell") * k % 10 / F.lit(10.0)
    u, _ = composite.wind_mask(F.col("anom"), F.col("anom"), p(7), p(3), 0.3)
    return data.anom(spark, d).select("season", "cell", r4(u, "u"))
