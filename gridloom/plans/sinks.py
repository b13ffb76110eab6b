"""Named queries over what is written: each writes with a sink and gives what is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import edges, season, stats
from gridloom.plans import carriers as data
from gridloom.plans.carriers import sql
from gridloom.plans.causal import PERSISTENCE, r4, r6
from gridloom.plans.climate import ONTO, _onto
from gridloom.plans.programs import CLOSED, FOLDS
from gridloom.plans.registry import query
from gridloom.sources import scan, schemas
from gridloom.sources.results import shared_path


@query("field_sink", sql("SELECT season, cell, round(value, 6) AS value, year(season)::INT AS year FROM sea WHERE year(season) BETWEEN 1996 AND 1998"))
def field_sink(spark: SparkSession, d: str) -> DataFrame:
    """A field in partitions of a year, of which three are read."""
    path = shared_path(spark, "field")
    scan.write_field(data.sea(spark, d).withColumn("year", F.year("season")), path, ("year",))
    return scan.results(spark, path).filter(F.col("year").between(1996, 1998)).select("season", "cell", F.round("value", 6).alias("value"), "year")


@query("year_files", sql("SELECT season, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value / 1000, 6) AS value FROM sea WHERE year(season) IN (1996, 1997) AND lat BETWEEN -40 AND 40"))
def year_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of single years, whose columns are named in two ways, as one normalised field."""
    field, paths = data.sea(spark, d), []
    for year, old in ((1996, True), (1997, False)):
        own = field.filter(F.year("season") == year).select(F.col("season").alias("valid_time" if old else "time"), F.col("lat").alias("latitude" if old else "lat"), F.col("lon").alias("longitude" if old else "lon"), F.col("value").alias("tp"))
        paths.append(shared_path(spark, f"year-{year}"))
        scan.write_field(own, paths[-1])
    return scan.scan_many(spark, paths, var="tp", scale=0.001, lat=(-40, 40)).select(F.col("time").alias("season"), r4("lat"), r4("lon"), F.round("value", 6).alias("value"))


@query("edges_file", sql('SELECT cause AS "Cause", effect AS "Effect", lag AS "Lag", round(causal_effect, 4) AS "Causal_Effect", round(p_value, 4) AS p_value FROM runs WHERE run_idx = 0'))
def edges_file(spark: SparkSession, d: str) -> DataFrame:
    """The edge interchange file, written and read."""
    path = shared_path(spark, "edges-csv")
    scan.write_edges(data.runs(spark, d).filter("run_idx = 0").withColumnRenamed("causal_effect", "effect_size"), path)
    return spark.read.schema(schemas.EDGE_CSV).csv(path, header=True).select("Cause", "Effect", F.col("Lag").cast("int").alias("Lag"), r4("Causal_Effect"), r4("p_value"))


@query("persistence_files", sql("SELECT count(*) AS edges, count(*) FILTER (is_persistent) AS persistent, round(avg(persistence_ratio), 6) AS mean_ratio, round(median(persistence_ratio), 6) AS median_ratio FROM ep", PERSISTENCE))
def persistence_files(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a persistence analysis, from its files."""
    table = edges.persistence(data.runs(spark, d), least_ratio=0.5)
    return scan.write_persistence(table, shared_path(spark, "persistence")).select("edges", "persistent", r6("mean_ratio"), r6("median_ratio"))


@query("sidecar", sql("""SELECT 'anomalies' AS script, '{"base": [1995, 2001], "ddof": 0}' AS parameters, substr(md5('{"base": [1995, 2001], "ddof": 0}'), 1, 8) AS hash, count(*) AS rows FROM anom"""))
def sidecar(spark: SparkSession, d: str) -> DataFrame:
    """What is told beside a result: what made it, with which parameters, and how many rows it has; read from the registry that it is added to."""
    path = shared_path(spark, "sidecar")
    scan.write_with_sidecar(data.anom(spark, d).select("season", "cell", "anom"), f"{path}/field", "anomalies", {"ddof": 0, "base": [1995, 2001]}, f"{path}/registry")
    return scan.recent(spark.read.json(f"{path}/registry"), 5).select("script", "parameters", "hash", "rows")


@query("file_check", "SELECT 'orders' AS name, count(*) > 0 AS ok FROM orders UNION ALL SELECT 'nothing', count(*) > 0 FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 'lost', false")
def file_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether files can be read and have rows: a table, one without rows, and none."""
    path = shared_path(spark, "checked")
    scan.table(spark, d, "orders").filter("o_orderkey < 0").write.parquet(f"{path}/nothing")
    found = scan.readable(spark, [f"{d}/orders.parquet", f"{path}/nothing", f"{path}/lost"])
    return spark.createDataFrame([(p.rsplit("/", 1)[1].removesuffix(".parquet"), ok) for p, ok in found.items()], "name string, ok boolean")


@query("valid_requests", "SELECT c_custkey, (c_custkey % 15 > 0 AND c_custkey % 15 <= 10) AS grid, (c_nationkey * 9 - 100 >= -90 AND c_nationkey * 9 - 100 < 80 AND c_custkey % 700 - 300 BETWEEN -180 AND 360 AND c_custkey % 700 - 300 <> 40) AS area FROM customer")
def valid_requests(spark: SparkSession, d: str) -> DataFrame:
    """Grids and areas that may be asked for."""
    step, south, west = F.col("c_custkey") % 15, F.col("c_nationkey") * 9 - 100, F.col("c_custkey") % 700 - 300
    return scan.table(spark, d, "customer").select("c_custkey", scan.grid_ok(F.array(step, F.lit(1))).alias("grid"), scan.area_ok(F.array(F.lit(80), west, south, F.lit(40))).alias("area"))


@query("lasso_alpha_of_region", sql("SELECT round(median(alpha) / 1e6, 4) AS alpha FROM al JOIN be USING (cell, i) WHERE cell % 2 = 0", ONTO + ", " + CLOSED + ", " + FOLDS))
def lasso_alpha_of_region(spark: SparkSession, d: str) -> DataFrame:
    """The median over half of the cells of their cross-validated penalties."""
    own = stats.lasso_cv_alpha(_onto(spark, d).filter("cell % 2 = 0"), ["cell"], "y", ["x"], order="season")
    return own.agg(r4(F.median("alpha") / 1e6, "alpha"))


@query("season_stamps", "SELECT o_orderkey, date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH)::DATE AS season, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM' WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS name FROM orders")
def season_stamps(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "orders").select("o_orderkey", season.stamp(F.col("o_orderdate")).alias("season"), season.season_name(F.month("o_orderdate")).alias("name"))


@query("error_kinds", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'server' WHEN 3 THEN 'network' WHEN 4 THEN 'auth' WHEN 5 THEN 'request' WHEN 6 THEN 'disk' ELSE 'unknown' END AS kind, event_id % 9 NOT IN (4, 5, 6) AS retry, [60, 300, 120, 30, 0, 0, 0, 60, 60][event_id % 9 + 1]::INT AS wait_s FROM events")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all kinds, whether to try again, and after how long."""
    said = F.array(*map(F.lit, ("Read TIMED OUT", "Too many requests", "Server error", "host Unreachable", "Unauthorized", "bad request: x", "No space left", "odd", "")))
    return scan.table(spark, d, "events").select("event_id", scan.error_class(F.get(said, (F.col("event_id") % 9).cast("int"))).alias("e")).select("event_id", "e.kind", "e.retry", F.col("e.wait_s").alias("wait_s"))
