"""The tables that the named queries run on: a field, index series, a panel and edge runs made from the order tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import grid, season
from gridloom.sources.scan import table


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values as observations ``time, cell, lat, lon, value`` at a place per nation."""
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    c = F.col("cell")
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value")).join(cells, "o_custkey").select("time", "cell", (F.lit(-60.0) + c * 5).alias("lat"), grid.wrap_lon(c * F.lit(14.4)).alias("lon"), "value")


PLACE = ["cell", "lat", "lon"]


def mon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.monthly(raw(spark, sf_dir), PLACE)


def sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.seasonal(mon(spark, sf_dir), PLACE)


def anom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.anomaly(sea(spark, sf_dir), ["cell"])


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index series ``season, name, value``: mean anomaly by region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.trim("r_name").alias("name"))
    places = nation.join(F.broadcast(region), "n_regionkey")
    return anom(spark, sf_dir).join(F.broadcast(places), "cell").groupBy("season", "name").agg(F.avg("anom").alias("value"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, season, var, value`` with a dense time step."""
    series = idx(spark, sf_dir)
    axis = season.calendar(series)
    return series.join(F.broadcast(axis), "season").select("t", "season", F.col("name").alias("var"), "value")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge runs from order groups: four runs of falling alpha."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.trim("c_mktsegment").alias("effect"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.trim("o_orderpriority").alias("cause"), (1 + F.col("o_orderkey") % 6).cast("int").alias("lag"), (F.col("o_orderkey") % 4).cast("int").alias("run_idx"))
    g = o.join(customers, "o_custkey").groupBy("cause", "effect", "lag", "run_idx").agg(F.sum("o_custkey").alias("s"))
    alpha = F.element_at(F.array(*(F.lit(a) for a in (0.05, 0.025, 0.015, 0.01))), F.col("run_idx") + 1)
    return g.select("cause", "effect", "lag", alpha.alias("alpha"), "run_idx", ((F.col("s") % 1201 - 400) / 1000.0).alias("causal_effect"), (F.col("s") * 7919 % 97 / 2000.0).alias("p_value"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the nations' series ``cause, effect, lag, link``: of all pairs and lags those whose orders are dearest on average."""
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = e.groupBy(F.concat(F.lit("v"), F.col("c_nationkey")).alias("cause"), F.concat(F.lit("v"), (F.col("o_custkey") + F.col("o_orderkey")) % 25).alias("effect"), (1 + F.col("o_orderkey") % 3).cast("int").alias("lag")).agg(F.avg("o_totalprice").alias("x"))
    rank = F.percent_rank().over(Window.orderBy("x"))  # at most 25 x 25 x 3 rows
    return pairs.withColumn("r", rank).filter("r > 0.8").select("cause", "effect", "lag", F.lit("-->").alias("link"))


BASE = """raw AS (SELECT o_orderdate AS time, c_nationkey AS cell, -60.0 + c_nationkey * 5 AS lat, ((c_nationkey * 14.4::DOUBLE + 180) % 360) - 180 AS lon, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey),
mon AS (SELECT date_trunc('month', time) AS time, cell, lat::DOUBLE AS lat, lon, avg(value) AS value FROM raw GROUP BY ALL),
sea AS (SELECT date_trunc('quarter', time + INTERVAL 1 MONTH)::DATE AS season, cell, lat, lon, avg(value) AS value FROM mon GROUP BY ALL),
anom AS (SELECT *, value - avg(value) OVER (PARTITION BY cell, month(season)) AS anom FROM sea),
idx AS (SELECT season, trim(r_name) AS name, avg(anom) AS value FROM anom JOIN nation ON n_nationkey = cell JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
axis AS (SELECT row_number() OVER (ORDER BY season) - 1 AS t, season FROM (SELECT unnest(generate_series((SELECT min(season) FROM idx), (SELECT max(season) FROM idx), INTERVAL 3 MONTH))::DATE AS season)),
panel AS (SELECT t, season, name AS var, value FROM idx JOIN axis USING (season)),
runs AS (SELECT cause, effect, lag, [0.05, 0.025, 0.015, 0.01][run_idx + 1]::DOUBLE AS alpha, run_idx, (s % 1201 - 400) / 1000.0::DOUBLE AS causal_effect, (s * 7919 % 97) / 2000.0::DOUBLE AS p_value
  FROM (SELECT trim(o_orderpriority) AS cause, trim(c_mktsegment) AS effect, (1 + o_orderkey % 6)::INT AS lag, (o_orderkey % 4)::INT AS run_idx, sum(o_custkey)::BIGINT AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
edges AS (SELECT cause, effect, lag, '-->' AS link FROM (SELECT cause, effect, lag, percent_rank() OVER (ORDER BY x) AS r FROM (
  SELECT 'v' || c_nationkey AS cause, 'v' || ((o_custkey + o_orderkey) % 25) AS effect, (1 + o_orderkey % 3)::INT AS lag, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE r > 0.8)
"""


def sql(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{', ' + more if more else ''} {select}"
