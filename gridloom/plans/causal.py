"""Named queries over edges, modes, forecasts, winds, regions and events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import edges as ops
from gridloom.operators import forecast, modes, panel as align, pcmci, region_search, season, sphere
from gridloom.plans import carriers as data
from gridloom.plans.carriers import sql
from gridloom.plans.registry import query
from gridloom.sources import scan
from gridloom.streaming import windows


def r4(c, name: str | None = None):
    return (F.round(F.col(c) if isinstance(c, str) else c, 4) + 0.0).alias(name or c)


def r6(c, name: str | None = None):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0).alias(name or c)


PERSISTENCE = """ep AS (SELECT *, coalesce(persistence_ratio >= 0.5, false) AS is_persistent, coalesce(avg_p_value <= 0.05, false) AS has_low_pvalue, coalesce(effect_consistency >= 0.9, false) AS is_consistent, coalesce(abs_effect >= 0.15, false) AS has_strong_effect FROM (
  SELECT cause, effect, lag, hits / runs AS persistence_ratio, avg_effect, abs(avg_effect) AS abs_effect, avg_p_value,
    CASE WHEN hits > 0 THEN (CASE WHEN abs(avg_effect) <= 1e-8 THEN greatest(pos, neg) WHEN avg_effect > 0 THEN pos ELSE neg END) / hits END AS effect_consistency
  FROM (SELECT cause, effect, lag, count(*) FILTER (p_value <= alpha) AS hits, count(DISTINCT run_idx) AS runs, avg(causal_effect) FILTER (p_value <= alpha) AS avg_effect, avg(p_value) FILTER (p_value <= alpha) AS avg_p_value, count(*) FILTER (p_value <= alpha AND causal_effect > 0) AS pos, count(*) FILTER (p_value <= alpha AND causal_effect < 0) AS neg FROM runs GROUP BY ALL)))"""
FLAGS = ["is_persistent", "has_low_pvalue", "is_consistent", "has_strong_effect"]


@query("edge_persistence", sql("SELECT cause, effect, lag, round(persistence_ratio, 6) AS persistence_ratio, round(avg_effect, 6) + 0.0 AS avg_effect, round(abs_effect, 6) AS abs_effect, round(avg_p_value, 6) AS avg_p_value, round(effect_consistency, 6) AS effect_consistency, is_persistent, has_low_pvalue, is_consistent, has_strong_effect, is_persistent AND has_low_pvalue AND is_consistent AND has_strong_effect AS is_robust FROM ep", PERSISTENCE))
def edge_persistence(spark: SparkSession, d: str) -> DataFrame:
    return ops.persistence(data.runs(spark, d), least_ratio=0.5).select("cause", "effect", "lag", *(r6(c) for c in ("persistence_ratio", "avg_effect", "abs_effect", "avg_p_value", "effect_consistency")), *FLAGS, "is_robust")


@query("edge_persistence_total", sql("SELECT cause, effect, lag, round(hits / 4, 6) AS persistence_ratio FROM (SELECT cause, effect, lag, count(*) FILTER (p_value <= alpha) AS hits FROM runs GROUP BY ALL)"))
def edge_persistence_total(spark: SparkSession, d: str) -> DataFrame:
    return ops.persistence(data.runs(spark, d), denominator="total", total=4).select("cause", "effect", "lag", r6("persistence_ratio"))


@query("robust_edges", sql("SELECT cause, effect, lag, round(avg_effect, 6) AS effect_size, round(avg_p_value, 6) AS p_value, '-->' AS link FROM ep WHERE is_persistent AND has_low_pvalue AND is_consistent AND has_strong_effect", PERSISTENCE))
def robust_edges(spark: SparkSession, d: str) -> DataFrame:
    return ops.robust(ops.persistence(data.runs(spark, d), least_ratio=0.5)).select("cause", "effect", "lag", r6("effect_size"), r6("p_value"), "link")


@query("persistence_summary", sql("SELECT count(*) AS n, count(*) FILTER (is_persistent) AS n_persistent, round(avg(persistence_ratio), 6) AS mean_ratio, round(median(persistence_ratio), 6) AS median_ratio FROM ep", PERSISTENCE))
def persistence_summary(spark: SparkSession, d: str) -> DataFrame:
    p = ops.persistence(data.runs(spark, d), least_ratio=0.5)
    return p.agg(F.count("*").alias("n"), F.count_if("is_persistent").alias("n_persistent"), r6(F.avg("persistence_ratio"), "mean_ratio"), r6(F.median("persistence_ratio"), "median_ratio"))


@query("edges_csv", sql("SELECT cause AS \"Cause\", effect AS \"Effect\", lag AS \"Lag\", round(causal_effect, 4) AS \"Causal_Effect\", round(p_value, 4) AS p_value FROM runs WHERE run_idx = 0"))
def edges_csv(spark: SparkSession, d: str) -> DataFrame:
    r = data.runs(spark, d).filter("run_idx = 0")
    return r.select(F.col("cause").alias("Cause"), F.col("effect").alias("Effect"), F.col("lag").alias("Lag"), r4("causal_effect", "Causal_Effect"), r4("p_value"))


BFS = "walk AS (SELECT cause, effect, lag, lag AS cum, cause AS at FROM edges WHERE effect IN ('v1', 'v2') AND lag BETWEEN {low} AND 6 UNION SELECT e.cause, e.effect, e.lag, w.cum + e.lag, e.cause FROM walk w JOIN edges e ON e.effect = w.at WHERE w.cum + e.lag BETWEEN {low} AND 6{stop})"


@query("lag_bounded_bfs", sql("SELECT DISTINCT cause, effect, lag FROM walk", BFS.format(low=2, stop=""), recursive=True))
def lag_bounded_bfs(spark: SparkSession, d: str) -> DataFrame:
    return ops.toward(data.edges(spark, d), ["v1", "v2"], 6, 2).select("cause", "effect", "lag")


@query("lag_open_bfs", sql("SELECT DISTINCT cause, effect, lag FROM walk", BFS.format(low=0, stop=" AND w.at NOT IN ('v1', 'v2')"), recursive=True))
def lag_open_bfs(spark: SparkSession, d: str) -> DataFrame:
    return ops.toward(data.edges(spark, d), ["v1", "v2"], 6, mode="open").select("cause", "effect", "lag")


@query("graph_intersection", sql("SELECT cause, effect, lag FROM edges WHERE lag <> 2 AND effect <> 'v3'"))
def graph_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = data.edges(spark, d)
    return ops.intersect(e.filter("lag <> 2"), e.filter("effect <> 'v3'")).select("cause", "effect", "lag")


@query("fdr_pruning", sql("SELECT count(*) AS before, count(*) FILTER (lag <> 2) AS after, count(*) FILTER (lag = 2) AS removed FROM edges"))
def fdr_pruning(spark: SparkSession, d: str) -> DataFrame:
    e = data.edges(spark, d)
    return ops.prune_by_fdr(e, e.filter("lag <> 2"))[1]


@query("window_thresholds", "SELECT o_orderkey, o_orderkey % 50 AS years, CASE WHEN o_orderkey % 50 <= 20 THEN 0.3 WHEN o_orderkey % 50 <= 30 THEN 0.45 ELSE 0.55 END::DOUBLE AS threshold FROM orders")
def window_thresholds(spark: SparkSession, d: str) -> DataFrame:
    years = F.col("o_orderkey") % 50
    return scan.table(spark, d, "orders").select("o_orderkey", years.alias("years"), ops.frequency_threshold(years).alias("threshold"))


@query("window_consensus", sql("SELECT cause, effect, lag, round(frequency, 6) AS frequency, round(average_effect, 6) + 0.0 AS average_effect, round(link_power, 6) AS link_power, round(link_power / max(link_power) OVER (), 6) AS width FROM (SELECT *, frequency * abs(average_effect) AS link_power FROM (SELECT cause, effect, lag, count(*) / 4 AS frequency, avg(causal_effect) AS average_effect FROM runs WHERE p_value < 0.03 GROUP BY ALL) WHERE frequency >= 0.45)"))
def window_consensus(spark: SparkSession, d: str) -> DataFrame:
    w = data.runs(spark, d).filter("p_value < 0.03").withColumnRenamed("causal_effect", "effect_size")
    return ops.consensus(w, F.lit(4), 30).select("cause", "effect", "lag", r6("frequency"), r6("average_effect"), r6("link_power"), r6("width"))


@query("gaps_islands", sql("SELECT cause, effect, min(lag) AS first, max(lag) AS last, count(*) AS n FROM (SELECT *, lag - row_number() OVER (PARTITION BY cause, effect ORDER BY lag) AS i FROM (SELECT DISTINCT cause, effect, lag FROM runs WHERE run_idx = 0 AND p_value < 0.03)) GROUP BY cause, effect, i"))
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    return ops.runs_of_windows(data.runs(spark, d).filter("run_idx = 0 and p_value < 0.03"), ["cause", "effect"], "lag")


CSV = "csv AS (SELECT cause AS \"Cause\", effect AS \"Effect\", CASE WHEN lag = 5 THEN 'bad' WHEN lag = 4 THEN ' 4.0 ' ELSE lag::VARCHAR END AS \"Lag\" FROM runs WHERE run_idx = 1)"


def _csv(spark: SparkSession, d: str) -> DataFrame:
    lag = F.when(F.col("lag") == 5, "bad").when(F.col("lag") == 4, " 4.0 ").otherwise(F.col("lag").cast("string"))
    return data.runs(spark, d).filter("run_idx = 1").select(F.col("cause").alias("Cause"), F.col("effect").alias("Effect"), lag.alias("Lag"))


@query("parents_parse", sql("SELECT DISTINCT \"Cause\" AS parent, -abs(try_cast(trim(\"Lag\") AS DOUBLE))::INT AS lag FROM csv WHERE \"Effect\" = 'BUILDING' AND try_cast(trim(\"Lag\") AS DOUBLE) IS NOT NULL", CSV))
def parents_parse(spark: SparkSession, d: str) -> DataFrame:
    return ops.parents(_csv(spark, d), "BUILDING")


@query("vars_union_distinct", sql("SELECT \"Cause\" AS var FROM csv UNION SELECT \"Effect\" FROM csv", CSV))
def vars_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ops.variables(_csv(spark, d))


@query("target_pairs", sql("SELECT \"Effect\", \"Lag\", \"Cause\" FROM csv WHERE \"Effect\" IN ('BUILDING', 'MACHINERY')", CSV))
def target_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ops.target_pairs(_csv(spark, d), ["BUILDING", "MACHINERY"])


@query("candidate_edges", "SELECT a.n_name AS cause, b.n_name AS effect, lag::INT AS lag FROM nation a, nation b, (SELECT unnest(range(1, 7)) AS lag)")
def candidate_edges(spark: SparkSession, d: str) -> DataFrame:
    return ops.all_lags(scan.table(spark, d, "nation").select(F.col("n_name").alias("var")))


def _panel_runs(spark: SparkSession, d: str) -> DataFrame:
    """The panel with all steps, once for each alpha; gaps are 0 and visible as in the series they come from."""
    p = data.panel(spark, d).select("t", "var", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(False).alias("masked"))
    alphas = F.explode(F.array(*(F.struct(F.lit(i).alias("run_idx"), F.lit(a).alias("alpha")) for i, a in enumerate((0.05, 0.025, 0.015, 0.01)))))
    return p.withColumn("a", alphas).select("a.run_idx", "a.alpha", "t", "var", "value", "masked")


@query("pcmci_edges")
def pcmci_edges(spark: SparkSession, d: str) -> DataFrame:
    return pcmci.discover(_panel_runs(spark, d), ["run_idx"])


@query("pcmci_fdr")
def pcmci_fdr(spark: SparkSession, d: str) -> DataFrame:
    one = _panel_runs(spark, d).filter("run_idx = 0").withColumn("alpha", F.lit(0.1))
    return pcmci.discover(one, ["run_idx"], fdr=True)


@query("pcmci_outcomes", sql("SELECT k::INT AS run_idx, k <> 2 AS ok, CASE WHEN k = 2 THEN 0 ELSE (SELECT count(DISTINCT var) * count(DISTINCT var) * 6 FROM panel) END::BIGINT AS tests, CASE WHEN k = 2 THEN (SELECT min(var) FROM panel) || ' is infinite at step 3' END AS error FROM (SELECT unnest([0, 1, 2, 3]) AS k)"))
def pcmci_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Four runs, of which one cannot be computed: the others have their graphs."""
    runs = _panel_runs(spark, d)
    first = runs.agg(F.min("var").alias("first"))
    spoilt = runs.crossJoin(F.broadcast(first)).withColumn("value", F.when((F.col("run_idx") == 2) & (F.col("t") == 3) & (F.col("var") == F.col("first")), F.lit(float("inf"))).otherwise(F.col("value")))
    return pcmci.outcomes(pcmci.attempts(spoilt.drop("first"), ["run_idx"]), ["run_idx"]).select("run_idx", "ok", "tests", "error")


@query("pcmci_sliding")
def pcmci_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of four years, one every year."""
    p = _panel_runs(spark, d).filter("run_idx = 0").withColumn("alpha", F.lit(0.05))
    return pcmci.discover(pcmci.windows_by_years(p, 4, 1).drop("run_idx", "centre"), ["window"])


# modes


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("pca_eof")
def pca_eof(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    _, mean, gram = modes.moments(v, "x")
    patterns, _ = modes.eof(gram, 2)
    return modes.scores(v, "x", ["vec_id"], mean, patterns, ["pc1", "pc2"])


@query("ec_index")
def ec_index(spark: SparkSession, d: str) -> DataFrame:
    e, c = modes.ec_rotation(F.col("pc1"), F.col("pc2"))
    return pca_eof(spark, d).select("vec_id", e.alias("e"), c.alias("c"))


@query("reof_varimax")
def reof_varimax(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    _, mean, gram = modes.moments(v, "x")
    patterns, _, _ = modes.reof(gram, 5)
    return modes.scores(v, "x", ["vec_id"], mean, patterns, [f"rpc{k}" for k in range(1, 6)])


def _mca(spark: SparkSession, d: str, k: int):
    v = _vectors(spark, d)
    n, mean, gram = modes.moments(v, "x")
    return v, mean, *modes.mca(gram[:32, 32:] / max(n - 1, 1), k)


@query("mca_svd")
def mca_svd(spark: SparkSession, d: str) -> DataFrame:
    v, mean, left, right, _ = _mca(spark, d, 2)
    zero = np.zeros((2, 32))
    both = np.concatenate([np.concatenate([left, zero], axis=1), np.concatenate([zero, right], axis=1)])
    return modes.scores(v, "x", ["vec_id"], mean, both, ["a1", "a2", "b1", "b2"])


@query("mca_scf")
def mca_scf(spark: SparkSession, d: str) -> DataFrame:
    *_, scf = _mca(spark, d, 3)
    return spark.createDataFrame([(k + 1, float(s)) for k, s in enumerate(scf)], "mode int, scf double")


# forecasts

PAIRS = "pr AS (SELECT a.t, a.value / 1e4 AS y_true, b.value / 1e4 AS y_pred, CASE WHEN a.t % 2 = 0 THEN 'a' ELSE 'b' END AS k FROM panel a JOIN panel b ON a.t = b.t AND a.var = 'ASIA' AND b.var = 'EUROPE')"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = data.panel(spark, d)
    own = lambda v, n: p.filter(F.col("var") == v).select("t", (F.col("value") / 1e4).alias(n))
    return own("ASIA", "y_true").join(own("EUROPE", "y_pred"), "t").withColumn("k", F.when(F.col("t") % 2 == 0, "a").otherwise("b"))


@query("skill_metrics", sql("SELECT k, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) AS rmse, round(corr(y_true, y_pred), 4) AS r, count(*) AS n FROM pr GROUP BY k", PAIRS))
def skill_metrics(spark: SparkSession, d: str) -> DataFrame:
    return forecast.skill(_pairs(spark, d), ["k"]).select("k", r4("rmse"), r4("r"), "n")


@query("contingency", sql("SELECT k, CASE WHEN n >= 2 THEN hits ELSE 0 END AS hits, CASE WHEN n >= 2 THEN misses ELSE 0 END AS misses, CASE WHEN n >= 2 THEN false_alarms ELSE 0 END AS false_alarms, CASE WHEN n >= 2 THEN correct_negatives ELSE 0 END AS correct_negatives, CASE WHEN n >= 2 THEN hits + misses ELSE 0 END AS n_events_observed, CASE WHEN n >= 2 THEN round(hits / nullif(hits + misses, 0), 4) END AS hit_rate, CASE WHEN n >= 2 THEN round(1 - hits / nullif(hits + misses, 0), 4) END AS miss_rate FROM (SELECT k, count(*) FILTER (y_true IS NOT NULL AND y_pred IS NOT NULL) AS n, count(*) FILTER (abs(y_true) > 0.5 AND abs(y_pred) > 0.5) AS hits, count(*) FILTER (abs(y_true) > 0.5 AND abs(y_pred) <= 0.5) AS misses, count(*) FILTER (abs(y_true) <= 0.5 AND abs(y_pred) > 0.5) AS false_alarms, count(*) FILTER (abs(y_true) <= 0.5 AND abs(y_pred) <= 0.5) AS correct_negatives FROM (SELECT * FROM pr UNION ALL SELECT 0, 1.0, 1.0, 'one pair' UNION ALL SELECT 1, 1.0, NULL, 'one pair') GROUP BY k)", PAIRS))
def contingency(spark: SparkSession, d: str) -> DataFrame:
    lone = spark.createDataFrame([(0, 1.0, 1.0, "one pair"), (1, 1.0, None, "one pair")], "t int, y_true double, y_pred double, k string")
    every = _pairs(spark, d).select("t", "y_true", "y_pred", "k").union(lone)
    return forecast.contingency(every, ["k"], F.lit(0.5)).select("k", *(F.col(c).cast("long").alias(c) for c in ("hits", "misses", "false_alarms", "correct_negatives", "n_events_observed")), r4("hit_rate"), r4("miss_rate"))


RIDGE = """d AS (SELECT a.var AS target, a.t, a.value AS y, b.value AS x0, c.value AS x1, row_number() OVER (PARTITION BY a.var ORDER BY a.t) - 1 AS pos, count(*) OVER (PARTITION BY a.var) AS n
  FROM panel a LEFT JOIN panel b ON b.var = 'AFRICA' AND b.t = a.t - 3 LEFT JOIN panel c ON c.var = 'AMERICA' AND c.t = a.t - 4 WHERE a.var IN ('ASIA', 'EUROPE')),
f AS (SELECT target, f, n - (3 - f) * (n // 4) AS s, n - (2 - f) * (n // 4) AS e FROM (SELECT DISTINCT target, n FROM d), (SELECT unnest([0, 1, 2]) AS f)),
m AS (SELECT target, f, s, e, count(*) AS n, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1, count(*) * corr(x0, x1) AS r, count(*) * covar_pop(x0, y) / stddev_pop(x0) AS q0, count(*) * covar_pop(x1, y) / stddev_pop(x1) AS q1
  FROM d JOIN f USING (target) WHERE pos < s AND x0 IS NOT NULL AND x1 IS NOT NULL GROUP BY target, f, s, e),
w AS (SELECT *, ((n + 1) * q0 - r * q1) / ((n + 1) * (n + 1) - r * r) AS w0, ((n + 1) * q1 - r * q0) / ((n + 1) * (n + 1) - r * r) AS w1 FROM m WHERE m.n >= 2),
p AS (SELECT d.target, y, my + w0 * (x0 - m0) / s0 + w1 * (x1 - m1) / s1 AS z FROM d JOIN w USING (target) WHERE pos >= s AND pos < e AND x0 IS NOT NULL AND x1 IS NOT NULL),
k AS (SELECT target, sqrt(avg((y - z) * (y - z))) AS rmse, corr(y, z) AS r, count(*) AS n FROM p GROUP BY target)"""


@query("cv_skill_table", sql("SELECT target, round(rmse, 3) AS rmse, round(r, 4) AS r, n, round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) AS t FROM k", RIDGE))
def cv_skill_table(spark: SparkSession, d: str) -> DataFrame:
    design = None
    for target in ("ASIA", "EUROPE"):
        one = align.design_matrix(data.panel(spark, d), target, [("AFRICA", 3), ("AMERICA", 4)]).withColumn("target", F.lit(target))
        design = one if design is None else design.unionByName(one)
    predicted = forecast.predict_folds(design, ["target"], ["x0", "x1"], 3, "ridge")
    return forecast.skill(predicted, ["target"]).select("target", F.round("rmse", 3).alias("rmse"), r4("r"), "n", r4("t"))


# winds


def _winds(spark: SparkSession, d: str) -> DataFrame:
    """A global 9 x 16 grid for each season, from the seasonal anomalies of 25 cells."""
    a = data.anom(spark, d).select("season", "cell", (F.col("anom") / 1e4).alias("x"))
    place = F.explode(F.sequence(F.lit(0), F.lit(143))).alias("p")
    cells = a.select("season", "cell", "x", place).filter(F.col("p") % 25 == F.col("cell"))
    lat = F.floor(F.col("p") / 16) * F.lit(20.0) - 80
    return cells.select("season", lat.alias("lat"), (F.col("p") % 16 * F.lit(22.5)).alias("lon"), (F.col("x") * F.cos(F.radians(lat))).alias("u"), (F.col("x") * F.cos(F.radians(lat)) * 0.5).alias("v"))


@query("streamfunction")
def streamfunction(spark: SparkSession, d: str) -> DataFrame:
    return sphere.wind_diagnostics(_winds(spark, d), ["season"]).select("season", "lat", "lon", "psi")


@query("velocity_potential")
def velocity_potential(spark: SparkSession, d: str) -> DataFrame:
    return sphere.wind_diagnostics(_winds(spark, d), ["season"]).select("season", "lat", "lon", "chi")


@query("rws")
def rws(spark: SparkSession, d: str) -> DataFrame:
    return sphere.wind_diagnostics(_winds(spark, d), ["season"]).select("season", "lat", "lon", "rws")


# regions

BOUNDS = region_search.Bounds(-60, 60, -180, 170, 20, 60)
RECTS = "(SELECT n_nationkey AS id, (-70 + n_nationkey * 5)::INT AS lat_min, (-70 + n_nationkey * 5 + (n_nationkey % 4) * 20)::INT AS lat_max, (-190 + n_nationkey * 14)::INT AS lon_min, (-190 + n_nationkey * 14 + (n_nationkey % 3) * 45)::INT AS lon_max FROM nation)"


def _rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return scan.table(spark, d, "nation").select(k.alias("id"), (-70 + k * 5).alias("lat_min"), (-70 + k * 5 + (k % 4) * 20).alias("lat_max"), (-190 + k * 14).alias("lon_min"), (-190 + k * 14 + (k % 3) * 45).alias("lon_max"))


@query("rect_validity", f"SELECT id, lat_min >= -60 AND lat_max <= 60 AND lon_min >= -180 AND lon_max <= 170 AND lat_max - lat_min >= 20 AND lon_max - lon_min >= 60 AS valid FROM {RECTS}")
def rect_validity(spark: SparkSession, d: str) -> DataFrame:
    return _rects(spark, d).select("id", region_search.valid_column(BOUNDS).alias("valid"))


@query("roulette", "SELECT n_nationkey AS id, round(sum(f) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) / sum(f) OVER () - f / sum(f) OVER (), 6) + 0.0 AS low, round(sum(f) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) / sum(f) OVER (), 6) AS high FROM (SELECT n_nationkey, (n_nationkey % 7)::DOUBLE AS f FROM nation)")
def roulette(spark: SparkSession, d: str) -> DataFrame:
    f = scan.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 7).cast("double").alias("fitness"), F.lit(0).alias("g"))
    return region_search.roulette(f, ["g"]).select("id", (F.round("low", 6) + 0.0).alias("low"), F.round("high", 6).alias("high"))


@query("ga_search")
def ga_search(spark: SparkSession, d: str) -> DataFrame:
    """The rectangle whose leading rotated mode acts most strongly on the European index three seasons later, in the causal graph of all
    indices: the whole search, 36 rectangles in 6 generations and up to 100 refinements, each a graph."""
    return _search(spark, d, ())


@query("ga_search_coupled")
def ga_search_coupled(spark: SparkSession, d: str) -> DataFrame:
    """The same for the leading mode that the field shares with a vector field, of 48 rectangles."""
    return _search(spark, d, ("wx", "wy"), population=48)


def _search(spark: SparkSession, d: str, right: tuple[str, ...], **options) -> DataFrame:
    from gridloom.sources.results import stored

    axis = season.calendar(data.idx(spark, d))
    a = data.anom(spark, d).join(F.broadcast(axis), "season")
    back = a.select((F.col("t") + 1).alias("t"), "cell", F.col("anom").alias("before"))
    parts = a.join(back, ["t", "cell"], "left").select("t", "lat", "lon", F.col("anom").alias("value"), (F.col("anom") - F.coalesce("before", F.lit(0.0))).alias("wx"), (F.col("anom") * F.cos(F.radians("lat"))).alias("wy"))
    field = stored(parts.select("t", "lat", "lon", "value", *right), "region-field")
    panel = _panel_runs(spark, d).filter("run_idx = 0").select("t", "var", "value", "masked").toPandas()  # a few hundred rows, once for the whole search

    def evaluate(rects: list[region_search.Rect]) -> list[float]:
        got = {r.id: r.effect for r in region_search.causal_fitness(field, panel, rects, "EUROPE", 3, right).collect()}
        return [got.get(i, 0.0) for i in range(len(rects))]

    best, fitness, _ = region_search.search(evaluate, BOUNDS, **options)
    return spark.createDataFrame([(*map(int, best), fitness)], "lat_min int, lat_max int, lon_min int, lon_max int, fitness double")


# sources and events


@query("error_classes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'network' WHEN event_type = 'click' THEN 'rate_limit' WHEN event_type = 'view' THEN 'auth' ELSE 'unknown' END AS kind, event_type <> 'view' AS retry FROM events")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "Connection lost").when(F.col("event_type") == "click", "HTTP 429: slow down").when(F.col("event_type") == "view", "HTTP 403 Forbidden").otherwise("odd")
    return scan.table(spark, d, "events").withColumn("e", scan.error_class(said)).select("event_id", "e.kind", "e.retry")


@query("parameter_hash", "SELECT event_id, substring(md5('{\"k\":' || json_extract_string(props, '$.k') || '}'), 1, 8) AS hash FROM events")
def parameter_hash(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "events").select("event_id", scan.parameter_hash(F.from_json("props", "k long")).alias("hash"))


@query("variable_groups", "SELECT n_regionkey AS season, string_agg(trim(n_name), ',' ORDER BY trim(n_name)) AS vars FROM nation GROUP BY n_regionkey")
def variable_groups(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("season")).agg(F.array_join(F.array_sort(F.collect_list(F.trim("n_name"))), ",").alias("vars"))


@query("recent_entries", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_entries(spark: SparkSession, d: str) -> DataFrame:
    o = scan.table(spark, d, "orders").select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("k"))
    return scan.recent(o, 10, "k").select("o_orderkey")


@query("run_summary", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = windows.tumbling(scan.table(spark, d, "events"), "1 hour", ["event_type"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r4("total"))


@query("events_session", """SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sessions(scan.table(spark, d, "events"), "30 minutes", ["user_id"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")
