"""Named queries over regression programs, forecasts, coupled modes and small tables of variables, seasons and lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import calculus, composite, coupled, edges, forecast, grid, indices, lagged, pcmci, program, region_search, season, stats
from gridloom.plans import carriers as data
from gridloom.plans.carriers import sql
from gridloom.plans.causal import r4, r6
from gridloom.plans.climate import EVENTS, ONTO, _events, _onto
from gridloom.plans.registry import query
from gridloom.sources import progress, raw_tree, results, scan


def _nation(spark: SparkSession, d: str) -> DataFrame:
    return scan.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.trim("n_name").alias("name"), "n_regionkey")


# axes, seasons and lags


@query("monthly_axis", sql("SELECT var, (DATE '1950-01-01' + to_months(r::INT))::DATE AS time, round(value, 4) AS value FROM panel JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS r FROM (SELECT DISTINCT t FROM panel)) USING (t)"))
def monthly_axis(spark: SparkSession, d: str) -> DataFrame:
    p = data.panel(spark, d).select("var", (F.col("t") * 0.5 + 711857.25).alias("step"), "value")
    return season.monthly_axis(p, "1950-01-01", "step").select("var", "time", r4("value"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """``k``: a whole number of each order."""
    return scan.table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("k"))


@query("lag_groups", "SELECT o_orderkey::INT AS k, (o_orderkey % 9)::INT AS lag, CASE o_orderkey % 9 WHEN 6 THEN 'JJA' WHEN 4 THEN 'DJF' WHEN 3 THEN 'MAM' ELSE 'SON' END AS season, CASE o_orderkey % 9 WHEN 6 THEN 'JJA_PREDICTORS' WHEN 4 THEN 'DJF_CONFOUNDERS' WHEN 3 THEN 'MAM_MEDIATORS' ELSE 'SON_PREDICTORS' END AS \"group\" FROM orders")
def lag_groups(spark: SparkSession, d: str) -> DataFrame:
    lag = F.col("k") % 9
    return _keys(spark, d).select("k", lag.alias("lag"), program.lag_group(lag).alias("g")).select("k", "lag", "g.season", "g.group")


@query("lag_bounds", "SELECT o_orderkey::INT AS k, (o_orderkey % 4 + 3)::INT AS high, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 + 3 ELSE 3 END)::INT AS low FROM orders")
def lag_bounds(spark: SparkSession, d: str) -> DataFrame:
    high = F.concat(F.lit("lag"), (F.col("k") % 4 + 3).cast("string"))
    text = F.concat(high, F.when(F.col("k") % 3 == 0, "").otherwise("-3"), F.when(F.col("k") % 2 == 0, "_COMBINED").otherwise(""))
    return _keys(spark, d).select("k", program.lag_bounds(text).alias("b")).select("k", "b.high", "b.low")


@query("season_names", sql("SELECT season, [' (0)', ' (1)', ' (2)', ' (3)'][q] AS tag, ['Dec-Jan-Feb', 'Mar-Apr-May', 'Jun-Jul-Aug', 'Sep-Oct-Nov'][q] || [' (0)', ' (1)', ' (2)', ' (3)'][q] AS display, ['DJF', 'MAM', 'JJA', 'SON'][q] || [' (0)', ' (1)', ' (2)', ' (3)'][q] AS code FROM (SELECT DISTINCT season, quarter(season) AS q FROM sea)"))
def season_names(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(F.lit(" ("), (F.quarter("season") - 1).cast("string"), F.lit(")"))
    rows = data.sea(spark, d).select("season").distinct().withColumn("tag", tag)
    shown = rows.withColumn("display", season.season_display(F.concat(season.season_name(F.month("season")), "tag")))
    return shown.withColumn("code", season.season_code(F.col("display")))


@query("reference_years", "SELECT o_orderkey::INT AS k, ['JJA', 'SON', 'DJF', 'MAM'][o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '_-1' ELSE '_0' END AS key, (1990 + o_orderkey % 30 - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::INT AS year FROM orders")
def reference_years(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.element_at(F.array(*map(F.lit, ("JJA", "SON", "DJF", "MAM"))), F.col("k") % 4 + 1), F.when(F.col("k") % 3 == 0, "_-1").otherwise("_0"))
    return _keys(spark, d).select("k", key.alias("key"), composite.reference_year(1990 + F.col("k") % 30, key).alias("year"))


@query("windows_by_years", sql("SELECT w AS window, (w * 4 + 8)::INT AS centre, var, t::INT AS t FROM panel, (SELECT unnest(range(0, 1000))::INT AS w) WHERE t BETWEEN w * 4 AND w * 4 + 15 AND w * 4 + 15 <= (SELECT max(t) FROM panel)"))
def windows_by_years(spark: SparkSession, d: str) -> DataFrame:
    w = pcmci.windows_by_years(data.panel(spark, d), 4, 1)
    return w.select("window", F.col("centre").cast("int").alias("centre"), "var", F.col("t").cast("int").alias("t"))


# fields


@query("line_width", sql("SELECT season, cell, round(coalesce(3 * s / nullif(max(s) OVER (PARTITION BY season), 0), 0), 4) AS width FROM (SELECT season, cell, sqrt(u * u + v * v) AS s FROM (SELECT season, cell, CASE WHEN cell % 6 <> 1 THEN anom END AS u, anom * 0.5 AS v FROM anom))"))
def line_width(spark: SparkSession, d: str) -> DataFrame:
    uv = data.anom(spark, d).select("season", "cell", F.when(F.col("cell") % 6 != 1, F.col("anom")).alias("u"), (F.col("anom") * 0.5).alias("v"))
    return grid.line_width(uv, ["season"]).select("season", "cell", r4("width"))


@query("finite_or_zero", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN 0.0 ELSE o_totalprice::DOUBLE END AS value FROM orders")
def finite_or_zero(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    odd = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).when(k == 4, F.col("o_totalprice").cast("double"))
    return scan.table(spark, d, "orders").select("o_orderkey", grid.finite_or_zero(odd).alias("value"))


@query("band_means", sql("SELECT season, band, lon, round(avg(anom), 4) AS value FROM anom JOIN (SELECT 'south' AS band, -60.0 AS lo, -15.0 AS hi UNION ALL SELECT 'middle', -20.0, 20.0 UNION ALL SELECT 'north', 15.0, 60.0) ON lat BETWEEN lo AND hi GROUP BY season, band, lon"))
def band_means(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("south", -60.0, -15.0), ("middle", -20.0, 20.0), ("north", 15.0, 60.0)], "band string, lat_min double, lat_max double")
    return grid.band_means(data.anom(spark, d).withColumn("value", F.col("anom")), bands, ["season"]).select("season", "band", "lon", r4("value"))


#: Values are missing in July at one latitude, and in April in whole columns.
GAPS = "g AS (SELECT season, cell % 5 AS lat, cell // 5 AS lon, CASE WHEN month(season) = 7 AND cell % 5 = 2 OR month(season) = 4 AND cell // 5 = 1 THEN NULL ELSE value END AS value FROM sea)"


@query("cumtrapz_gaps", sql("SELECT season, lon, lat, CASE WHEN n = 0 THEN 0 WHEN max(gap) OVER w = 0 THEN round(coalesce(sum(part) OVER w, 0), 4) END AS psi FROM (SELECT season, lon, lat, n, (value + p) / 2 * (lat - q) AS part, CASE WHEN q IS NOT NULL AND (value IS NULL OR p IS NULL) THEN 1 ELSE 0 END AS gap FROM (SELECT *, lag(value) OVER v AS p, lag(lat) OVER v AS q, count(value) OVER (PARTITION BY season, lon) AS n FROM g WINDOW v AS (PARTITION BY season, lon ORDER BY lat))) WINDOW w AS (PARTITION BY season, lon ORDER BY lat ROWS UNBOUNDED PRECEDING)", GAPS))
def cumtrapz_gaps(spark: SparkSession, d: str) -> DataFrame:
    lat, lon, month = F.col("cell") % 5, F.floor(F.col("cell") / 5), F.month("season")
    value = F.when(~((month == 7) & (lat == 2) | (month == 4) & (lon == 1)), F.col("value"))
    g = data.sea(spark, d).select("season", lat.alias("lat"), lon.alias("lon"), value.alias("value"))
    return calculus.cumtrapz(g, ["season", "lon"], "lat").select("season", "lon", "lat", r4("psi"))


# regression


NORMAL = """s AS (SELECT cell, count(*) AS n, regr_sxx(x, x) AS a, regr_sxx(x2, x2) AS b, covar_pop(x, x2) * count(*) AS c, covar_pop(y, x) * count(*) AS p, covar_pop(y, x2) * count(*) AS q, regr_sxx(y, y) AS yy FROM yx GROUP BY cell),
f AS (SELECT *, a * b - c * c AS det, (p * b - q * c) / (a * b - c * c) AS b1, (q * a - p * c) / (a * b - c * c) AS b2 FROM s),
r AS (SELECT *, greatest(yy - b1 * p - b2 * q, 0) AS rest FROM f)"""


@query("ols_multi", sql("SELECT cell, 'x' AS predictor, round(b1, 4) AS coef, round(b1 / sqrt(b / det * rest / (n - 3)), 4) AS t, round(1 - rest / yy, 4) AS r2 FROM r UNION ALL SELECT cell, 'x2', round(b2, 4), round(b2 / sqrt(a / det * rest / (n - 3)), 4), round(1 - rest / yy, 4) FROM r", ONTO + ", " + NORMAL))
def ols_multi(spark: SparkSession, d: str) -> DataFrame:
    return stats.ols_normal(_onto(spark, d), ["cell"], "y", ["x", "x2"]).select("cell", "predictor", r4("coef"), r4("t"), r4("r2"))


def two_sided(t: str, df: str) -> str:
    """SQL for the two-sided p-value of Student's t with whole degrees of freedom: the finite sums over powers of cos(atan(t / sqrt(df)))."""
    a = f"atan(abs({t}) / sqrt({df}))"
    even = f"1 - sin({a}) * list_sum(list_transform(range(0, {df} // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1) - lgamma(0.5)) * pow(cos({a}), 2 * i)))"
    odd = f"1 - 2 / pi() * ({a} + sin({a}) * coalesce(list_sum(list_transform(range(1, ({df} + 1) // 2), lambda i: 0.5 * exp(lgamma(0.5) + lgamma(i) - lgamma(i + 0.5)) * pow(cos({a}), 2 * i - 1))), 0))"
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


TESTED = NORMAL + """, e AS (SELECT cell, 'x' AS predictor, b1 AS coef, b1 / sqrt(b / det * rest / (n - 3)) AS t, 1 - rest / yy AS r2, n FROM r WHERE n >= 4
UNION ALL SELECT cell, 'x2', b2, b2 / sqrt(a / det * rest / (n - 3)), 1 - rest / yy, n FROM r WHERE n >= 4)"""


@query("ols_p_values", sql(f"SELECT cell, predictor, round(coef, 4) AS coef, round(t, 4) AS t, (n - 3)::DOUBLE AS df, round(r2, 4) AS r2, round({two_sided('t', '(n - 3)')}, 6) AS p_value FROM e", ONTO + ", " + TESTED))
def ols_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients with their two-sided p-values."""
    fits = stats.ols_normal(_onto(spark, d), ["cell"], "y", ["x", "x2"])
    return fits.select("cell", "predictor", r4("coef"), r4("t"), "df", r4("r2"), r6(stats.t_p_value(F.col("t"), F.col("df")), "p_value"))


@query("regression_table_function", sql(f"SELECT cell, predictor, round(coef, 4) AS coef, round({two_sided('t', '(n - 3)')}, 6) AS p_value, round(r2, 4) AS r2, n FROM e", ONTO + ", " + TESTED))
def regression_table_function(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients, p-values and R squared of every cell from one call in SQL."""
    tables.register(spark)
    return spark.sql("SELECT cell, predictor, round(coef, 4) + 0.0 AS coef, round(p_value, 6) AS p_value, round(r2, 4) AS r2, n FROM regression(TABLE(SELECT * FROM {yx}), 'cell', 'y', 'x, x2')", yx=_onto(spark, d))


def two_sided_real(t: str, df: str) -> str:
    """The same for degrees of freedom that are no whole number: the integral over the angle by Simpson's rule."""
    a = f"atan(abs({t}) / sqrt({df}))"
    area = f"list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({a} * i / 400), {df} - 1))) * {a} / 1200"
    return f"1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {area}"


MEANS = "g AS (SELECT cell, avg(value) FILTER (m = 1) AS ma, avg(value) FILTER (m = 7) AS mb, count(*) FILTER (m = 1) AS na, count(*) FILTER (m = 7) AS nb, var_samp(value) FILTER (m = 1) / count(*) FILTER (m = 1) AS qa, var_samp(value) FILTER (m = 7) / count(*) FILTER (m = 7) AS qb FROM (SELECT cell, value, month(season) AS m FROM sea) GROUP BY cell), h AS (SELECT *, (ma - mb) / sqrt(qa + qb) AS t, pow(qa + qb, 2) / (qa * qa / (na - 1) + qb * qb / (nb - 1)) AS df FROM g)"


@query("welch_p_values", sql(f"SELECT cell, round(t, 4) AS t, round(df, 4) AS df, na AS n_a, nb AS n_b, round({two_sided_real('t', 'df')}, 6) AS p_value FROM h", MEANS))
def welch_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the means of two seasons in each cell, with p-values."""
    a = data.sea(spark, d).withColumn("m", F.month("season"))
    return stats.welch(a, ["cell"], "m", 1, 7).select("cell", r4("t"), r4("df"), "n_a", "n_b", r6(stats.t_p_value(F.col("t"), F.col("df")), "p_value"))


CLOSED = "c AS (SELECT cell, covar_pop(y, x) AS s, var_pop(x) AS g FROM yx GROUP BY cell)"


@query("lasso_one_predictor", sql("SELECT cell, round(sign(s) * greatest(abs(s) - 2e7, 0) / g, 4) + 0.0 AS coef FROM c", ONTO + ", " + CLOSED))
def lasso_one_predictor(spark: SparkSession, d: str) -> DataFrame:
    """With a single predictor the penalised fit has a closed form."""
    return stats.lasso_fixed(_onto(spark, d), ["cell"], "y", ["x"], 2e7).select("cell", r4("coef"))


FOLDS = """n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY season) - 1 AS pos, count(*) OVER (PARTITION BY cell) AS n FROM yx),
f AS (SELECT n.*, k, pos >= k * (n // 5) + least(k, n % 5) AND pos < (k + 1) * (n // 5) + least(k + 1, n % 5) AS test FROM n, (SELECT unnest(range(0, 5)) AS k)),
tr AS (SELECT cell, k, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) AS s, var_pop(x) AS g FROM f WHERE NOT test GROUP BY cell, k),
al AS (SELECT cell, i, abs(s) * pow(10, -3.0::DOUBLE * i / 99) AS alpha, s, g FROM c, (SELECT unnest(range(0, 100)) AS i)),
er AS (SELECT cell, i, sum(e) AS e FROM (SELECT f.cell, al.i, f.k, avg(pow(f.y - my - (f.x - mx) * sign(tr.s) * greatest(abs(tr.s) - alpha, 0) / tr.g, 2)) AS e FROM f JOIN tr ON tr.cell = f.cell AND tr.k = f.k JOIN al ON al.cell = f.cell WHERE test GROUP BY f.cell, al.i, f.k) GROUP BY cell, i),
be AS (SELECT cell, arg_min(i, struct_pack(e := e, i := i)) AS i FROM er GROUP BY cell)"""


@query("lasso_cv_one_predictor", sql("SELECT cell, round(alpha / 1e6, 4) AS alpha, round(sign(s) * greatest(abs(s) - alpha, 0) / g, 4) + 0.0 AS coef FROM al JOIN be USING (cell, i)", ONTO + ", " + CLOSED + ", " + FOLDS))
def lasso_cv_one_predictor(spark: SparkSession, d: str) -> DataFrame:
    """The penalty by cross-validation, where each fold's fit has a closed form."""
    fits = stats.lasso_cv_fit(_onto(spark, d), ["cell"], "y", ["x"], order="season")
    return fits.select("cell", r4(F.col("alpha") / 1e6, "alpha"), r4("coef"))


@query("lasso_cv_fit")
def lasso_cv_fit(spark: SparkSession, d: str) -> DataFrame:
    return stats.lasso_cv_fit(_onto(spark, d), ["cell"], "y", ["x", "x2"], order="season")


SETS = "sets AS (SELECT * FROM (VALUES ('early', 'lag6-5', 'EP', 'OLS'), ('late', 'lag4', 'CP', 'LASSO_CV'), ('all', 'lag6-3_COMBINED', 'COMBINED', 'LASSO_fixed_alpha')) AS s(\"set\", lags, pathway, method)), preds AS (SELECT ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'ASIA'][k] AS name, ['EP', 'CP', 'EP', 'CP', 'CP'][k] AS pathway, [6, 5, 4, 3, 4][k]::INT AS lag FROM (SELECT unnest(range(1, 6)) AS k))"
BOUNDS = "bounds AS (SELECT \"set\", pathway AS wanted, CASE \"set\" WHEN 'late' THEN 4 ELSE 6 END AS high, CASE \"set\" WHEN 'early' THEN 5 WHEN 'late' THEN 4 ELSE 3 END::INT AS low FROM sets), chosen AS (SELECT DISTINCT \"set\", name, lag, low FROM preds JOIN bounds ON lag BETWEEN low AND high AND (wanted = 'COMBINED' OR wanted = pathway))"
TARGETS = "seasons AS (SELECT \"set\", target_season, target_lag, month FROM bounds, (VALUES ('JJA_-1', 6, 7), ('SON_-1', 5, 10), ('DJF_0', 4, 1), ('MAM_0', 3, 4), ('JJA_0', 2, 7), ('SON_0', 1, 10), ('DJF_1', 0, 1)) AS s(target_season, target_lag, month) WHERE target_lag <= low)"


def _sets(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    sets = spark.createDataFrame([("early", "lag6-5", "EP", "OLS"), ("late", "lag4", "CP", "LASSO_CV"), ("all", "lag6-3_COMBINED", "COMBINED", "LASSO_fixed_alpha")], "set string, lags string, pathway string, method string")
    rows = zip(["AFRICA", "AMERICA", "ASIA", "EUROPE", "ASIA"], ["EP", "CP", "EP", "CP", "CP"], [6, 5, 4, 3, 4], strict=True)
    return sets, spark.createDataFrame(list(rows), "name string, pathway string, lag int")


@query("predictors_for_sets", f"WITH {SETS}, {BOUNDS} SELECT \"set\", name, lag, low FROM chosen")
def predictors_for_sets(spark: SparkSession, d: str) -> DataFrame:
    sets, predictors = _sets(spark)
    return program.predictors_for(predictors, sets)


@query("applicable_seasons", f"WITH {SETS}, {BOUNDS}, {TARGETS} SELECT * FROM seasons")
def applicable_seasons(spark: SparkSession, d: str) -> DataFrame:
    return program.applicable_seasons(_sets(spark)[0])


@query("lagged_series", sql("SELECT \"set\", target_season, (season + to_months((3 * (lag - target_lag))::INT))::DATE AS season, name, round(value, 4) AS value FROM idx JOIN chosen USING (name) JOIN seasons USING (\"set\") WHERE month(season + to_months((3 * (lag - target_lag))::INT)) = seasons.month", f"{SETS}, {BOUNDS}, {TARGETS}"))
def lagged_series(spark: SparkSession, d: str) -> DataFrame:
    sets, predictors = _sets(spark)
    chosen = program.predictors_for(predictors, sets).select("set", "name", "lag")
    moved = program.lagged_series(data.idx(spark, d), chosen, program.applicable_seasons(sets))
    return moved.select("set", "target_season", "season", "name", r4("value"))


def _program(spark: SparkSession, d: str, sets: DataFrame, predictors: DataFrame) -> tuple[DataFrame, list[program.Case]]:
    i = data.idx(spark, d)
    target = data.anom(spark, d).select("cell", "season", (F.col("anom") / 1e4).alias("value"))
    return target, program.cases(i.filter("name <> 'MIDDLE EAST'"), i.filter("name = 'MIDDLE EAST'"), predictors, sets)


@query("regression_program")
def regression_program(spark: SparkSession, d: str) -> DataFrame:
    """All sets and seasons, with the penalty of the third set from the cells of a box."""
    sets, predictors = _sets(spark)
    target, designs = _program(spark, d, sets, predictors)
    box = F.col("cell").between(5, 15)
    alpha = program.spatial_alpha(target, ["cell"], [c for c in designs if c.method == "LASSO_fixed_alpha"], box)
    return program.run(target, ["cell"], designs, alpha)


#: One predictor and one confounder: the confounder's signal and the slope are simple regressions.
ONE = """steps AS (SELECT s.target_season, t.cell, t.season, t.anom / 1e4 AS y, x.value AS x, z.value AS z
  FROM (VALUES ('SON_-1', 5, 10), ('DJF_0', 4, 1), ('MAM_0', 3, 4), ('JJA_0', 2, 7), ('SON_0', 1, 10), ('DJF_1', 0, 1)) AS s(target_season, target_lag, month) JOIN anom t ON month(t.season) = s.month
  JOIN idx x ON x.name = 'AFRICA' AND x.season = t.season - to_months((3 * (6 - target_lag))::INT) JOIN idx z ON z.name = 'MIDDLE EAST' AND z.season = t.season - to_months((3 * (5 - target_lag))::INT)),
rests AS (SELECT target_season, cell, x, y - avg(y) OVER w - regr_slope(y, z) OVER w * (z - avg(z) OVER w) AS e FROM steps WINDOW w AS (PARTITION BY target_season, cell))"""


@query("regression_program_one", sql("SELECT target_season, cell, round(CASE WHEN count(*) >= 3 THEN regr_slope(e, x) * 1e4 END, 4) AS coef, round(CASE WHEN count(*) >= 3 THEN regr_r2(e, x) END, 4) AS r2 FROM rests GROUP BY target_season, cell HAVING count(*) > 2", ONE))
def regression_program_one(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.createDataFrame([("early", "lag6-5", "EP", "OLS")], "set string, lags string, pathway string, method string")
    predictors = spark.createDataFrame([("AFRICA", "EP", 6)], "name string, pathway string, lag int")
    target, designs = _program(spark, d, sets, predictors)
    fits = program.run(target, ["cell"], designs)
    return fits.filter("coef is not null").select("target_season", "cell", r4(F.col("coef") * 1e4, "coef"), r4("r2"))


# graphs and variables


@query("node_places", "SELECT trim(n_name) AS var, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE ((n_nationkey * 30.0 - 200) % 360 + 360) % 360 END::DOUBLE AS lon, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE n_nationkey * 3.0 - 40 END::DOUBLE AS lat FROM nation")
def node_places(spark: SparkSession, d: str) -> DataFrame:
    n = _nation(spark, d)
    places = n.filter("k % 5 <> 0").select(F.col("name").alias("var"), (F.col("k") * 30.0 - 200).alias("lon"), (F.col("k") * 3.0 - 40).alias("lat"))
    return edges.placed(n.select(F.col("name").alias("var")), places)


@query("node_extent", "SELECT min(lon) - 10 AS lon_min, max(lon) + 10 AS lon_max, greatest(-90.0, min(lat) - 10)::DOUBLE AS lat_min, least(90.0, max(lat) + 10)::DOUBLE AS lat_max FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE ((n_nationkey * 30.0 - 200) % 360 + 360) % 360 END::DOUBLE AS lon, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE n_nationkey * 3.0 - 40 END::DOUBLE AS lat FROM nation)")
def node_extent(spark: SparkSession, d: str) -> DataFrame:
    return edges.extent(node_places(spark, d))


@query("first_seen", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return edges.first_seen(scan.table(spark, d, "events"), "event_type", "event_id")


@query("reduced_groups", sql("SELECT n_regionkey AS \"group\", 'v' || n_nationkey AS var FROM nation WHERE 'v' || n_nationkey IN (SELECT cause FROM edges WHERE lag = 1 UNION SELECT effect FROM edges WHERE lag = 1)"))
def reduced_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = _nation(spark, d).select(F.col("n_regionkey").alias("group"), F.concat(F.lit("v"), "k").alias("var"))
    left = data.edges(spark, d).filter("lag = 1").select(F.col("cause").alias("Cause"), F.col("effect").alias("Effect"))
    return edges.reduced(groups, edges.variables(left))


@query("fitness_of", sql("SELECT 'f' || n_nationkey AS name, coalesce(abs(r.causal_effect), 0) AS effect FROM nation LEFT JOIN runs r ON r.run_idx = 0 AND r.cause = '3-MEDIUM' AND r.effect = ['BUILDING', 'MACHINERY', 'NOTHING'][n_nationkey % 3 + 1] AND r.lag = n_nationkey % 8"))
def fitness_of(spark: SparkSession, d: str) -> DataFrame:
    goal = F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "NOTHING"))), F.col("k") % 3 + 1)
    wanted = _nation(spark, d).select(F.concat(F.lit("f"), "k").alias("name"), F.lit("3-MEDIUM").alias("cause"), goal.alias("effect"), (F.col("k") % 8).alias("lag"))
    return region_search.fitness_of(data.runs(spark, d).filter("run_idx = 0"), wanted)


# forecasts

PARENTS = "parents AS (SELECT ['known', 'new', 'both'][n_nationkey % 3 + 1] AS \"set\", ['EUROPE', 'ASIA'][n_nationkey % 2 + 1] AS target, ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE'][n_nationkey % 4 + 1] AS parent, -(1 + n_nationkey % 7)::INT AS lag FROM nation), cum AS (SELECT \"set\", target, max_season, parent, lag FROM (SELECT *, 7 + lag AS place FROM parents WHERE lag BETWEEN -6 AND -3), (VALUES ('JJA(-1)', 1), ('SON(-1)', 2), ('DJF(0)', 3), ('MAM(0)', 4)) AS s(max_season, upto) WHERE place <= upto)"


def _parents(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), F.col("k") % n + 1)
    return _nation(spark, d).select(pick(("known", "new", "both"), 3).alias("set"), pick(("EUROPE", "ASIA"), 2).alias("target"), pick(("AFRICA", "AMERICA", "ASIA", "EUROPE"), 4).alias("parent"), (-(1 + F.col("k") % 7)).cast("int").alias("lag"))


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return data.panel(spark, d).select("t", "var", (F.col("value") / 1e4).alias("value"), (F.month("season") == 10).alias("masked"))


@query("cumulative_parents", f"WITH {PARENTS} SELECT * FROM cum")
def cumulative_parents(spark: SparkSession, d: str) -> DataFrame:
    return forecast.cumulative_parents(_parents(spark, d), ["set", "target"])


@query("cumulative_designs", sql("SELECT c.\"set\", c.target, c.max_season, g.t::INT AS t, round(g.value / 1e4, 6) AS y, month(g.season) = 10 AS masked, c.parent || '@' || c.lag AS name, round(p.value / 1e4, 6) AS x FROM cum c JOIN panel g ON g.var = c.target JOIN panel p ON p.var = c.parent AND p.t = g.t + c.lag", PARENTS))
def cumulative_designs(spark: SparkSession, d: str) -> DataFrame:
    rows = forecast.cumulative_designs(_masked(spark, d), _parents(spark, d), ["set"])
    return rows.select("set", "target", "max_season", F.col("t").cast("int").alias("t"), r6("y"), "masked", F.explode("x").alias("name", "x")).select("set", "target", "max_season", "t", "y", "masked", "name", r6("x"))


@query("forecast_skill")
def forecast_skill(spark: SparkSession, d: str) -> DataFrame:
    """Pooled skill of the linear models for every set, target and cumulative season, with five folds and the searched grid."""
    out, panel, parents = None, results.stored(_masked(spark, d), "forecast-panel"), results.stored(_parents(spark, d), "forecast-parents")
    for model in ("linear", "ridge", "lassocv", "tigramite_linear"):
        one = forecast.forecasts(panel, parents, ["set"], model).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return forecast.skill_table(out, ["model", "set"])


@query("forecast_trees")
def forecast_trees(spark: SparkSession, d: str) -> DataFrame:
    """The same of a forest and of boosting, over their whole grids, with three folds."""
    out = None
    for model in ("random_forest", "gradient_boosting"):
        one = forecast.forecasts(_masked(spark, d), _parents(spark, d), ["set"], model, "quick").withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return forecast.skill_table(out, ["model", "set"])


@query("forecast_metrics", sql("SELECT k, round(CASE WHEN n >= 2 THEN e END, 4) AS rmse, round(CASE WHEN n > 2 THEN c * sqrt(n - 2) / sqrt(1 - c * c) END, 3) AS t, n FROM (SELECT k, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS e, corr(y_true, y_pred) AS c, count(*) AS n FROM (SELECT a.value / 1e4 AS y_true, b.value / 1e4 AS y_pred, a.t % 3 AS k FROM panel a JOIN panel b ON a.t = b.t AND a.var = 'ASIA' AND b.var = 'AMERICA') GROUP BY k)"))
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = data.panel(spark, d)
    own = lambda v, n: p.filter(F.col("var") == v).select("t", (F.col("value") / 1e4).alias(n))
    pairs = own("ASIA", "y_true").join(own("AMERICA", "y_pred"), "t").withColumn("k", F.col("t") % 3)
    return forecast.skill(pairs, ["k"]).select("k", r4("rmse"), (F.round("t", 3) + 0.0).alias("t"), "n")


# coupled modes


def _field(spark: SparkSession, d: str, name: str) -> DataFrame:
    value = {"a": F.col("anom"), "x": F.col("anom") * F.cos(F.col("cell")), "y": F.col("anom") * F.sin(F.col("cell") * 2) + F.col("lat")}[name]
    return data.anom(spark, d).select("cell", "lat", "lon", "season", value.alias("value"))


CELL = ["cell", "lat", "lon"]


@query("mca_prepared", sql("SELECT cell, season, round(z * weight, 4) + 0.0 AS value, round(weight, 6) AS weight FROM (SELECT cell, season, sqrt(greatest(cos(radians(lat)), 0)) AS weight, (e - avg(e) OVER w) / nullif(stddev_pop(e) OVER w, 0) AS z FROM (SELECT a.cell, a.lat, a.season, a.anom - m - b * (i.value - x) AS e FROM anom a JOIN idx i ON i.season = a.season AND i.name = 'ASIA' JOIN (SELECT cell, avg(anom) AS m, avg(i.value) AS x, regr_slope(anom, i.value) AS b FROM anom JOIN idx i ON i.season = anom.season AND i.name = 'ASIA' GROUP BY cell) s ON s.cell = a.cell) WINDOW w AS (PARTITION BY cell, month(season)))"))
def mca_prepared(spark: SparkSession, d: str) -> DataFrame:
    signal = data.idx(spark, d).filter("name = 'ASIA'").select("season", "value")
    return coupled.prepared(_field(spark, d, "a"), CELL, signal).select("cell", "season", r4("value"), r6("weight"))


@query("time_gram", sql("SELECT i.t::INT AS i, j.t::INT AS j, round(sum(i.x * j.x), 4) + 0.0 AS v FROM g i JOIN g j USING (cell) GROUP BY ALL", "c AS (SELECT cell, season, anom / 1e4 AS x FROM anom WHERE cell IN (SELECT cell FROM anom GROUP BY cell HAVING count(*) = (SELECT count(DISTINCT season) FROM anom))), g AS (SELECT cell, dense_rank() OVER (ORDER BY season) - 1 AS t, x - avg(x) OVER (PARTITION BY cell) AS x FROM c)"))
def time_gram(spark: SparkSession, d: str) -> DataFrame:
    a = data.anom(spark, d).select(*CELL, "season", (F.col("anom") / 1e4).alias("value"), F.lit(1.0).alias("weight"))
    n = a.select("season").distinct().count()
    gram = coupled.time_gram(coupled.series(a, CELL, n), n)
    rows = spark.createDataFrame([(i, j, float(gram[i, j])) for i in range(n) for j in range(n)], "i int, j int, v double")
    return rows.select("i", "j", r4("v"))


def _coupled(spark: SparkSession, d: str, right: str) -> tuple:
    fields = [coupled.prepared(_field(spark, d, n), CELL) for n in ("a", *right)]
    return coupled.mca(fields[0], fields[1:], CELL)


@query("mca_scalar")
def mca_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _coupled(spark, d, "x")[0]


@query("mca_vector")
def mca_vector(spark: SparkSession, d: str) -> DataFrame:
    """Components of the coupled modes of a scalar and a vector field."""
    return _coupled(spark, d, "xy")[0]


@query("mca_vector_patterns")
def mca_vector_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The patterns of both fields, with the weights taken out and the size of their components."""
    _, left, right, _ = _coupled(spark, d, "xy")
    named = [left.withColumn("part", F.lit("left")), *(p.withColumn("part", F.lit(n)) for p, n in zip(right, ("x", "y"), strict=True))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("pcmci_gpdc")
def pcmci_gpdc(spark: SparkSession, d: str) -> DataFrame:
    """The causal graph by distance correlation of what Gaussian processes leave."""
    p = data.panel(spark, d).select(F.lit(0).alias("run_idx"), F.lit(0.05).alias("alpha"), "t", "var", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(False).alias("masked"))
    return pcmci.discover(p, ["run_idx"], test="gpdc")


@query("set_graphs")
def set_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The robust graph of each predictor set towards the target: its variables and the target alone enter its runs, one for each alpha."""
    members = spark.createDataFrame([(s, v) for s, vs in (("known", ["AFRICA", "AMERICA", "EUROPE"]), ("new", ["ASIA", "MIDDLE EAST", "EUROPE"]), ("both", ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST", "EUROPE"])) for v in vs], "set string, var string")
    p = data.panel(spark, d).select("t", "var", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(False).alias("masked")).join(F.broadcast(members), "var")
    alphas = F.explode(F.array(*(F.struct(F.lit(i).alias("run_idx"), F.lit(a).alias("alpha")) for i, a in enumerate((0.05, 0.025, 0.015, 0.01)))))
    runs = pcmci.discover(p.withColumn("a", alphas).select("set", "a.run_idx", "a.alpha", "t", "var", "value", "masked"), ["set", "run_idx"])
    return edges.graphs(runs, None, ["EUROPE"], least=1)


@query("robust_by_set", sql("SELECT \"set\", cause, effect, lag, round(avg_effect, 6) AS effect_size, round(avg_p, 6) AS p_value FROM (SELECT CASE WHEN lag <= 3 THEN 'near' ELSE 'far' END AS \"set\", cause, effect, lag, count(*) FILTER (p_value <= alpha) AS hits, count(DISTINCT run_idx) AS n, avg(causal_effect) FILTER (p_value <= alpha) AS avg_effect, avg(p_value) FILTER (p_value <= alpha) AS avg_p, count(*) FILTER (p_value <= alpha AND causal_effect > 0) AS pos, count(*) FILTER (p_value <= alpha AND causal_effect < 0) AS neg FROM runs GROUP BY ALL) WHERE hits / n >= 0.5 AND avg_p <= 0.05 AND abs(avg_effect) >= 0.15 AND (CASE WHEN avg_effect > 0 THEN pos ELSE neg END) / hits >= 0.9"))
def robust_by_set(spark: SparkSession, d: str) -> DataFrame:
    own = data.runs(spark, d).withColumn("set", F.when(F.col("lag") <= 3, "near").otherwise("far"))
    return edges.robust(edges.persistence(own, least_ratio=0.5, by=("set",)), ("set",)).select("set", "cause", "effect", "lag", r6("effect_size"), r6("p_value"))


BANDS = "b AS (SELECT * FROM (VALUES ('south', -60.0, -15.0), ('middle', -20.0, 20.0)) AS b(band, lo, hi)), f AS (SELECT year(season)::INT AS year, month(season)::INT AS level, lat, lon, anom AS value FROM anom), m AS (SELECT year, level, band, lon, avg(value) AS value FROM f JOIN b ON lat BETWEEN lo AND hi GROUP BY ALL), yr AS (SELECT year(season)::INT AS year, avg(value) AS value FROM idx WHERE name = 'ASIA' GROUP BY ALL), ev AS (SELECT * FROM (SELECT year, 'high' AS kind FROM yr ORDER BY value DESC, year DESC LIMIT 3) UNION ALL SELECT * FROM (SELECT year, 'low' FROM yr ORDER BY value, year LIMIT 3))"


@query("vertical_composites", sql("SELECT band, level, lon, round(avg(value) FILTER (kind = 'high'), 4) AS high, round(avg(value) FILTER (kind = 'low'), 4) AS low, round(avg(value) FILTER (kind = 'high') - avg(value) FILTER (kind = 'low'), 4) AS diff FROM m JOIN ev USING (year) GROUP BY band, level, lon", BANDS))
def vertical_composites(spark: SparkSession, d: str) -> DataFrame:
    a = data.anom(spark, d).select(F.year("season").alias("year"), F.month("season").alias("level"), "lat", "lon", F.col("anom").alias("value"))
    bands = spark.createDataFrame([("south", -60.0, -15.0), ("middle", -20.0, 20.0)], "band string, lat_min double, lat_max double")
    years = data.idx(spark, d).filter("name = 'ASIA'").groupBy(F.year("season").alias("year")).agg(F.avg("value").alias("value"))
    events = season.extreme_years(years, 3).select("year", "kind")
    return composite.by_bands(a, bands, events).select("band", "level", "lon", r4("high"), r4("low"), r4("diff"))


@query("named_indices")
def named_indices(spark: SparkSession, d: str) -> DataFrame:
    """The E, C, SPO, NPO and PSA indices of the field, in boxes that its few cells fill."""
    a = data.anom(spark, d).select("lat", "lon", "season", F.col("anom").alias("value"))
    out = None
    for name, box in (("EC", (-60, 60, -180, 180)), ("SPO", (-60, 0, -180, 180)), ("NPO", (0, 60, -180, 180)), ("PSA", (-60, 60, -180, 180))):
        one = indices.named(a, name, box)
        out = one if out is None else out.unionByName(one)
    return out


# scans and alignments


RAW = "w AS (SELECT season, cell, lat, lon, anom, (cell % 4) * 250 AS level, CASE WHEN cell % 7 = 3 THEN NULL ELSE anom END AS value FROM anom)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """The field as files have it: other names, helper columns, longitudes from 0 to 360, NaN for what is missing."""
    a = data.anom(spark, d)
    value = F.when(F.col("cell") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("anom"))
    return a.select(F.col("season").alias("valid_time"), F.col("lat").alias("latitude"), F.pmod("lon", F.lit(360.0)).alias("longitude"), ((F.col("cell") % 4) * 250).alias("pressure_level"), F.lit(0).alias("number"), F.lit("0001").alias("expver"), value.alias("z"))


@query("scan_one_level", sql("SELECT season AS time, lat, round(lon, 6) AS lon, round(value * 2 + 1, 4) AS value FROM w WHERE level = 500 AND lat BETWEEN -50 AND 40", RAW))
def scan_one_level(spark: SparkSession, d: str) -> DataFrame:
    field = scan.normalise(_raw(spark, d), "z", scale=2.0, transform=lambda v: v + 1, level=500, lat=(40, -50))
    return field.select("time", "lat", r6("lon"), r4("value"))


@query("scan_mean_levels", sql("SELECT season AS time, lat, round(lon, 6) AS lon, round(avg(value), 4) AS value FROM w WHERE level BETWEEN 250 AND 500 GROUP BY season, lat, lon", RAW))
def scan_mean_levels(spark: SparkSession, d: str) -> DataFrame:
    return scan.normalise(_raw(spark, d), "z", mean_levels=(500, 250)).select("time", "lat", r6("lon"), r4("value"))


@query("union_of_scans", sql("SELECT season AS time, level, lat, round(lon, 6) AS lon, round(value, 4) AS value FROM w WHERE level <= 250 UNION ALL SELECT season, level, lat, round(lon, 6), round(value, 4) FROM w WHERE level = 750", RAW))
def union_of_scans(spark: SparkSession, d: str) -> DataFrame:
    """Files of some levels each, one under another."""
    raw = _raw(spark, d)
    parts = [scan.normalise(raw.filter(c), "z") for c in ("pressure_level <= 250", "pressure_level = 750")]
    return parts[0].unionByName(parts[1]).select("time", "level", "lat", r6("lon"), r4("value"))


@query("wind_pair", sql("SELECT season, cell, round(anom, 4) AS u, round(anom * 0.5, 4) AS v FROM anom WHERE cell % 3 <> 0 AND month(season) <> 4"))
def wind_pair(spark: SparkSession, d: str) -> DataFrame:
    a = data.anom(spark, d)
    u, v = a.filter("cell % 3 <> 0").select("season", "cell", F.col("anom").alias("value")), a.filter("month(season) <> 4").select("season", "cell", (F.col("anom") * 0.5).alias("value"))
    return scan.wind_pair(u, v, ["season", "cell"]).select("season", "cell", r4("u"), r4("v"))


@query("cyclic_wind", sql("SELECT season, lat, lon, round(value, 4) AS u, round(value * 0.5, 4) AS v FROM g UNION ALL SELECT season, lat, 180.0, round(value, 4), round(value * 0.5, 4) FROM g WHERE lon = -180", "g AS (SELECT season, cell % 5 AS lat, (cell // 5) * 72.0::DOUBLE - 180 AS lon, anom AS value FROM anom)"))
def cyclic_wind(spark: SparkSession, d: str) -> DataFrame:
    uv = data.anom(spark, d).select("season", (F.col("cell") % 5).alias("lat"), (F.floor(F.col("cell") / 5) * F.lit(72.0) - 180).alias("lon"), F.col("anom").alias("u"), (F.col("anom") * 0.5).alias("v"))
    return grid.cyclic_point(uv, 72.0).select("season", "lat", "lon", r4("u"), r4("v"))


@query("symmetric_levels_rounded", sql("SELECT cell, round(-round(max(abs(anom)) / 30000) * 30000, 4) + 0.0 AS low, (2 * round(max(abs(anom)) / 30000) + 1)::INT AS n FROM anom GROUP BY cell"))
def symmetric_levels_rounded(spark: SparkSession, d: str) -> DataFrame:
    top = data.anom(spark, d).groupBy("cell").agg(F.max(F.abs("anom")).alias("top"))
    levels = top.withColumn("levels", grid.symmetric_levels(F.col("top"), 30000.0, rounded=True))
    return levels.select("cell", (F.round(F.element_at("levels", 1), 4) + 0.0).alias("low"), F.size("levels").alias("n"))


@query("majority_significant", sql("SELECT cause, effect, avg((p_value < 0.025)::INT) > 0.5 AS keep FROM runs GROUP BY cause, effect"))
def majority_significant(spark: SparkSession, d: str) -> DataFrame:
    return data.runs(spark, d).groupBy("cause", "effect").agg(grid.majority_significant(F.col("p_value"), 0.025).alias("keep"))


@query("slope_significance_rows", sql("SELECT cell, round(b, 4) AS slope, round(se, 4) AS se, round(b / nullif(se, 0), 4) AS t, abs(b / nullif(se, 0)) >= 2.0 AS significant FROM (SELECT cell, regr_slope(y, x) AS b, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / nullif(count(*) - 2, 0) / nullif(regr_sxx(y, x), 0)) AS se FROM (SELECT cell, x, CASE WHEN month(season) = 7 THEN NULL ELSE y END AS y FROM yx) GROUP BY cell)", ONTO))
def slope_significance_rows(spark: SparkSession, d: str) -> DataFrame:
    gaps = _onto(spark, d).withColumn("y", F.when(F.month("season") != 7, F.col("y")))
    return stats.slope_significance(gaps, ["cell"], F.lit(2.0), n_mode="rows").select("cell", r4("slope"), r4("se"), r4("t"), "significant")


@query("months_of_year", "SELECT year, lpad(m::VARCHAR, 2, '0') AS month FROM (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders), (SELECT unnest(range(1, 13)) AS m)")
def months_of_year(spark: SparkSession, d: str) -> DataFrame:
    return scan.months_of(scan.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct())


@query("remove_signal_3", sql("SELECT cell, season, round(e2 - coalesce(regr_slope(e2, c2) OVER v * (c2 - avg(c2) OVER v), 0) - avg(e2) OVER v, 3) + 0.0 AS residual FROM (SELECT cell, season, e1 - avg(e1) OVER v - regr_slope(e1, b1) OVER v * (b1 - avg(b1) OVER v) AS e2, c1 - avg(c1) OVER v - regr_slope(c1, b1) OVER v * (b1 - avg(b1) OVER v) AS c2 FROM (SELECT cell, season, y - avg(y) OVER v - regr_slope(y, a) OVER v * (a - avg(a) OVER v) AS e1, b - avg(b) OVER v - regr_slope(b, a) OVER v * (a - avg(a) OVER v) AS b1, c - avg(c) OVER v - regr_slope(c, a) OVER v * (a - avg(a) OVER v) AS c1 FROM yabc WINDOW v AS (PARTITION BY cell)) WINDOW v AS (PARTITION BY cell)) WINDOW v AS (PARTITION BY cell)", "yabc AS (SELECT t.cell, t.season, t.anom / 1e3 AS y, i.value / 1e3 AS a, j.value / 1e3 AS b, k.value / 1e3 AS c FROM anom t JOIN idx i ON i.season = t.season AND i.name = 'EUROPE' JOIN idx j ON j.season = t.season AND j.name = 'ASIA' JOIN idx k ON k.season = t.season AND k.name = 'AFRICA')"))
def remove_signal_3(spark: SparkSession, d: str) -> DataFrame:
    names = ["EUROPE", "ASIA", "AFRICA"]
    wide = data.idx(spark, d).filter(F.col("name").isin(names)).groupBy("season").pivot("name", names).agg(F.first("value") / 1e3)
    both = data.anom(spark, d).join(wide.dropna(), "season").withColumn("y", F.col("anom") / 1e3)
    return stats.remove_signal(both, ["cell"], names).select("cell", "season", (F.round("residual", 3) + 0.0).alias("residual"))


@query("work_outcomes", "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 5) AS succeeded, count(*) FILTER (value < 5 OR value IS NULL) AS failed, (CASE WHEN bool_and(coalesce(value, 0) >= 5) THEN 0 WHEN bool_or(coalesce(value, 0) >= 5) THEN 2 ELSE 1 END)::INT AS exit_code FROM events GROUP BY event_type")
def work_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return scan.outcomes(scan.table(spark, d, "events"), F.col("value") >= 5, ["event_type"])


SIGNIFICANT = """y3 AS (SELECT year(season) AS year, avg(value) AS value FROM idx WHERE name = 'ASIA' GROUP BY 1),
e3 AS (SELECT year, 'high' AS kind FROM (SELECT * FROM y3 ORDER BY value DESC, year DESC LIMIT 3) UNION ALL SELECT year, 'low' FROM (SELECT * FROM y3 ORDER BY value, year LIMIT 3)),
g AS (SELECT cell, avg(anom) FILTER (kind = 'high') AS ma, avg(anom) FILTER (kind = 'low') AS mb, count(*) FILTER (kind = 'high') AS na, count(*) FILTER (kind = 'low') AS nb, var_samp(anom) FILTER (kind = 'high') / count(*) FILTER (kind = 'high') AS qa, var_samp(anom) FILTER (kind = 'low') / count(*) FILTER (kind = 'low') AS qb FROM anom JOIN e3 ON e3.year = year(season) GROUP BY cell),
h AS (SELECT *, (ma - mb) / sqrt(qa + qb) AS t, pow(qa + qb, 2) / (qa * qa / (na - 1) + qb * qb / (nb - 1)) AS df FROM g)"""


@query("composite_significance", sql(f"SELECT cell, round(ma, 4) AS high, round(mb, 4) AS low, round(ma - mb, 4) AS diff, round(t, 4) AS t, round(df, 4) AS df, round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN round(ma - mb, 4) END AS kept FROM (SELECT *, {two_sided_real('t', 'df')} AS p FROM h)", SIGNIFICANT))
def composite_significance(spark: SparkSession, d: str) -> DataFrame:
    """Differences between extreme years in each cell and season, with p-values, kept where they are significant."""
    years = data.idx(spark, d).filter("name = 'ASIA'").groupBy(F.year("season").alias("year")).agg(F.avg("value").alias("value"))
    field = data.anom(spark, d).select(F.year("season").alias("year"), "cell", F.col("anom").alias("value"))
    out = composite.significant(composite.high_low(field, season.extreme_years(years, 3).select("year", "kind"), ["cell"]))
    return out.select("cell", *(r4(c) for c in ("high", "low", "diff", "t", "df")), r6("p_value"), r4("kept"))


@query("resumed_streamfunction", sql("""SELECT season, lat, level, round(sum(coalesce((f + p) / 2 * (level - q), 0)) OVER (PARTITION BY season, lat ORDER BY level) / 1e9, 4) AS psi, year(season)::INT AS year FROM (
  SELECT *, lag(f) OVER w AS p, lag(level) OVER w AS q FROM (SELECT season, cell % 5 AS lat, (cell // 5) * 72.0::DOUBLE + 20 AS level, value * (2 * 3.141592653589793 * 6.371e6 / 9.80665) * cos(radians(cell % 5)) AS f FROM sea) WINDOW w AS (PARTITION BY season, lat ORDER BY level))"""))
def resumed_streamfunction(spark: SparkSession, d: str) -> DataFrame:
    """The mass stream function in chunks of a year: a first run stops after two of them, a second one does the rest."""
    levels = data.sea(spark, d).select("season", (F.col("cell") % 5).alias("lat"), (F.floor(F.col("cell") / 5) * F.lit(72.0) + 20).alias("level"), "value", F.year("season").alias("year"))
    path = results.shared_path(spark, "streamfunction")

    def work(years: DataFrame) -> DataFrame:
        some = levels.join(F.broadcast(years), "year", "left_semi")
        return calculus.mass_streamfunction(some, ["season"]).select("season", "lat", "level", r4(F.col("psi") / 1e9, "psi"), F.year("season").alias("year"))

    schema = "season date, lat long, level double, psi double, year int"
    for most in (2, 0):
        progress.fill(spark, path, schema, levels.select("year").distinct(), ["year"], work, at_once=1, most=most)
    return progress.result(spark, path, schema)


@query("raw_tree_scan", "SELECT o_orderpriority AS variable, year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL")
def raw_tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """Raw files by variable and year through the data source, which plans those two variables and four years only."""
    path = results.shared_path(spark, "raw-tree")
    o = scan.table(spark, d, "orders").select(F.trim("o_orderpriority").alias("variable"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    o.hint("rebalance", "variable", "year").write.partitionBy("variable", "year").parquet(path)
    read = raw_tree.read(spark, path).filter(F.col("year").between(1996, 1999) & F.col("variable").isin("1-URGENT", "5-LOW"))
    return read.groupBy("variable", "year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("clustered_box_scan", sql("SELECT cell, time, round(value, 2) AS value FROM raw WHERE lat BETWEEN -20 AND 20 AND lon BETWEEN 100 AND 180 AND time BETWEEN '1997-01-01' AND '1998-12-31'"))
def clustered_box_scan(spark: SparkSession, d: str) -> DataFrame:
    """A box in space and time out of a field whose files follow a space-filling curve."""
    path = results.shared_path(spark, "clustered")
    scan.write_clustered(data.raw(spark, d), path, ["time", "lat", "lon"])
    times = F.col("time").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-12-31").cast("timestamp_ntz"))
    return spark.read.parquet(path).filter(grid.in_box(-20, 20, 100, 180) & times).select("cell", "time", F.round("value", 2).alias("value"))


@query("composite_cube", sql("""SELECT cell, "case", season_lag, place::INT AS place, CASE WHEN m <> 10 THEN round(CASE "case" WHEN 'high' THEN high WHEN 'low' THEN low ELSE high - low END, 4) END AS value, CASE WHEN m <> 10 THEN round(CASE "case" WHEN 'high' THEN high / nullif(sqrt(vh / nh), 0) WHEN 'low' THEN low / nullif(sqrt(vl / nl), 0) ELSE (high - low) / nullif(sqrt(vh / nh + vl / nl), 0) END, 4) END AS t
  FROM (SELECT * FROM (SELECT DISTINCT cell FROM anom) c, (VALUES (1, 'DJF_0', 0), (4, 'MAM_0', 1), (7, 'JJA_0', 2), (10, 'SON_0', 3)) l(m, season_lag, place), (VALUES ('high'), ('low'), ('diff')) k("case"))
  LEFT JOIN (SELECT cell, month(season) AS m, avg(anom) FILTER (kind = 'high') AS high, avg(anom) FILTER (kind = 'low') AS low, var_samp(anom) FILTER (kind = 'high') AS vh, var_samp(anom) FILTER (kind = 'low') AS vl, count(*) FILTER (kind = 'high') AS nh, count(*) FILTER (kind = 'low') AS nl
    FROM anom JOIN ev ON ev.year = year(season) GROUP BY ALL) USING (cell, m)""", EVENTS))
def composite_cube(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, which share a season, make one cube; a season that neither has is empty in it."""
    path, schema = results.shared_path(spark, "cube"), "cell int, value double, t double, df double, case string, season_lag string"
    names = F.create_map(*(F.lit(x) for pair in {1: "DJF_0", 4: "MAM_0", 7: "JJA_0"}.items() for x in pair))
    field = data.anom(spark, d).select(F.col("cell").cast("int").alias("cell"), F.year("season").alias("year"), names[F.month("season")].alias("season_lag"), F.col("anom").alias("value"))
    for wanted in (["DJF_0", "MAM_0"], ["MAM_0", "JJA_0"]):
        composite.write_cube(composite.slices(field.filter(F.col("season_lag").isin(wanted)), _events(spark, d), ["cell"]), path)
    return composite.cube(spark, path, schema, ["cell"], ["DJF_0", "MAM_0", "JJA_0", "SON_0"]).select("cell", "case", "season_lag", "place", r4("value"), r4("t"))


@query("surface_pressure", sql("""SELECT season, k::DOUBLE AS lon, round(f0 + (f1 - f0) * (k - x0) / (x1 - x0), 4) AS value FROM (SELECT *, unnest(generate_series(x0::BIGINT, CASE WHEN last THEN x1::BIGINT ELSE x1::BIGINT - 1 END)) AS k FROM (
  SELECT season, lon AS x0, value AS f0, lead(lon) OVER w AS x1, lead(value) OVER w AS f1, lead(lon, 2) OVER w IS NULL AS last FROM (
    SELECT season, (cell // 5) * 72.0::DOUBLE - 180 AS lon, sum(1013.25 * pow(1 - value / 10 / 9.80665 * (0.0065 / 288.15), 9.80665 * 0.0289644 / (8.31447 * 0.0065)) * cos(radians(cell % 5))) / sum(cos(radians(cell % 5))) AS value FROM sea WHERE cell % 5 <= 3 GROUP BY ALL) WINDOW w AS (PARTITION BY season ORDER BY lon)) WHERE x1 IS NOT NULL)"""))
def surface_pressure(spark: SparkSession, d: str) -> DataFrame:
    ground = data.sea(spark, d).select("season", (F.col("cell") % 5).alias("lat"), (F.floor(F.col("cell") / 5) * F.lit(72.0) - 180).alias("lon"), (F.col("value") / 10).alias("value"))
    return calculus.surface_pressure(ground, ["season"], (-2, 2)).select("season", "lon", r4("value"))


VECTORS = "uv AS (SELECT season, cell % 5 AS lat, cell // 5 AS lon, anom / 1e4 AS u, anom * (cell - 12) / 1e5::DOUBLE AS v, cell % 3 <> 1 AS significant FROM anom), "
GRIDDED = VECTORS + "m AS (SELECT season, k, lat + 5 * (k % 4) - 10 AS lat, lon + 5 * (k // 4) AS lon, CASE WHEN significant AND abs(lat + 5 * (k % 4) - 10) > {eq} THEN u END AS u, CASE WHEN significant AND abs(lat + 5 * (k % 4) - 10) > {eq} THEN v END AS v FROM uv, (SELECT unnest(range(16)) AS k)), "
SIZED = GRIDDED + "z AS (SELECT *, sqrt(u * u + v * v) AS size, max(sqrt(u * u + v * v)) OVER (PARTITION BY season) AS top, quantile_cont(sqrt(u * u + v * v), 0.05) OVER (PARTITION BY season) AS low, quantile_cont(sqrt(u * u + v * v), 0.95) OVER (PARTITION BY season) AS high, dense_rank() OVER (PARTITION BY season ORDER BY lat) - 1 AS i, dense_rank() OVER (PARTITION BY season ORDER BY lon) - 1 AS j FROM m)"
WIDTH = "round(CASE WHEN top > 0 THEN coalesce(3 * size / top, 0) WHEN top IS NOT NULL THEN 0 END, 4) AS width"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Maps of 20 x 20 vectors: the 25 cells, side by side sixteen times."""
    k, cell = F.col("k"), F.col("cell")
    a = data.anom(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return a.select("season", (cell % 5 + 5 * (k % 4) - 10).alias("lat"), (F.floor(cell / 5) + 5 * F.floor(k / 4)).alias("lon"), (F.col("anom") / 1e4).alias("u"), (F.col("anom") * (cell - 12) / 1e5).alias("v"), (cell % 3 != 1).alias("significant"))


@query("composite_winds", sql(f"SELECT season, lat, lon, round(u, 4) AS u, round(v, 4) AS v, {WIDTH} FROM z WHERE i % 5 = 0 AND j % 5 = 0", SIZED.format(eq=-1)))
def composite_winds(spark: SparkSession, d: str) -> DataFrame:
    return composite.winds(_vectors(spark, d), ["season"]).select("season", "lat", "lon", r4("u"), r4("v"), r4("width"))


@query("composite_fluxes", sql(f"SELECT season, lat, lon, round(u * r, 4) AS u, round(v * r, 4) AS v, {WIDTH} FROM (SELECT *, CASE WHEN high > low THEN CASE WHEN size <> 0 THEN (1.4 + (least(greatest(size, low), high) - high) * 0.8 / (high - low)) / size ELSE 0 END ELSE 1 END AS r FROM z) WHERE i % 7 = 0 AND j % 7 = 0", SIZED.format(eq=3)))
def composite_fluxes(spark: SparkSession, d: str) -> DataFrame:
    return composite.winds(_vectors(spark, d), ["season"], "waf", equator=3).select("season", "lat", "lon", r4("u"), r4("v"), r4("width"))


@query("wind_bundle", sql("SELECT cell, layer, round(max(CASE WHEN side = 'u' THEN slope END), 4) AS u, round(max(CASE WHEN side = 'v' THEN slope END), 4) AS v, round(max(CASE WHEN side = 'u' THEN r2 END), 4) AS p_u, round(max(CASE WHEN side = 'v' THEN r2 END), 4) AS p_v FROM (SELECT cell, f, f * regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM yx, (VALUES (1), (2), (3)) k(f) GROUP BY cell, f) JOIN (VALUES (1, 'lower', 'u'), (2, 'lower', 'v'), (3, 'upper', 'v')) n(f, layer, side) USING (f) GROUP BY cell, layer", ONTO))
def wind_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The winds of a regression out of its results, of which the upper zonal one is missing."""
    path = results.shared_path(spark, "regressions")
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("var"), F.lit(f).alias("f")) for n, f in (("U_850", 1), ("V_850", 2), ("V_200", 3), ("sst", 7)))))
    fits = stats.slope_map(_onto(spark, d), ["cell"]).select("cell", "slope", "r2", names.alias("n"))
    fits.select("cell", (F.col("slope") * F.col("n.f")).alias("coef"), F.col("r2").alias("p_value"), F.lit("EP").alias("pathway"), "n.var").write.partitionBy("pathway", "var").parquet(path)
    return scan.wind_bundle(spark, path, "850", "200", ["cell"], pathway="EP").select("cell", "layer", r4("u"), r4("v"), r4("p_u"), r4("p_v"))


SET_RUNS = """sr AS (SELECT "set", cause, effect, lag, run_idx, [0.05, 0.025, 0.015, 0.01][run_idx + 1]::DOUBLE AS alpha, (s % 1201 - 400) / 1000.0::DOUBLE AS causal_effect, (s * 7919 % 97) / 4000.0::DOUBLE AS p_value FROM (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS "set", 'v' || c_nationkey % 9 AS cause, 'v' || (o_custkey + o_orderkey) % 9 AS effect, (1 + o_orderkey % 3)::INT AS lag, (o_orderkey // 2 % 4)::INT AS run_idx, sum(o_custkey)::BIGINT AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
ro AS (SELECT "set", cause, effect, lag, avg_effect, avg_p FROM (SELECT "set", cause, effect, lag, count(*) FILTER (p_value <= alpha) AS hits, count(DISTINCT run_idx) AS n, avg(causal_effect) FILTER (p_value <= alpha) AS avg_effect, avg(p_value) FILTER (p_value <= alpha) AS avg_p, count(*) FILTER (p_value <= alpha AND causal_effect > 0) AS pos, count(*) FILTER (p_value <= alpha AND causal_effect < 0) AS neg FROM sr GROUP BY ALL)
  WHERE hits / n >= 0.5 AND avg_p <= 0.05 AND abs(avg_effect) >= 0.05 AND (CASE WHEN abs(avg_effect) <= 1e-8 THEN greatest(pos, neg) WHEN avg_effect > 0 THEN pos ELSE neg END) / hits >= 0.6),
walk AS (SELECT "set", cause, effect, lag, lag AS cum, cause AS at FROM ro WHERE effect IN ('v1', 'v2') AND lag BETWEEN 1 AND 6 UNION SELECT e."set", e.cause, e.effect, e.lag, w.cum + e.lag, e.cause FROM walk w JOIN ro e ON e."set" = w."set" AND e.effect = w.at WHERE w.cum + e.lag BETWEEN 1 AND 6)"""


@query("set_graphs_of_orders", sql('SELECT DISTINCT w."set", w.cause, w.effect, w.lag, round(avg_effect, 8) AS effect_size, round(avg_p, 8) AS p_value FROM walk w JOIN ro USING ("set", cause, effect, lag)', SET_RUNS, recursive=True))
def set_graphs_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """The graphs of two sets towards two targets, walked in the same joins."""
    key = F.col("o_orderkey")
    o = scan.table(spark, d, "orders").join(scan.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = lambda x: F.concat(F.lit("v"), (x % 9).cast("string"))
    g = o.groupBy(F.when(key % 2 == 0, "even").otherwise("odd").alias("set"), name(F.col("c_nationkey")).alias("cause"), name(F.col("o_custkey") + key).alias("effect"), (1 + key % 3).cast("int").alias("lag"), (F.floor(key / 2) % 4).cast("int").alias("run_idx")).agg(F.sum("o_custkey").alias("s"))
    alpha = F.element_at(F.array(*(F.lit(a) for a in (0.05, 0.025, 0.015, 0.01))), F.col("run_idx") + 1)
    runs = g.select("set", "cause", "effect", "lag", "run_idx", alpha.alias("alpha"), ((F.col("s") % 1201 - 400) / 1000.0).alias("causal_effect"), (F.col("s") * 7919 % 97 / 4000.0).alias("p_value"))
    return edges.graphs(runs, None, ["v1", "v2"], least=1, least_ratio=0.5, least_consistency=0.6, least_effect=0.05).select("set", "cause", "effect", "lag", F.round("effect_size", 8).alias("effect_size"), F.round("p_value", 8).alias("p_value"))


PAIRED = """pair AS (SELECT g.target, g.parent, a.t + g.lag AS t, a.value AS x FROM panel a JOIN (VALUES ('ASIA', 'EUROPE', 2), ('AFRICA', 'ASIA', 1), ('EUROPE', 'EUROPE', 4)) g(target, parent, lag) ON a.var = g.parent),
both_ AS (SELECT p.target, p.t, p.x, b.value AS y FROM pair p LEFT JOIN panel b ON b.var = p.target AND b.t = p.t),
m AS (SELECT target, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM both_ WHERE y IS NOT NULL GROUP BY target)"""


@query("graph_models", sql("SELECT target, both_.t::INT AS t, round(y, 4) AS y_true, round(a + b * x, 4) AS y_pred FROM both_ JOIN m USING (target)", PAIRED))
def graph_models(spark: SparkSession, d: str) -> DataFrame:
    """Each target from its lagged parent, all targets at once, with the steps past the end."""
    p = data.panel(spark, d).select("t", "var", "value")
    graph = spark.createDataFrame([("ASIA", "EUROPE", 2), ("AFRICA", "ASIA", -1), ("EUROPE", "EUROPE", 4)], "target string, parent string, lag int")
    return lagged.predict(p, graph, lagged.fit(p, graph, []), []).select("target", F.col("t").cast("int").alias("t"), r4("y_true"), r4("y_pred"))


@query("mca_driver")
def mca_driver(spark: SparkSession, d: str) -> DataFrame:
    """From a temperature and two winds to the patterns of their first modes, without the cold tongue's signal."""
    a = data.anom(spark, d).select((F.col("cell") % 5 * 3 - 6).alias("lat"), (F.floor(F.col("cell") / 5) * 72.0).alias("lon"), "season", F.col("anom").alias("value"), "cell")
    u, v = (a.withColumn("value", f).drop("cell") for f in (F.col("value") * F.cos(F.col("cell").cast("double")), F.col("value") * F.sin(F.col("cell").cast("double"))))
    _, pattern, winds, _ = coupled.drive(a.drop("cell"), u, v, (-6, 6, 0, 360), ["lat", "lon"], 2)
    return pattern.join(winds, ["lat", "lon", "mode"], "full")
