"""Lagged causal edges as tables: persistence over runs, intersection, traversal, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.results import stored

KEY = ["cause", "effect", "lag"]


def persistence(runs: DataFrame, denominator: str = "observed", total: int | None = None, least_ratio: float = 0.75, most_p: float = 0.05, least_consistency: float = 0.9, least_effect: float = 0.15, by: tuple[str, ...] = ()) -> DataFrame:
    """One row an edge. Means are over the runs where p <= alpha; the ratio is of those to the runs that have the edge ('observed') or to
    ``total``. Consistency is the share of effects with the sign of their mean, or of the commoner sign where the mean is near 0.
    All in one aggregation: the sign of the mean picks among counts of each sign. by: columns that keep graphs apart."""
    key = [*by, *KEY]
    hit = F.col("p_value") <= F.col("alpha")
    effect = F.when(hit, F.col("causal_effect"))
    g = runs.groupBy(*key).agg(
        F.count_if(hit).alias("hits"),
        F.count_distinct("run_idx").alias("runs"),
        F.avg(effect).alias("avg_effect"),
        F.avg(F.when(hit, F.col("p_value"))).alias("avg_p_value"),
        F.count_if(effect > 0).alias("pos"),
        F.count_if(effect < 0).alias("neg"),
    )
    runs_of = F.greatest(F.col("runs"), F.lit(1)) if denominator == "observed" else F.lit(total)
    agreeing = F.when(F.abs("avg_effect") <= 1e-8, F.greatest("pos", "neg")).when(F.col("avg_effect") > 0, F.col("pos")).otherwise(F.col("neg"))
    out = g.select(*key, (F.col("hits") / runs_of).alias("persistence_ratio"), "avg_effect", F.abs("avg_effect").alias("abs_effect"), "avg_p_value", F.when(F.col("hits") > 0, agreeing / F.col("hits")).alias("effect_consistency"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "is_persistent": yes(F.col("persistence_ratio") >= least_ratio),
        "has_low_pvalue": yes(F.col("avg_p_value") <= most_p),
        "is_consistent": yes(F.col("effect_consistency") >= least_consistency),
        "has_strong_effect": yes(F.col("abs_effect") >= least_effect),
    }
    out = out.withColumns(flags)
    return out.withColumn("is_robust", F.col("is_persistent") & F.col("has_low_pvalue") & F.col("is_consistent") & F.col("has_strong_effect"))


def robust(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return table.filter("is_robust").select(*by, *KEY, F.col("avg_effect").alias("effect_size"), F.col("avg_p_value").alias("p_value")).withColumn("link", F.lit("-->"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of ``a`` that ``b`` has with the same link."""
    return a.join(b.select(*KEY, "link"), [*KEY, "link"], "left_semi")


def prune_by_fdr(edges: DataFrame, fdr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that both graphs have, and ``before, after, removed``."""
    kept = intersect(edges, fdr)
    n = edges.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("after")))
    return kept, n.withColumn("removed", F.col("before") - F.col("after"))


def toward(edges: DataFrame, targets: list[str], most: int = 6, least: int = 3, mode: str = "bounded", by: tuple[str, ...] = ()) -> DataFrame:
    """The edges on backward paths from the targets whose summed lag stays within bounds.

    'bounded': an edge is followed only if the sum after it is within [least, most]. 'open': no lower bound, and targets are not
    expanded again. States are (variable, summed lag), at most ``most`` steps deep as every lag is 1 or more, so the
    frontier is bounded by variables times lags; each level is one join. by: columns that keep graphs apart, all of which are walked in the same joins."""
    low = least if mode == "bounded" else 0
    edges = stored(edges, "edges")  # read once for each level
    goals = F.explode(F.array(*map(F.lit, targets))).alias("effect")
    frontier = (edges.select(*by).distinct() if by else edges.sparkSession.range(1)).select(*by, goals, F.lit(0).alias("cum"))
    kept = None
    for _ in range(most):
        step = edges.join(frontier, [*by, "effect"]).withColumn("new", F.col("cum") + F.col("lag")).filter(F.col("new").between(low, most))
        used = step.select(*by, *KEY)
        kept = used if kept is None else kept.union(used)
        onward = step if mode == "bounded" else step.filter(~F.col("cause").isin(targets))
        frontier = onward.select(*by, F.col("cause").alias("effect"), F.col("new").alias("cum")).distinct()
    return edges.join(kept.distinct(), [*by, *KEY], "left_semi")


def frequency_threshold(years: Column) -> Column:
    return F.when(years <= 20, 0.3).when(years <= 30, 0.45).otherwise(0.55)


def consensus(windows: DataFrame, n_windows: Column, years: int) -> DataFrame:
    """``cause, effect, lag, frequency, average_effect, link_power, width`` of the links that enough windows have."""
    g = windows.groupBy(*KEY).agg((F.count("*") / n_windows).alias("frequency"), F.avg(F.coalesce("effect_size", F.lit(0.0))).alias("average_effect"))
    g = g.filter(F.col("frequency") >= frequency_threshold(F.lit(years))).withColumn("link_power", F.col("frequency") * F.abs("average_effect"))
    top = g.agg(F.max("link_power").alias("top"))
    return g.crossJoin(F.broadcast(top)).withColumn("width", F.coalesce(F.col("link_power") / F.nullif("top", F.lit(0.0)), F.lit(0.0))).drop("top")


def runs_of_windows(df: DataFrame, keys: list[str], index: str = "window") -> DataFrame:
    """Gaps and islands: ``keys, first, last, n`` of each run of consecutive windows."""
    w = Window.partitionBy(*keys).orderBy(index)
    island = df.select(*keys, index).distinct().withColumn("_i", F.col(index) - F.row_number().over(w))
    return island.groupBy(*keys, "_i").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("_i")


def parents(csv: DataFrame, target: str) -> DataFrame:
    """``parent, lag`` (negative) of a target from the interchange table; lags that are no numbers are dropped."""
    lag = F.expr("try_cast(trim(Lag) as double)")
    return csv.filter(F.trim("Effect") == target).select(F.trim("Cause").alias("parent"), (-F.abs(lag)).cast("int").alias("lag")).filter("lag is not null").distinct()


def variables(csv: DataFrame) -> DataFrame:
    return csv.select(F.col("Cause").alias("var")).union(csv.select("Effect")).distinct()


def target_pairs(csv: DataFrame, targets: list[str]) -> DataFrame:
    return csv.filter(F.col("Effect").isin(targets)).select("Effect", "Lag", "Cause").orderBy("Effect", F.col("Lag").desc(), "Cause")


def all_lags(names: DataFrame, least: int = 1, most: int = 6) -> DataFrame:
    """Every candidate edge ``cause, effect, lag`` among the named variables (a dimension table)."""
    a, b = names.select(F.col("var").alias("cause")), names.select(F.col("var").alias("effect"))
    return a.crossJoin(F.broadcast(b)).select("cause", "effect", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("lag"))


def placed(names: DataFrame, places: DataFrame) -> DataFrame:
    """``var, lon, lat`` of each variable, longitudes in [0, 360); (0, 0) for one that has no place. places: ``var, lon, lat``."""
    held = names.join(F.broadcast(places.select("var", "lon", "lat")), "var", "left")
    zero = F.lit(0.0)
    return held.select("var", F.pmod(F.coalesce(F.col("lon").cast("double"), zero), F.lit(360.0)).alias("lon"), F.coalesce(F.col("lat").cast("double"), zero).alias("lat"))


def extent(places: DataFrame, margin: float = 10.0) -> DataFrame:
    """``lon_min, lon_max, lat_min, lat_max`` around all places, latitudes no further than the poles."""
    return places.agg(
        (F.min("lon") - margin).alias("lon_min"),
        (F.max("lon") + margin).alias("lon_max"),
        F.greatest(F.lit(-90.0), F.min("lat") - margin).alias("lat_min"),
        F.least(F.lit(90.0), F.max("lat") + margin).alias("lat_max"),
    )


def first_seen(df: DataFrame, name: str, order: str) -> DataFrame:
    """Each name once, with the place where it stands first."""
    return df.groupBy(name).agg(F.min(order).alias(order))


def reduced(groups: DataFrame, pruned: DataFrame) -> DataFrame:
    """The variables of each group that the pruned graph still has. groups: ``group, var``."""
    return groups.join(F.broadcast(pruned.select("var").distinct()), "var", "left_semi")


def graphs(runs: DataFrame, adjusted: DataFrame | None, targets: list[str], by: str = "set", most: int = 6, least: int = 3, **limits: float) -> DataFrame:
    """``by, cause, effect, lag, effect_size, p_value, link``: the graph of each predictor set. Edges that persist over the set's runs stay if
    they lie on a path to a target whose summed lag is within bounds, and if the set's run with adjusted p-values has them too (without
    such a run that is not asked). runs: ``by, run_idx, alpha`` and edges; adjusted: ``by, alpha`` and edges. All sets are one plan."""
    table = robust(persistence(runs, by=(by,), **limits), (by,))
    if adjusted is not None:
        kept = adjusted.filter(F.col("p_value") <= F.col("alpha")).select(by, *KEY).distinct()
        table = table.join(kept, [by, *KEY], "left_semi")
    return toward(table, targets, most, least, by=(by,))
