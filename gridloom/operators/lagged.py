"""Linear models on a causal graph: each target from its lagged parents, all targets in one plan.

The model of a target is the least-squares fit on its parents' values, each at its own lag; a new panel is predicted by the same parents. A target
of whose steps too few are known, or whose parents depend on each other, gets the least coefficients that fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import nested


def design(panel: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, target, t, y, x``: a target's value beside its parents', by place in the order of (parent, lag); steps at which a parent is unknown
    are left out. panel: ``keys, t, var, value``; parents: ``keys, target, parent, lag`` with lags as steps back, a dimension table."""
    own = [*keys, "target"]
    listed = parents.groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("parent", F.abs("lag").alias("lag")))).alias("_all"))
    places = listed.select(*own, F.size("_all").alias("k"), F.posexplode("_all").alias("i", "_p")).select(*own, "k", "i", F.col("_p.parent").alias("parent"), F.col("_p.lag").alias("lag"))
    known = panel.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    used = known.select(*keys, F.col("var").alias("parent"), "t", "value").join(places, [*keys, "parent"]).select(*own, "k", "i", (F.col("t") + F.col("lag")).alias("t"), "value")
    rows = used.groupBy(*own, "k", "t").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s")).filter(F.size("s") == F.col("k")).select(*own, "t", F.col("s.value").alias("x"))
    goal = panel.select(*keys, F.col("var").alias("target"), "t", F.col("value").alias("y"))
    return rows.join(goal, [*own, "t"], "left")


def fit(panel: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, target, n, coefs``: intercept and coefficients in the order of (parent, lag), by sums of products over the known steps that are not
    ``masked`` (if the panel has that column: hidden steps of a target do not train)."""
    own = [*keys, "target"]
    seen = panel.select(*keys, "t", "var", "value", (F.coalesce("masked", F.lit(False)) if "masked" in panel.columns else F.lit(False)).alias("masked"))
    hidden = seen.filter("masked").select(*keys, F.col("var").alias("target"), "t")
    rows = design(panel, parents, keys).filter(F.col("y").isNotNull() & ~F.isnan("y")).join(hidden, [*own, "t"], "left_anti")
    z = F.concat(F.array(F.lit(1.0)), "x", F.array(F.col("y").cast("double")))
    products = rows.select(*own, F.posexplode(F.flatten(F.transform(z, lambda a: F.transform(z, lambda b: a * b)))).alias("at", "p"))
    sums = products.groupBy(*own, "at").agg(F.sum("p").alias("p")).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("s")).select(*own, F.col("s.p").alias("before"))
    cases = sums.select(*own, F.get("before", F.lit(0)).cast("long").alias("n"), F.lit(0.0).alias("alpha"), "before", F.lit(None).cast("array<double>").alias("upto"))
    return nested.fitted(cases, scaled=False).select(*own, "n", "coefs")


def predict(panel: DataFrame, parents: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, target, t, y_true, y_pred`` for every step at which a model's parents are known, one past the panel's end included."""
    own = [*keys, "target"]
    terms = F.zip_with("coefs", F.concat(F.array(F.lit(1.0)), "x"), lambda a, b: a * b)
    return design(panel, parents, keys).join(models.select(*own, "coefs"), own).select(*own, "t", F.col("y").alias("y_true"), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("y_pred"))
