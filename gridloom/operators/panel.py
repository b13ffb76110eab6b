"""Alignment of series: joins by label, lags, panels and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_inner(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    return left.select(*keys, F.col("value").alias(names[0])).join(right.select(*keys, F.col("value").alias(names[1])), keys)


def align_exact(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join; it raises when run if either side has a label that the other lacks."""
    full = left.select(*keys, F.col("value").alias("a"), F.lit(1).alias("_l")).join(right.select(*keys, F.col("value").alias("b"), F.lit(1).alias("_r")), keys, "full")
    ok = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("labels differ"))
    return full.withColumn("_ok", ok).filter(F.col("_ok").isNull()).drop("_l", "_r", "_ok")


def reindex(axis: DataFrame, series: DataFrame, key: str = "season") -> DataFrame:
    return axis.join(series, key, "left")


def dataset(series: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column a series on the union of all labels: a pivot with stated columns needs one shuffle where outer joins need many."""
    return series.groupBy(key).pivot("name", names).agg(F.first("value"))


def lagged(left: DataFrame, right: DataFrame, k: int, time: str = "t") -> DataFrame:
    """``right`` at ``t - k`` beside ``left`` at ``t``."""
    return left.join(right.withColumn(time, F.col(time) + k), time)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")


def season_mask(panel: DataFrame, months: DataFrame) -> DataFrame:
    """``masked`` where a series' season does not have the month; missing values become 0. months: ``var, months``."""
    return panel.join(F.broadcast(months), "var", "left").select("t", "season", "var", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(~F.array_contains("months", F.month("season")), F.lit(False)).alias("masked"))


def edge_exclusion(t: Column, last: Column, group: Column) -> Column:
    """Steps that are hidden at the ends of the panel, by the group of a variable."""
    return (
        F.when(group == "JJA", t == last - 2)
        .when(group == "SON", t == last - 1)
        .when(group == "DJF", t == last)
        .when(group == "EFFECT", t == 1)
        .when(group == "JJA1", t == 0)
        .otherwise(False)
    )


def effective_samples(panel: DataFrame) -> DataFrame:
    return panel.groupBy("var").agg(F.count_if(~F.col("masked")).alias("n"))


def design_matrix(panel: DataFrame, target: str, parents: list[tuple[str, int]]) -> DataFrame:
    """``t, y`` and a column a parent: the parent ``lag`` steps earlier. One pass over the panel: each row goes to the step that needs it."""
    rows = panel.filter(F.col("var").isin([target, *(p for p, _ in parents)]))
    uses = F.array(F.struct(F.lit(target).alias("v"), F.lit(0).alias("k"), F.lit("y").alias("c")), *(F.struct(F.lit(p).alias("v"), F.lit(k).alias("k"), F.lit(f"x{i}").alias("c")) for i, (p, k) in enumerate(parents)))
    each = rows.select("t", "var", "value", F.explode(uses).alias("u")).filter(F.col("u.v") == F.col("var"))
    return each.select((F.col("t") + F.col("u.k")).alias("t"), F.col("u.c").alias("c"), "value").groupBy("t").pivot("c", ["y", *(f"x{i}" for i in range(len(parents)))]).agg(F.first("value")).filter("y is not null")


def dense(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
