"""Operations that need all rows in one order, with no task that holds them all.

Rows are sorted into ranges. Each range does its part alone; what passes from one range to another is a row a range (or two, where rows
also have families), so it is broadcast whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.results import stored

#: So many rows a range: there are as many more ranges, and tasks, as the table grows, and none sorts more than its range.
RANGE_ROWS = 250_000


def range_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` ranges in a partition of its own. Hashed to the session's partitions, as a window would have it, several meet in one
    task, and a task's share grows with the table."""
    return rows.repartitionById(n, F.col("_range"))


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, ascending by ``order``, and ``_tie``, which tells rows of one place in the order apart; so a place that
    very many rows share is cut into ranges like any other. It is written: numbers of partitions hold for one run only."""
    n = ranges or range_count(df)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return stored(tied.repartitionByRange(n, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")


def _position(df: DataFrame, time: str) -> Column:
    """A time as microseconds, a number as it is."""
    kind, t = df.schema[time].dataType.typeName(), F.col(time)
    if kind not in ("date", "timestamp", "timestamp_ntz"):
        return t.cast("double")
    day = F.unix_date(t.cast("date")).cast("long") * 86_400_000_000
    if kind == "date":
        return day
    return day + (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def asof_nearest(events: DataFrame, series: DataFrame, time: str, value: str, ranges: int | None = None) -> DataFrame:
    """Every event with the series' ``value`` at the nearest time, however far; the earlier of two that are as near. NULL for an event
    without a time, or without any series.

    Both sides are merged by ranges of time. An event looks back and ahead in its own range, and beyond it takes the last point of the
    ranges before and the first of those after. Of several rows of the series at one time the least value counts; rows without a time do
    not. ``time`` is a date, a timestamp or a number, of one type on both sides. Other columns of the events stay, but for one named ``value``."""
    kept = [c for c in events.columns if c != value]
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    points = series.filter(F.col(time).isNotNull()).groupBy(_position(series, time).alias("_at")).agg(F.min(value).alias("_v"))
    marked = points.select("_at", F.lit(0).alias("_side"), F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")).alias("_point"), F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    asked = events.select(_position(events, time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marked.schema["_point"].dataType).alias("_point"), row.alias("_row"))
    every = marked.unionByName(asked.filter("_at IS NOT NULL"))
    n = ranges or range_count(every)
    both = in_ranges(every, ["_at", "_side"], n)
    ends = both.groupBy("_range").agg(F.min("_point").alias("first"), F.max("_point").alias("last"))
    line = Window.orderBy("_range")  # a row a range
    carried = ends.select(
        "_range",
        F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.last("first", ignorenulls=True).over(Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
    )
    own = Window.partitionBy("_range")
    back = own.orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ahead = own.orderBy(F.col("_at").desc(), F.col("_side").desc(), F.col("_tie").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt(both, n).withColumn("_before", F.last("_point", ignorenulls=True).over(back)).withColumn("_after", F.last("_point", ignorenulls=True).over(ahead))
    met = seen.filter("_side = 1").join(F.broadcast(carried), "_range")
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    chosen = F.when(after.isNull() | (F.col("_at") - before["at"] <= after["at"] - F.col("_at")), before["v"]).otherwise(after["v"])
    timeless = asked.filter("_at IS NULL").select("_row", F.lit(None).cast(marked.schema["_point"].dataType["v"].dataType).alias(value))
    return met.select("_row", chosen.alias(value)).unionByName(timeless).select("_row.*", value)


def bh_fdr(df: DataFrame, keys: list[str], p: str = "p_value", out: str = "q_value", ranges: int | None = None) -> DataFrame:
    """Benjamini-Hochberg as ``stats.bh_fdr`` has it, for families of any size: one may have all rows.

    Rows are in ranges of (family, p). A rank is the place in the range plus the rows of the family in earlier ranges; a least value over
    equal or larger p is that of the range and of the family's later ranges. Only families that cross an edge of a range need
    to know of others, at most two a range. NULL and NaN get NULL and do not count; families of NULL keys are families."""
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    names = {f"_k{i}": F.col(f"`{k}`") for i, k in enumerate(keys)}
    every = df.filter(known).withColumns(names)
    n = ranges or range_count(every)
    rows = in_ranges(every, [*names, p], n)
    parts = rows.groupBy("_range", *names).agg(F.count("*").alias("_rows"))
    family = Window.partitionBy(*names)
    spread = parts.withColumn("_parts", F.count("*").over(family)).withColumn("_m", F.sum("_rows").over(family)).withColumn("_before", F.sum("_rows").over(family.orderBy("_range")) - F.col("_rows"))
    crossing = spread.filter("_parts > 1").select("_range", *names, "_m", "_before")

    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"{k}_") for k in names), *(c for c in right.columns if c not in ("_range", *names)))
        same = F.col("_range") == F.col("_r")
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        return left.join(F.broadcast(other), same, how).drop("_r", *(f"{k}_" for k in names))

    own = Window.partitionBy("_range", *names)
    ranked = lambda some: some.withColumn("_q", F.col(p) * F.coalesce("_m", F.count("*").over(own)) / (F.coalesce("_before", F.lit(0)) + F.row_number().over(own.orderBy(p, "_tie"))))
    least = ranked(beside(dealt(rows, n), crossing, "inner")).groupBy("_range", *names).agg(F.min("_q").alias("_least"))
    later = least.select("_range", *names, F.min("_least").over(family.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    down = own.orderBy(F.col(p).desc(), F.col("_tie").desc()).rowsBetween(Window.unboundedPreceding, 0)
    done = beside(ranked(beside(dealt(rows, n), crossing, "left")), later, "left")
    q = F.least(F.lit(1.0), F.min("_q").over(down), F.col("_later"))
    mine = [F.col(f"`{c}`") for c in df.columns if c != out]
    return done.select(*mine, q.alias(out)).unionByName(df.filter(~known | F.col(p).isNull()).select(*mine, F.lit(None).cast("double").alias(out)))
