"""Season and calendar algebra. A season's stamp is the first day of its middle month: January, April, July or October."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The month that stands for a season.
MONTHS = {"DJF": 1, "MAM": 4, "JJA": 7, "SON": 10}


def stamp(time: Column) -> Column:
    """December, January and February belong to January, and so on."""
    return F.date_trunc("quarter", time + F.expr("interval 1 month")).cast("date")


def season_name(month: Column) -> Column:
    out = F.when(month.isin(12, 1, 2), "DJF")
    for name, m in list(MONTHS.items())[1:]:
        out = out.when(month.between(m - 1, m + 1), name)
    return out


def monthly(df: DataFrame, cell: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(F.date_trunc("month", "time").alias("time"), *cell).agg(F.avg(value).alias(value))


def seasonal(df: DataFrame, cell: list[str], value: str = "value") -> DataFrame:
    """Seasonal means of a monthly field."""
    return df.groupBy(stamp(F.col("time")).alias("season"), *cell).agg(F.avg(value).alias(value))


def by_month(cell: list[str]) -> Window:
    return Window.partitionBy(*cell, F.month("season"))


def anomaly(df: DataFrame, cell: list[str], value: str = "value", out: str = "anom") -> DataFrame:
    """Minus the mean of the same season of the year, over the rows given (the window is the climatology)."""
    return df.withColumn(out, F.col(value) - F.avg(value).over(by_month(cell)))


def zscore(df: DataFrame, partition: list, value: str = "value", out: str = "z", ddof: int = 0) -> DataFrame:
    w = Window.partitionBy(*partition)
    std = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(std.over(w), F.lit(0.0)))


def zscore_month(df: DataFrame, cell: list[str], value: str = "value", out: str = "z", ddof: int = 0) -> DataFrame:
    return zscore(df, [*cell, F.month("season")], value, out, ddof)


def calendar(df: DataFrame, time: str = "season", months: int = 3) -> DataFrame:
    """The gap-free axis from the first to the last stamp, with ``t`` from 0."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return ends.select(F.posexplode(F.expr(f"sequence(a, b, interval {months} month)"))).select(F.col("pos").alias("t"), F.col("col").cast("date").alias(time))


def shifted(df: DataFrame, cell: list[str], k: int, value: str = "value", out: str = "shifted") -> DataFrame:
    """The value ``k`` seasons earlier, by an equi-join on the stamp: no dense axis is needed."""
    back = df.select(F.add_months("season", 3 * k).alias("season"), *cell, F.col(value).alias(out))
    return df.join(back, ["season", *cell], "left")


def fill_seasons(axis: DataFrame, series: DataFrame, month: int) -> DataFrame:
    """One season's values on the axis of all seasons; NULL elsewhere."""
    return axis.join(series.filter(F.month("season") == month), "season", "left")


def extreme_years(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """``year, value, kind`` of the ``n`` largest and smallest; ties go by year, as a stable ascending sort has them."""
    years = df.filter(F.col(value).isNotNull())
    low = years.orderBy(F.col(value).asc(), F.col("year").asc()).limit(n).withColumn("kind", F.lit("low"))
    high = years.orderBy(F.col(value).desc(), F.col("year").desc()).limit(n).withColumn("kind", F.lit("high"))
    return high.unionByName(low)


def tercile_vote(df: DataFrame, names: list[str], signs: dict[str, int], need: int = 3) -> DataFrame:
    """``year, vote``: upper (lower) if ``need`` of the series lie in their upper (lower) tercile and none in the other, each series
    times its sign; a missing value voids the year. df: ``year, name, value``."""
    sign = F.create_map(*(F.lit(x) for k in names for x in (k, signs.get(k, 1))))
    own = df.filter(F.col("name").isin(names)).withColumn("x", F.col("value") * sign[F.col("name")])
    cuts = own.groupBy("name").agg(F.percentile("x", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"))
    votes = own.join(F.broadcast(cuts), "name").groupBy("year").agg(F.count_if(F.col("x") > F.col("cut")[1]).alias("up"), F.count_if(F.col("x") < F.col("cut")[0]).alias("down"), F.count("x").alias("n"))
    vote = F.when((F.col("up") >= need) & (F.col("down") == 0), "upper").when((F.col("down") >= need) & (F.col("up") == 0), "lower").otherwise("none")
    return votes.filter(F.col("n") == len(names)).select("year", vote.alias("vote"))


def cv_folds(df: DataFrame, k: int, order: str = "t") -> DataFrame:
    """Expanding folds: ``fold, t, part``. The test block has floor(T / (k + 1)) rows; all before it train. df: dense ``t`` from 0."""
    n = df.agg((F.max(order) + 1).alias("n"))
    folds = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).withColumn("size", F.floor(F.col("n") / (k + 1)))
    folds = folds.withColumn("from", F.col("n") - (k - F.col("fold")) * F.col("size"))
    return df.join(F.broadcast(folds), F.col(order) < F.col("from") + F.col("size")).select("fold", order, F.when(F.col(order) >= F.col("from"), "test").otherwise("train").alias("part"))


def pooled_std(df: DataFrame, cell: list[str], out: tuple[str, str] = ("u_n", "v_n")) -> DataFrame:
    """Both components divided by their pooled standard deviation in a month of the year: one pass by sums, no union."""
    w = Window.partitionBy(*cell, F.month("season"))
    n = F.count("u").over(w) + F.count("v").over(w)
    total = F.sum("u").over(w) + F.sum("v").over(w)
    mean = total / n
    squares = F.avg(F.col("u") * F.col("u") + F.col("v") * F.col("v")).over(w) / 2
    std = F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))
    return df.withColumns({o: F.col(c) / F.nullif(std, F.lit(0.0)) for o, c in zip(out, ("u", "v"), strict=True)})


def monthly_axis(df: DataFrame, start: str, order: str = "t", out: str = "time") -> DataFrame:
    """Steps of any number type become months from ``start`` (a first of a month), by their rank; ranks are taken over the distinct steps,
    a short axis, so the field is joined and not sorted."""
    axis = df.select(order).distinct()
    ranked = axis.withColumn("_r", F.row_number().over(Window.orderBy(order)) - 1).select(order, F.expr(f"add_months(date'{start}', _r)").alias(out))
    return df.join(F.broadcast(ranked), order).drop(order)


#: The seasons' names in words, by code.
DISPLAY = {"DJF": "Dec-Jan-Feb", "MAM": "Mar-Apr-May", "JJA": "Jun-Jul-Aug", "SON": "Sep-Oct-Nov"}


def season_display(code: Column) -> Column:
    """The name of a season code, with its year tag as it is; a code that is unknown stays."""
    names = F.create_map(*(F.lit(x) for pair in DISPLAY.items() for x in pair))
    return F.coalesce(F.concat(names[F.substring(code, 1, 3)], F.substring(code, 4, 20)), code)


def season_code(display: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for k, v in DISPLAY.items() for x in (v, k)))
    return F.coalesce(F.concat(codes[F.substring(display, 1, 11)], F.substring(display, 12, 20)), display)
