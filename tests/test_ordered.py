"""Operations over ranges against plain versions: few ranges, many, empty ones, places that many rows share."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ordered, stats


def plain_nearest(events, series):
    points = {}
    for t, v in series:
        if t is not None:
            points[t] = min(points.get(t, v), v)
    out = []
    for i, t in events:
        near = min(points, key=lambda x: (abs(x - t), x)) if points and t is not None else None
        out.append((i, t, points.get(near)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 17])
@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "timestamp", "double"])
def test_nearest_whatever_the_gap(spark, ranges, kind):
    rng = random.Random(ranges)
    start = datetime.date(2000, 1, 1) if kind == "date" else datetime.datetime(2000, 1, 1)
    at = float if kind == "double" else lambda k: start + (datetime.timedelta(days=k) if kind == "date" else datetime.timedelta(days=k, microseconds=k % 7))
    series = [(at(k), float(rng.randrange(90))) for k in [*rng.choices(range(300), k=30), 40_000, 40_000, 40_004]] + [(None, -1.0)]
    events = [(i, at(rng.choice([rng.randrange(400), rng.randrange(60_000), 40_002, 150]))) for i in range(300)] + [(900 + i, at(7)) for i in range(200)] + [(5000, None)]
    df = spark.createDataFrame([(i, t, 3.0, "x") for i, t in events], f"id long, t {kind}, value double, _row string").repartition(5)
    got = ordered.asof_nearest(df, spark.createDataFrame(series, f"t {kind}, value double"), "t", "value", ranges)
    assert got.columns == ["id", "t", "_row", "value"]
    assert sorted(((r.id, r.t, r.value) for r in got.collect()), key=str) == plain_nearest(events, series)


def test_nearest_with_an_empty_side(spark):
    events = spark.createDataFrame([(1, 5.0), (2, None)], "id long, t double")
    series = spark.createDataFrame([(1.0, 2.0)], "t double, value double")
    assert [r.value for r in ordered.asof_nearest(events, series.limit(0), "t", "value").collect()] == [None, None]
    assert ordered.asof_nearest(events.limit(0), series, "t", "value").count() == 0
    far = ordered.asof_nearest(events, series, "t", "value").filter("id = 1").first()  # as far as a thousand buckets of the series
    assert far.value == 2.0


def plain_q(p):
    order = np.argsort(p, kind="stable")
    q = np.asarray(p)[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


@pytest.mark.parametrize("ranges", [1, 4, 23])
@pytest.mark.parametrize("families", [1, 3, 150])
def test_adjusted_values_equal_the_definition(spark, ranges, families):
    rng = np.random.default_rng(families)
    size = 1200
    family = rng.integers(families, size=size) if families < 150 else np.minimum(rng.integers(400, size=size), 149)
    p = np.round(rng.random(size) ** 3, 2 if families == 3 else 6)
    p[rng.random(size) < 0.3] = 0.004
    rows = [(i, None if f == 2 else int(f), str(f % 2), float(x)) for i, (f, x) in enumerate(zip(family, p))]
    extra = [(9001, 0, "0", None), (9002, 0, "0", float("nan"))]
    df = spark.createDataFrame(rows + extra, "i long, f int, g string, p_value double").repartition(6)
    got = {r.i: r.q_value for r in ordered.bh_fdr(df, ["f", "g"], ranges=ranges).collect()}
    want = {}
    for f in set(family):
        own = np.flatnonzero(family == f)
        want |= dict(zip(map(int, own), plain_q(p[own])))
    assert got.pop(9001) is None and got.pop(9002) is None and got == pytest.approx(want)
    window = {r.i: r.q_value for r in stats.bh_fdr(spark.createDataFrame(rows, df.schema), ["f", "g"]).collect()}
    assert got == pytest.approx(window)
    assert ordered.bh_fdr(df.limit(0), ["f", "g"]).count() == 0


def test_one_family_is_spread(spark):
    rows = ordered.in_ranges(spark.range(20_000).select((F.col("id") % 2 * F.lit(0.5)).alias("p")), ["p"], 10)  # two places only
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 2000
    edges = rows.groupBy("_range").agg(F.min("p").alias("a"), F.max("p").alias("b")).orderBy("_range").collect()
    assert all(x.b <= y.a for x, y in zip(edges, edges[1:]))


def test_ranges_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 1000)
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 9973 / 9973.0).alias("p_value"), (F.col("id") % 500).cast("double").alias("t"))
    most = lambda done: done.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    adjusted = ordered.bh_fdr(df, [])
    assert most(adjusted) < 2000
    q = {r.id: r.q_value for r in adjusted.collect()}
    assert [q[i] for i in range(20_000)] == pytest.approx(plain_q([r.p_value for r in df.orderBy("id").collect()]))
    series = spark.createDataFrame([(k * 50.0, float(k)) for k in range(10)], "t double, value double")
    near = ordered.asof_nearest(df, series, "t", "value")
    assert most(near) < 2000
    assert near.filter(F.col("value") != F.least(F.ceil((F.col("t") - 25) / 50), F.lit(9))).isEmpty() and near.count() == 20_000
