"""Sources and sinks: planned partitions and retries, clustered files, cubes, table functions, errors that tell what is wrong."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import cells, composite, grid
from gridloom.sources import progress, raw_tree, scan
from tests.flaky import Flaky

SCHEMA = "variable string, year int, time long, value double"


@pytest.fixture
def tree(spark, tmp_path):
    spark.range(60).select(F.col("id").alias("time"), (F.col("id") / 2).alias("value"), F.concat(F.lit("v"), F.col("id") % 3).alias("variable"), (2000 + F.col("id") % 4).alias("year")).coalesce(1).write.partitionBy("variable", "year").parquet(f"file://{tmp_path}/raw")
    os.makedirs(f"{tmp_path}/raw/variable=text/year=1990")
    with open(f"{tmp_path}/raw/variable=text/year=1990/a.csv", "w") as f:
        f.write("time,other\n7,x\n8,y\n")
    os.makedirs(f"{tmp_path}/marks")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tree_is_read_by_planned_partitions(spark, tree):
    df = raw_tree.read(spark, f"file://{tree}/raw", SCHEMA)
    assert df.rdd.getNumPartitions() == 13 and df.count() == 62
    assert sorted(tuple(r) for r in df.filter("variable = 'text'").collect()) == [("text", 1990, 7, None), ("text", 1990, 8, None)]
    some = df.filter("variable IN ('v0', 'v2') AND year >= 2001 AND year < 2003 AND value > 3")
    assert some.rdd.getNumPartitions() == 4
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "value" in plan and "Filter" in plan  # what the source does not decide stays with Spark
    want = sorted((f"v{i % 3}", 2000 + i % 4, i, i / 2) for i in range(60) if i % 3 != 1 and i % 4 in (1, 2) and i / 2 > 3)
    assert sorted(tuple(r) for r in some.collect()) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert sorted(tuple(r) for r in raw_tree.read(spark, f"file://{tree}/raw", SCHEMA).filter("variable IN ('v0', 'v2') AND year >= 2001 AND year < 2003 AND value > 3").collect()) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert df.filter("year = 1850").count() == 0 and df.filter("year IS NULL").count() == 0


def test_passing_faults_are_tried_again(spark, tree):
    read = lambda **o: raw_tree.read(spark, f"file://{tree}/raw", SCHEMA, Flaky, marks=f"{tree}/marks", wait="0", **o).filter("variable = 'v1'")
    assert read(faults="2", message="connection reset by peer").count() == 20
    assert len(os.listdir(f"{tree}/marks")) == 4 * 3
    with pytest.raises(Exception, match="503"):
        read(faults="99", message="HTTP 503").count()
    for f in os.listdir(f"{tree}/marks"):
        os.remove(f"{tree}/marks/{f}")
    with pytest.raises(Exception, match="403"):
        read(faults="1", message="403 forbidden").count()  # does not pass: not tried again
    assert all(f.endswith(".0") for f in os.listdir(f"{tree}/marks"))


def test_messages_are_of_one_kind_in_both_forms(spark):
    said = ["Timeout!", "HTTP 429", "error 503", "network down", "403 no", "bad request", "No space left", "what", ""]
    rows = spark.createDataFrame([(m,) for m in said], "m string").select("m", scan.error_class(F.col("m")).alias("e")).collect()
    assert {r.m: tuple(r.e) for r in rows} == {m: scan.error_kind(m) for m in said}


def test_rounds_until_all_years_are_there(spark, tmp_path):
    years = spark.createDataFrame([(y,) for y in range(2000, 2006)], "year int")
    failed = []

    def work(some):
        year = some.first().year
        if year % 2 and failed.count(year) < (1 if year < 2005 else 9):
            failed.append(year)
            raise ConnectionError("connection lost")
        return some.select(F.lit(1.0).alias("value"), "year")

    rest = progress.until_filled(spark, f"file://{tmp_path}/t", "value double, year int", years, ["year"], work)
    assert [r.year for r in rest.collect()] == [2005] and failed.count(2001) == 1 and failed.count(2005) == 3
    assert progress.until_filled(spark, f"file://{tmp_path}/t", "value double, year int", years.filter("year < 2005"), ["year"], work).count() == 0


def touched(path, box):
    """Row groups that statistics do not rule out, of all."""
    hit = total = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            hit += all(stats[c].max >= a and stats[c].min <= b for c, (a, b) in box.items())
    return hit, total


def test_box_scans_read_fewer_row_groups(spark, tmp_path):
    field = spark.range(40 * 30 * 30).select((F.col("id") % 40).cast("int").alias("level"), (F.floor(F.col("id") / 40) % 30 * 2.0).alias("lat"), (F.floor(F.col("id") / 1200) * 3.0).alias("lon"), F.rand(1).alias("value"))
    clustered, plain = f"file://{tmp_path}/c", f"file://{tmp_path}/p"
    scan.write_clustered(field, clustered, ["level", "lat", "lon"], files=64)
    field.repartitionByRange(64, "level", "lat", "lon").sortWithinPartitions("level", "lat", "lon").write.parquet(plain)
    box = {"lat": (10.0, 18.0), "lon": (20.0, 40.0)}
    (few, n), (many, m) = touched(clustered[7:], box), touched(plain[7:], box)
    assert n >= 60 and m >= 60 and few < n / 3 and few < many / 2
    inside = lambda p: sorted(map(tuple, spark.read.parquet(p).filter("lat between 10 and 18 and lon between 20 and 40").collect()))
    assert inside(clustered) == inside(plain) and len(inside(plain)) == 5 * 7 * 40
    odd = spark.createDataFrame([(None, 1.0), (2.0, 1.0), (float(3), 1.0)], "lat double, lon double")
    scan.write_clustered(odd, f"file://{tmp_path}/odd", ["lat", "lon"])
    scan.write_clustered(odd.limit(0), f"file://{tmp_path}/none", ["lat", "lon"])
    assert spark.read.parquet(f"file://{tmp_path}/odd").count() == 3 and spark.read.parquet(f"file://{tmp_path}/none").count() == 0


CUBE = "cell int, value double, t double, df double, case string, season_lag string"


def test_partial_runs_make_one_cube(spark, tmp_path):
    rng = np.random.default_rng(2)
    value = {(y, c, s): float(rng.normal()) for y in range(1990, 2010) for c in range(3) for s in ("DJF_0", "MAM_0", "JJA_0")}
    field = spark.createDataFrame([(*k, v) for k, v in value.items()], "year int, cell int, season_lag string, value double")
    events = spark.createDataFrame([(y, "high") for y in (1991, 1995, 2002)] + [(y, "low") for y in (1993, 2008)], "year int, kind string")
    path = f"file://{tmp_path}/cube"
    put = lambda *lags: composite.write_cube(composite.slices(field.filter(F.col("season_lag").isin(*lags)), events, ["cell"]), path)
    put("DJF_0", "MAM_0")
    first = {(r.case, r.season_lag): r.checksum for r in composite.manifest(spark, path, CUBE).collect()}
    put("MAM_0", "JJA_0")
    now = {(r.case, r.season_lag): (r.cells, r.known, r.checksum) for r in composite.manifest(spark, path, CUBE).collect()}
    assert set(now) == {(c, s) for c in composite.CASES for s in ("DJF_0", "MAM_0", "JJA_0")} and all(v[:2] == (3, 3) for v in now.values())
    assert all(now[k][2] == v for k, v in first.items())
    rows = composite.cube(spark, path, CUBE, ["cell"], ["JJA_0", "SON_0", "DJF_0"]).collect()
    assert len(rows) == 3 * 3 * 3 == len({(r.cell, r.case, r.season_lag) for r in rows})
    got = {(r.cell, r.case, r.season_lag): (r.value, r.t, r.place) for r in rows}
    for c in range(3):
        high, low = ([value[y, c, "DJF_0"] for y in ys] for ys in ((1991, 1995, 2002), (1993, 2008)))
        assert got[c, "high", "DJF_0"] == (pytest.approx(np.mean(high)), pytest.approx(np.mean(high) / (np.std(high, ddof=1) / 3**0.5)), 2)
        assert got[c, "diff", "DJF_0"][0] == pytest.approx(np.mean(high) - np.mean(low)) and got[c, "low", "SON_0"] == (None, None, 1)


def test_regression_is_called_from_sql(spark):
    tables.register(spark)
    rng = np.random.default_rng(3)
    rows = [(c, f"k{c % 2}", float(a), float(b), None if c == 1 and i == 0 else float(a * 2 + rng.normal())) for c in range(3) for i, (a, b) in enumerate(rng.normal(size=(20, 2)))] + [(9, "few", 1.0, 1.0, 1.0), (None, "null", 1.0, 2.0, 3.0)]
    spark.createDataFrame(rows, "cell int, `the kind` string, a double, b double, y double").createOrReplaceTempView("regression_input")
    got = {(r.cell, r.predictor): r for r in spark.sql("SELECT * FROM regression(TABLE(regression_input), 'cell, the kind', 'y', 'a, b')").collect()}
    assert len(got) == 10 and got[9, "a"].coef is None and got[None, "a"].n == 1 and got[1, "a"].n == 19
    data = np.array([r[2:] for r in rows if r[0] == 2], float)
    want = cells.ols(data[:, 2:], data[:, :2])
    assert (got[2, "b"].coef, got[2, "b"].p_value, got[2, "b"].r2) == (pytest.approx(want.coef[1, 0]), pytest.approx(want.p[1, 0]), pytest.approx(want.r2[0])) and got[2, "b"]["the kind"] == "k0"
    with pytest.raises(Exception, match="no column z"):
        spark.sql("SELECT * FROM regression(TABLE(regression_input), 'cell', 'y', 'a, z')").collect()
    assert spark.sql("SELECT * FROM regression(TABLE(SELECT * FROM regression_input LIMIT 0), 'cell', 'y', 'a')").count() == 0


def test_requests_are_checked_alike_in_tables(spark):
    steps, areas = [(1, 1), (0, 1), (10, 10), (11, 1), (1,), (-1, 1)], [(90, -180, -90, 360), (91, 0, 0, 1), (0, 0, 0, 1), (10, 5, 0, 5), (10, -181, 0, 5), (-80, 0, -91, 5)]
    rows = spark.createDataFrame([(list(map(float, s)), list(map(float, a))) for s, a in zip(steps, areas)], "s array<double>, a array<double>").select("s", "a", scan.grid_ok(F.col("s")).alias("g"), scan.area_ok(F.col("a")).alias("b")).collect()
    assert all(r.g == scan.valid_grid(tuple(r.s)) and r.b == scan.valid_area(tuple(r.a)) for r in rows) and [r.g for r in rows] == [True, False, True, False, False, False]


def test_errors_say_what_there_is(spark):
    field = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0)], "lat double, lon double")
    assert grid.select_polygon(field, [(0, 0), (2, 0), (2, 2), (0, 2)]).count() == 1
    with pytest.raises(ValueError, match="No data points"):
        grid.select_polygon(field, [(10, 10), (12, 10), (12, 12)])
    boxes = spark.createDataFrame([("b", 0.0, 1.0, 2.0, 3.0), ("a", 0.0, 1.0, 2.0, 3.0)], "name string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert grid.domain(boxes, "b") == {"lat_min": 0.0, "lat_max": 1.0, "lon_min": 2.0, "lon_max": 3.0}
    with pytest.raises(KeyError, match="'c' not found. Available domains: a, b"):
        grid.domain(boxes, "c")


@pytest.mark.parametrize("good,code", [([1, 1], 0), ([0, 0], 1), ([1, 0, 1], 2)])
def test_exit_codes(spark, good, code):
    df = spark.createDataFrame([("job", g) for g in good], "name string, ok int")
    r = scan.outcomes(df, F.col("ok") == 1, ["name"]).first()
    assert (r.exit_code, r.succeeded, r.failed) == (code, sum(good), len(good) - sum(good))
