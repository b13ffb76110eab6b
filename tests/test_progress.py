"""Chunks that are partitions of their result: whatever stops a run, the next one gives the whole table, once."""

import os

import pytest
from pyspark.sql import functions as F

from gridloom.sources import progress

SCHEMA = "x long, part string"


@pytest.fixture
def rows(spark):
    return spark.range(100).select(F.col("id").alias("x"), F.when(F.col("id") % 5 < 4, F.concat(F.lit("p"), F.col("id") % 5)).alias("part"))


def chunks(rows):
    return rows.select("part").distinct()


def own(rows, some):
    return rows.join(some.select(F.col("part").alias("_p")), F.col("part").eqNullSafe(F.col("_p")), "left_semi")


def table(spark, path):
    return sorted((r.x, r.part) for r in progress.result(spark, path, SCHEMA).collect())


def whole(rows):
    return sorted((r.x, r.part) for r in rows.collect())


def test_chunks_are_found_in_the_table(spark, rows, tmp_path):
    path, seen = f"file://{tmp_path}/t", []

    def work(some):
        seen.append([r.part for r in some.collect()])
        return own(rows, some)

    assert progress.fill(spark, path, SCHEMA, chunks(rows), ["part"], work, at_once=2, most=1) == 2
    assert progress.fill(spark, path, SCHEMA, chunks(rows), ["part"], work, at_once=2) == 3
    assert seen == [[None, "p0"], ["p1", "p2"], ["p3"]] and table(spark, path) == whole(rows)
    assert progress.fill(spark, path, SCHEMA, chunks(rows), ["part"], work) == 0 and len(seen) == 3


@pytest.mark.parametrize("when", ["after the write", "in the write"])
def test_a_run_that_is_killed_doubles_and_loses_nothing(spark, rows, tmp_path, monkeypatch, when):
    path, publish, calls = f"file://{tmp_path}/t", progress.publish, []

    def killed(df, where, by):
        calls.append(where)
        if len(calls) == 3 and when == "in the write":  # some tasks write their files, one fails
            df = df.withColumn("x", F.when(F.col("x") == 96, F.raise_error(F.lit("killed"))).otherwise(F.col("x")))
        publish(df, where, by)
        if len(calls) == 3 and when == "after the write":
            raise RuntimeError("killed")

    monkeypatch.setattr(progress, "publish", killed)
    with pytest.raises(Exception, match="killed"):
        progress.fill(spark, path, SCHEMA, chunks(rows), ["part"], lambda some: own(rows, some), at_once=1)
    part = table(spark, path)
    assert set(part) < set(whole(rows)) and len(part) == (60 if when == "after the write" else 40)
    os.makedirs(f"{tmp_path}/t/.spark-staging-left/part=p3")  # as a killed driver leaves them
    with open(f"{tmp_path}/t/.spark-staging-left/part=p3/part-0.parquet", "wb") as f:
        f.write(b"half a file")
    assert progress.fill(spark, path, SCHEMA, chunks(rows), ["part"], lambda some: own(rows, some)) == (2 if when == "after the write" else 3)
    assert table(spark, path) == whole(rows)


def test_input_that_has_grown_is_done_again(spark, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    counted = lambda df: df.groupBy("part").agg(F.count("*").alias("rows"))
    assert progress.fill(spark, path, SCHEMA, counted(rows), ["part"], lambda some: own(rows, some)) == 5
    more = rows.union(spark.createDataFrame([(1000, "p1"), (1001, "new"), (1002, None)], SCHEMA))
    assert progress.fill(spark, path, SCHEMA, counted(more), ["part"], lambda some: own(more, some)) == 3
    assert table(spark, path) == whole(more) and progress.left(spark, path, SCHEMA, counted(more), ["part"]).count() == 0


def test_uneven_partitions_are_dealt_out(spark, tmp_path):
    hot = spark.range(0, 4000, numPartitions=4).select(F.col("id").alias("x"), F.when(F.col("id") < 3900, "hot").otherwise("cold").alias("part"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        progress.publish(hot, f"file://{tmp_path}/t", ["part"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert table(spark, f"file://{tmp_path}/t") == whole(hot)
    assert len([f for f in os.listdir(f"{tmp_path}/t/part=hot") if f.endswith(".parquet")]) > 1
