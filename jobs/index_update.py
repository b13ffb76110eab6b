"""Seasonal index update: new observation files extend and correct the index series of all regions.

    python -m jobs.index_update --tables DIR --target DIR --checkpoint DIR --config jobs/index_update.json

Reads ``orders`` as a stream of files (observations: time, value; the customer's nation is the cell) and ``customer``, ``nation`` and ``region``
as tables. Only files that the checkpoint does not know are read. Writes ``<target>/index``, partitioned by year:

    season, name, value, anom, cells, year

with a region's area-weighted mean of the seasonal means of its cells, and its anomaly from the mean of the same season in the base period
(``base``: the first and the last season stamp; NULL where that has none). ``cells`` is the number of cells in the mean.

1. A batch becomes sums and counts by month and cell in ``<checkpoint>/sums``, partitioned by the year of the season and by batch. They are few
   rows, however many observations there are, and old files are never read again.
2. The years that a batch touches are recomputed from their own sums, which the scan is pruned to, and replaced in the index. A season's
   months are all in its year.
3. The means of the base period are kept in ``<checkpoint>/normals``. Only a batch that reaches into the base period computes them anew, from
   the base's years; then every anomaly changes, and all years are replaced.

A batch that is repeated after a crash has the same number and the same files, and replaces what it wrote before, so a rerun gives the same
result. Null times, values and cells without a region take no part. The checkpoint belongs to one target: use a new one for a new target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid, season
from gridloom.sources import progress, scan
from jobs.common import command, log

SUMS = "month timestamp_ntz, cell long, total double, n long, year int, batch long"
NORMALS = "name string, month int, normal double"
INDEX = "season date, name string, value double, anom double, cells long, year int"


def new_files(spark: SparkSession, path: str, files: int) -> DataFrame:
    """A stream of the files at ``path``, a folder or a single file. The last letter as a class makes it a pattern, which may be either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def sums(observations: DataFrame, customers: DataFrame, batch: int) -> DataFrame:
    """A batch by month and cell. The date's sums are taken by customer first, so that a join moves no single observations."""
    known = observations.filter("o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL")
    each = known.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("total"), F.count("*").alias("n"))
    cells = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("cell"))
    stamp = F.year(season.stamp(F.col("month")))
    return each.join(cells, "o_custkey").groupBy("month", "cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select("month", "cell", "total", "n", stamp.alias("year"), F.lit(batch).cast("long").alias("batch"))


def means(sums: DataFrame, places: DataFrame) -> DataFrame:
    """``season, name, value, cells``: the regions' area-weighted means. places: ``cell, name, lat``."""
    months = sums.groupBy(F.col("month").alias("time"), "cell").agg((F.sum("total") / F.sum("n")).alias("value"))
    cells = season.seasonal(months, ["cell"]).join(places, "cell")
    return grid.area_mean(cells, ["season", "name"]).join(cells.groupBy("season", "name").agg(F.count("value").alias("cells")), ["season", "name"])


def regions(spark: SparkSession, tables: str) -> DataFrame:
    nation = scan.table(spark, tables, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), F.col("n_regionkey").alias("r_regionkey"))
    return nation.join(scan.table(spark, tables, "region"), "r_regionkey").select("cell", F.trim("r_name").alias("name"), (F.lit(-60.0) + F.col("cell") * 5).alias("lat"))


def update(spark: SparkSession, tables: str, target: str, checkpoint: str, base: tuple[str, str], batch: DataFrame, number: int) -> None:
    """Take one batch into the sums, the normals where it must be, and the index."""
    progress.publish(sums(batch, scan.table(spark, tables, "customer"), number), f"{checkpoint}/sums", ["year", "batch"])
    everything, places = progress.result(spark, f"{checkpoint}/sums", SUMS), regions(spark, tables)
    fresh = everything.filter(F.col("batch") == number)
    first, last = (F.lit(b).cast("date") for b in base)
    read, months, in_base, years = fresh.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(season.stamp(F.col("month")).between(first, last)), F.sort_array(F.collect_set("year"))).first()
    if in_base:
        of_base = everything.filter(F.col("year").between(F.year(first), F.year(last)))
        normals = means(of_base, places).filter(F.col("season").between(first, last)).groupBy("name", F.month("season").alias("month")).agg(F.avg("value").alias("normal"))
        normals.write.mode("overwrite").parquet(f"{checkpoint}/normals")
    else:
        everything = everything.filter(F.col("year").isin(years))
    normals = progress.result(spark, f"{checkpoint}/normals", NORMALS).withColumnRenamed("month", "_month")
    own = means(everything, places).withColumn("_month", F.month("season")).join(normals, ["name", "_month"], "left")
    rows = own.select("season", "name", "value", (F.col("value") - F.col("normal")).alias("anom"), "cells", F.year("season").alias("year"))
    progress.publish(rows, f"{target}/index", ["year"])
    log.info("batch %d: %d observations read as %d monthly sums of %d years, %s years of %s/index replaced", number, read, months, len(years), "all" if in_base else "their", target)


def run(spark: SparkSession, tables: str, target: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new into the index, and give the whole index, read back."""
    base = tuple(config["base"])
    stream = new_files(spark, f"{tables}/orders.parquet", config.get("files_per_batch", 64))
    step = lambda batch, number: update(batch.sparkSession, tables, target, checkpoint, base, batch, number)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches of new files in %s/orders.parquet", sum(p["numInputRows"] > 0 for p in query.recentProgress), tables)
    out = progress.result(spark, f"{target}/index", INDEX)
    log.info("%s/index has %d rows", target, out.count())
    return out


if __name__ == "__main__":
    command("Extend the seasonal indices by new observation files.", run, {"tables": "folder of the given tables", "target": "folder of the index", "checkpoint": "folder of the stream's state"})
