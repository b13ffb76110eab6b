"""Chunks of long work that may be stopped.

``fill`` makes a chunk one or more partitions of the result table. The write is staged, and a partition is replaced as a whole when the job
commits (dynamic partition overwrite), so the table itself says what is done: there is no mark that can be lost between the work and its
record. A run that is killed at any place leaves each partition as it was or as it will be, and the next run does the rest.

``resume`` keeps a record of its own, for work that is no table. There a chunk may run twice, so its work must be safe to repeat.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chunk string, rows long, finished timestamp"
log = logging.getLogger(__name__)


def result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions ``by`` that ``df`` has rows of, each as a whole, and leave the others. Rows are dealt out by partition, and Spark
    splits those that are large and joins those that are small, so files have a good size however uneven the partitions are."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def left(spark: SparkSession, path: str, schema: str, chunks: DataFrame, by: list[str]) -> DataFrame:
    """The chunks that the table lacks. With a column ``rows`` also those of which it has another number of rows, so input that has grown
    since is done again. chunks: ``by[, rows]``, each once; NULL is a value like others."""
    there = result(spark, path, schema).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("_rows"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    if "rows" in chunks.columns:
        same = same & (F.col("rows") == F.col("_rows"))
    return chunks.join(there, same, "left_anti")


def fill(spark: SparkSession, path: str, schema: str, chunks: DataFrame, by: list[str], work: Callable[[DataFrame], DataFrame], at_once: int = 0, most: int = 0, go_on: bool = False) -> int:
    """Publish ``work(some chunks)`` for all chunks that are left, ``at_once`` at a time (0: all), and give how many were done. ``work`` takes
    rows ``by`` and gives the rows of just those partitions. most: stop after so many groups (0: none). A chunk that gives no rows is
    tried again by each run. With ``go_on`` a group that fails is logged, and others follow. The list of chunks is the plan of the work, and
    short: it comes to the driver."""
    todo = sorted(left(spark, path, schema, chunks, by).select(*by).collect(), key=lambda r: [(x is not None, x) for x in r])
    size = at_once or max(1, len(todo))
    groups = [todo[i : i + size] for i in range(0, len(todo), size)]
    count = 0
    for group in groups[: most or len(groups)]:
        try:
            publish(work(spark.createDataFrame(group, chunks.select(*by).schema)), path, by)
        except Exception as failed:
            if not go_on:
                raise
            log.warning("%s failed: %s", [tuple(r) for r in group], str(failed).split("\n")[0])
            continue
        count += len(group)
        log.info("published %d of %d chunks in %s", count, len(todo), path)
    return count


def until_filled(spark: SparkSession, path: str, schema: str, chunks: DataFrame, by: list[str], work: Callable[[DataFrame], DataFrame], at_once: int = 1, rounds: int = 3, wait_s: float = 0) -> DataFrame:
    """``fill`` again and again, each round with the chunks that still lack, until none does or ``rounds`` are over. Gives what is left."""
    rest = chunks
    for k in range(rounds):
        fill(spark, path, schema, chunks, by, work, at_once, go_on=True)
        rest = left(spark, path, schema, chunks, by)
        if rest.isEmpty():
            break
        log.warning("round %d leaves %d chunks of %s", k + 1, rest.count(), path)
        time.sleep(wait_s if k < rounds - 1 else 0)
    return rest


def done(spark: SparkSession, path: str) -> DataFrame:
    """``chunk, rows, finished`` of what is done; none where nothing is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def pending(spark: SparkSession, path: str, chunks: Iterable[str]) -> list[str]:
    """The chunks that are left, in their order, each once."""
    finished = {r.chunk for r in done(spark, path).select("chunk").distinct().collect()}
    return [c for c in dict.fromkeys(chunks) if c not in finished]


def resume(spark: SparkSession, path: str, chunks: Iterable[str], work: Callable[[str], int]) -> int:
    """Run ``work`` on each chunk that is left; a chunk is marked once its work has returned its number of rows. Gives how many were run."""
    left = pending(spark, path, chunks)
    for c in left:
        n = work(c)
        spark.range(1).select(F.lit(c).alias("chunk"), F.lit(n).cast("long").alias("rows"), F.current_timestamp().alias("finished")).coalesce(1).write.mode("append").json(path)
    return len(left)
