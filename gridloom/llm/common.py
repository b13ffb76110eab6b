"""Helpers shared by the training-data operators: table access, batch slicing, durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python, unless the session says otherwise: texts are long, and an executor holds several batches.
BATCH_SETTING, USUAL_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Sets the session's batch size for long texts, where it is the usual one."""
    if spark.conf.get(BATCH_SETTING, USUAL_ROWS) == USUAL_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, under fixed names, with null texts as empty ones.

    Every other column is left behind, so extra or clashing names in the input cannot reach an operator.
    """
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows that hold about ``most_bytes`` of ``column``, one row at least."""
    sizes = batch.column(column)
    start = held = 0
    for i in range(batch.num_rows):
        value = sizes[i]
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, most_bytes)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the next like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Spark's setting to remove the shuffle files of a job when it ends, as its result is a table then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where a local master leaves that unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/gridloom-checkpoints"
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that is free in this worker back to the system, as workers are reused for other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end the worker gives back what it no longer needs: idle workers of one stage stand beside the next."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole
