"""A Spark data source for a tree of raw files, ``<root>/variable=<name>/year=<year>/<files>``, one task for each variable and year.

    read(spark, root).filter("variable = 'sst' AND year >= 1990")

Filters on ``variable`` and ``year`` are decided when the partitions are planned, so files that they rule out are never opened. That is so where
the session has ``spark.sql.python.filterPushdown.enabled``, as ``gridloom.session`` sets it; in others all files are read, and Spark
filters. A task that fails reads its files again if the error is of a kind that passes, after the time that
the kind asks for; what still fails goes to Spark, which tries the task elsewhere. Files are Parquet, or CSV with a header. The root may be any that
Arrow's file systems reach.

Options: ``attempts`` (3) of a task, ``wait`` (1.0), by which the waiting times are multiplied, ``pushdown``, which ``read`` sets.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.sources.scan import error_kind

log = logging.getLogger(__name__)
PARTS = {"variable": str, "year": int}
#: Filters on parts of the path that are decided exactly.
DECIDED: dict[type, Callable[[object, Filter], bool]] = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    IsNotNull: lambda v, f: True,
}


@dataclass
class Chunk(InputPartition):
    variable: str
    year: int
    files: list[str] = field(default_factory=list)


def with_retry(work: Callable[[], pa.Table], attempts: int, wait: float) -> pa.Table:
    """The result of ``work``, tried again while its errors pass. The last one, and any that does not pass, is raised."""
    for k in range(1, attempts + 1):
        try:
            return work()
        except Exception as failed:
            kind, again, seconds = error_kind(str(failed))
            if not again or k == attempts:
                raise
            log.warning("attempt %d failed (%s), again in %g s: %s", k, kind, seconds * wait, failed)
            time.sleep(seconds * wait)
    raise ValueError("attempts must be 1 or more")


class RawTreeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.filters: list[Filter] = []
        self.root = options["path"]

    def chunks(self) -> list[Chunk]:
        system, root = FileSystem.from_uri(self.root)
        found: dict[tuple, Chunk] = {}
        for info in system.get_file_info(FileSelector(root, recursive=True)):
            below = info.path[len(root) :].strip("/").split("/")
            if info.is_file and len(below) == len(PARTS) + 1 and not any(x[0] in "._" for x in below):
                values = [kind(x.partition("=")[2]) for kind, x in zip(PARTS.values(), below)]
                found.setdefault(tuple(values), Chunk(*values)).files.append(info.path)
        return [found[k] for k in sorted(found)]

    def partitions(self) -> list[Chunk]:
        keep = lambda c: all(DECIDED[type(f)](getattr(c, f.attribute[0]), f) for f in self.filters)
        chosen = [c for c in self.chunks() if keep(c)]
        log.info("%d chunks of %s are read", len(chosen), self.root)
        return chosen or [Chunk("", 0)]  # Spark needs one, which has no files

    def load(self, path: str) -> pa.Table:
        system, _ = FileSystem.from_uri(self.root)
        with system.open_input_file(path) as file:
            return pyarrow.csv.read_csv(file) if path.endswith(".csv") else pyarrow.parquet.read_table(file)

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        for path in partition.files:
            table = with_retry(lambda p=path: self.load(p), int(self.options.get("attempts", 3)), float(self.options.get("wait", 1.0)))
            own = {p: pa.array([getattr(partition, p)] * table.num_rows) for p in PARTS}
            columns = [own.get(f.name, table[f.name] if f.name in table.column_names else pa.nulls(table.num_rows)).cast(f.type) for f in kinds]
            yield from pa.Table.from_arrays(columns, schema=kinds).to_batches(max_chunksize=10_000)


class PruningReader(RawTreeReader):
    """A reader that takes filters; Spark refuses one where the session does not push them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in DECIDED and f.attribute in {(p,) for p in PARTS}:
                self.filters.append(f)
            else:
                yield f


class RawTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_tree"

    def schema(self) -> str:
        return "variable string, year int, time timestamp_ntz, lat double, lon double, value double"

    def reader(self, schema: StructType) -> RawTreeReader:
        return (PruningReader if self.options.get("pushdown") == "true" else RawTreeReader)(schema, dict(self.options))


def read(spark: SparkSession, root: str, schema: str | None = None, source: type[DataSource] = RawTree, **options: str) -> DataFrame:
    """The tree at ``root`` as a table, by this source or one made from it."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options)
    return (reader.schema(schema) if schema else reader).load(root)
