"""Exact dedup by a tree-merge of sorted digest runs.

Two texts are equal if they are identical once each run of spaces and control blanks is one space; their SHA-256 then is the same.

1. Each scan task sorts its digests into runs. A digest occurs once in a run, with the least identifier so far and its number of rows.
2. There are 2^b partitions, and each owns the digests that begin with its b bits. In round r every partition exchanges with those that differ
   from it in the r-th group of ``FAN_BITS`` bits only: a row goes to the partner that has the owner's bits there. Each partition merges the
   runs it gets into one, and equal digests become one row again. After all rounds a row is with its owner.
3. So a digest that a third of all rows have is one row a run at every level, and at most ``2^FAN_BITS`` rows meet (more in the first round,
   where several runs share a partition). No partition ever holds more than its share of the distinct digests, about ``RUN_ROWS``.
4. The groups of two or more go back to the rows by digest. Those of more than ``LEAST_HOT`` rows and more than one row in ``MOST_HOT`` of all
   are at most ``MOST_HOT`` groups, and are broadcast; the others are joined by a shuffle.

Runs are ordered by the first eight bytes of the digest. Rows that agree there are verified by the whole digest, and put in its order where
they differ.

Defined results: null texts are empty ones; ids of null come last, and keep their group only where all its ids are null; of rows that have
one id and equal texts exactly one stays; an empty table gives an empty one. Ids may be of any type that has an order. Only the id
and the text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, trimmed, written

FAN_BITS = 4
#: Rows of a run, some 60 MB, and twice that while it is merged.
RUN_ROWS = 1_000_000
#: Partitions are 2^20 at most; beyond that they hold more rows each.
MOST_BITS = 20
LEAST_HOT, MOST_HOT = 64, 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of four unsigned integers, whose order is that of the bytes."""
    whole = column.combine_chunks()
    whole = whole.cast(pa.binary(32)) if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks).cast(pa.binary(32))
    raw = np.frombuffer(whole.buffers()[1], np.uint8)[whole.offset * 32 : (whole.offset + len(whole)) * 32]
    return raw.view(">u8").reshape(-1, 4)


def merge(runs: list[pa.Table], order_bits: int = 64) -> pa.Table:
    """One run of several: each digest once, with its least ``id, row`` and the sum of ``n``. The stable sort takes each run as it stands and
    merges them. order_bits: so many bits of a digest order the runs (fewer in tests)."""
    whole = pa.concat_tables(runs).combine_chunks()
    if not whole.num_rows:
        return whole
    words = _words(whole["digest"])
    key = words[:, 0].astype(np.uint64) >> np.uint64(64 - order_bits)
    order = np.argsort(key, kind="stable")
    ordered = words[order]
    changes = (ordered[1:] != ordered[:-1]).any(axis=1)
    if (changes & (key[order][1:] == key[order][:-1])).any():  # digests that only begin alike
        order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
        ordered = words[order]
        changes = (ordered[1:] != ordered[:-1]).any(axis=1)
    first = np.concatenate([[True], changes])
    starts, group = np.flatnonzero(first), np.cumsum(first) - 1
    sizes = np.diff(np.append(starts, len(order)))
    pick, many = order[starts], sizes > 1
    if many.any():
        members = np.flatnonzero(np.repeat(many, sizes))
        t = pa.table({"group": group[members], "id": whole["id"].take(pa.array(order[members])), "row": whole["row"].take(pa.array(order[members]))})
        by = pc.sort_indices(t, sort_keys=[("group", "ascending"), ("id", "ascending"), ("row", "ascending")]).to_numpy()  # nulls last
        g = group[members][by]
        pick[many] = order[members][by[np.concatenate([[True], g[1:] != g[:-1]])]]
    out = whole.take(pa.array(pick))
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(whole["n"].to_numpy()[order], starts)))


def _one_run(batches: Iterable[pa.RecordBatch], order_bits: int) -> Iterator[pa.RecordBatch]:
    """What a task gets becomes one run. It is merged each time it has grown by ``RUN_ROWS``, so copies never pile up."""
    held: list[pa.Table] = []
    fresh = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        fresh += batch.num_rows
        if fresh >= RUN_ROWS:
            held, fresh = [merge(held, order_bits)], 0
    if held:
        yield from merge(held, order_bits).to_batches(max_chunksize=10_000)


def _sorted_runs(batches: Iterable[pa.RecordBatch], order_bits: int) -> Iterator[pa.RecordBatch]:
    """Runs of about ``RUN_ROWS`` rows, so that a task of very many short texts holds no more than that."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ROWS:
            yield from _one_run(held, order_bits)
            held = []
    yield from _one_run(held, order_bits)


def tree_merge(rows: DataFrame, bits: int, fan_bits: int = FAN_BITS, order_bits: int = 64) -> DataFrame:
    """``at, digest, id, row, n``: each digest once. rows: ``digest, id, row``."""
    first = rows.select((F.spark_partition_id() % (1 << bits)).alias("at"), "digest", "id", "row", F.lit(1).cast("long").alias("n"))
    runs = first.mapInArrow(trimmed(lambda batches: _sorted_runs(batches, order_bits)), first.schema)
    owner = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits).cast("int")
    for done in range(0, max(bits, 1), fan_bits):
        mask = ((1 << min(fan_bits, bits - done)) - 1) << done
        partner = F.col("at").bitwiseAND(F.lit(~mask)).bitwiseOR(owner.bitwiseAND(F.lit(mask)))
        sent = runs.withColumn("at", partner).repartitionById(1 << bits, "at")
        runs = sent.mapInArrow(trimmed(lambda batches: _one_run(batches, order_bits)), first.schema)
    return runs


def partition_bits(rows: int, partitions: int) -> int:
    """So many bits that a partition owns ``RUN_ROWS`` rows or fewer, and all cores have one."""
    return min(MOST_BITS, max(1, (max(-(-rows // RUN_ROWS), partitions) - 1).bit_length()))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = FAN_BITS, order_bits: int = 64) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` of every row."""
    spark = df.sparkSession
    rows = written(df.select(df[id_col].alias("id"), digest(df[text_col]).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.count()
    bits = partition_bits(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = written(tree_merge(rows, bits, fan_bits, order_bits).filter("n > 1").select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")), "digest-groups")
    at = F.lit(max(LEAST_HOT, total // MOST_HOT))
    hot, others = F.broadcast(merged.filter(F.col("group_size") > at)), merged.filter(F.col("group_size") <= at)
    large = rows.join(hot, "digest")
    small = rows.join(hot.select("digest"), "digest", "left_anti").join(others, "digest", "left")
    alone = F.col("group_size").isNull()
    return large.unionByName(small).select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    )


def unique(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: those whose text has no copy, and the first of each group. The texts meet their
    groups by digest, a shuffle, unless Spark finds the groups few enough to broadcast."""
    found = written(classes(df, id_col, text_col), "digest-classes").filter("group_size > 1")
    key, least = free_name(df, "digest"), free_name(df, "least_id")
    marked = df.withColumn(key, digest(df[text_col]))
    first = found.filter("kept").select(F.col("digest").alias(key), F.col("id").alias(least))
    alone = marked.join(first, key, "left_anti")
    rows = marked.join(first, key).filter(F.col(f"`{id_col}`").eqNullSafe(F.col(least))).dropDuplicates([key])
    return alone.select(*(f"`{c}`" for c in df.columns)).unionByName(rows.select(*(f"`{c}`" for c in df.columns)))
