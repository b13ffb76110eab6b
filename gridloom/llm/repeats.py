"""Repeated substrings: remove every byte that a string of 400 bytes covers which also starts anywhere else.

Suffixes are never sorted. The places where a string of ``LENGTH`` bytes may start form intervals, each with the strings that
bound it, and intervals are refined until they are decided, as an interleave of suffixes is refined by the next symbols:

1. A start belongs to the anchor with the least hash among the ``SPAN`` places from it on. What a start belongs to depends on its own
   string alone, so equal strings have equal anchors. Neighbouring starts with one anchor form an interval.
2. All strings of an interval share the bytes from the anchor to the earliest end that its starts can have. If that core occurs
   nowhere else, none of the strings does: the interval is out. That is decided for all intervals by their cores' hashes.
3. If the whole stretch of an interval (first byte of the first string to last byte of the last) occurs as another interval's
   stretch too, all its strings are repeated: the interval is in.
4. The few intervals left, at the edges of repeated passages, are split into single starts, and so is one interval of
   each kind that is in and has the same core. Their strings decide.

Hashes have 64 bits. Counts are pre-aggregated before each shuffle, and joins back can be split, so a passage that very many
documents share is no hot group. A document's intervals are bounded by its own length.

Defined results: null and empty texts, and texts of less than ``LENGTH`` bytes, lose nothing; a row that occurs twice repeats
itself; matches never cross rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import sliced, texts, trimmed, written

LENGTH, SPAN, GRAM = 400, 128, 16
BATCH_BYTES = 2_000_000
BROADCAST_ROWS = 2_000_000
#: What is known of an interval: its strings are repeated; its starts have to be looked at; both.
IN, OPEN, BOTH = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place."""
    n = len(raw) - GRAM + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
    h = (words[:n] * _ODD[0]) ^ (words[8 : 8 + n] * _ODD[1])
    h ^= h >> np.uint64(29)
    h *= _ODD[0]
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def intervals(raw: np.ndarray, length: int, span: int) -> list[tuple[int, int, int]]:
    """``(first, end, anchor)`` of each interval of starts, in order."""
    n = len(raw) - length + 1
    if n <= 0:
        return []
    h = gram_hashes(raw)[: n + span - 1]
    least = sliding_min(h, span)
    out = []
    cuts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), n]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        i = first
        for p in (np.flatnonzero(h[first : end - 1 + span] == least[first]) + first).tolist():
            if i >= end:
                break
            if p >= i:
                stop = min(end, p + 1)
                out.append((i, stop, p))
                i = stop
    return out


def row_key(id_col: str = "doc_id") -> Column:
    return F.xxhash64(F.lit(LENGTH), F.col(id_col), F.col("text"))


def marked(df: DataFrame, length: int, span: int) -> DataFrame:
    """``rid, cores, stretches``: the hashes of each row's intervals, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        kind = pa.list_(pa.int64())
        for part in sliced(batches, "text", BATCH_BYTES):
            cores, stretches = [], []
            for text in part.column("text").to_pylist():
                b = text.encode()
                found = intervals(np.frombuffer(b, np.uint8), length, span)
                cores.append(np.array([digest(b[a : a - span + 1 + length]) for _, _, a in found], np.uint64).view(np.int64))
                stretches.append(np.array([digest(b[i : e - 1 + length]) for i, e, _ in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(cores, kind), pa.array(stretches, kind)], ["rid", "cores", "stretches"])

    return df.filter(F.octet_length("text") >= length).mapInArrow(trimmed(run), "rid long, cores array<long>, stretches array<long>")


def twice(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)


def verdicts(rows: DataFrame, length: int, span: int) -> DataFrame:
    """``rid, marks``: for each row with an interval whose core is repeated, what is known of those intervals."""
    hashes = written(marked(rows, length, span), "repeats-marks")
    every = hashes.select("rid", F.posexplode(F.arrays_zip("cores", "stretches")).alias("k", "x")).select("rid", "k", F.col("x.cores").alias("core"), F.col("x.stretches").alias("stretch"))
    alive = written(every.join(twice(every, "core"), "core"), "repeats-alive")
    known = written(alive.join(twice(alive, "stretch").withColumn("sure", F.lit(True)), "stretch", "left").select("rid", "k", "core", "stretch", F.col("sure").isNotNull().alias("sure")), "repeats-known")
    open_cores = known.filter("not sure").select("core").distinct()
    chosen = known.filter("sure").join(open_cores, "core", "left_semi").groupBy("stretch").agg(F.min(F.struct("rid", "k")).alias("x")).select("x.rid", "x.k", F.lit(BOTH).alias("mark"))
    all_marks = known.select("rid", "k", F.when(F.col("sure"), IN).otherwise(OPEN).alias("mark")).union(chosen)
    return all_marks.groupBy("rid", "k").agg(F.max("mark").alias("mark")).groupBy("rid").agg(F.collect_list(F.struct("k", "mark")).alias("marks"))


def string_hashes(affected: DataFrame, length: int, span: int) -> DataFrame:
    """``rid, start, string``: the hash of each string of the intervals that have to be looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part in sliced(batches, "text", BATCH_BYTES):
            for rid, text, marks in zip(*(part.column(c).to_pylist() for c in ("rid", "text", "marks")), strict=True):
                b = text.encode()
                found = intervals(np.frombuffer(b, np.uint8), length, span)
                starts = [i for m in marks if m["mark"] != IN for i in range(*found[m["k"]][:2])]
                own = np.array([digest(b[i : i + length]) for i in starts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rid, np.int64)), pa.array(starts, pa.int32()), pa.array(own)], ["rid", "start", "string"])

    return affected.filter(F.exists("marks", lambda m: m.mark != IN)).select("rid", "text", "marks").mapInArrow(trimmed(run), "rid long, start int, string long")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """``rid, doc_id, spans, kept`` of each row that loses bytes: the maximal removed runs ``[from, to)`` and the remaining bytes.

    ``rid`` is ``row_key()`` of the row's ``texts()``; rows that lose nothing do not occur."""
    rows = texts(df, id_col, text_col).withColumn("rid", row_key())
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = written(verdicts(rows, length, span), "repeats-verdicts")
    few = marks.count() <= BROADCAST_ROWS
    held = rows.join(F.broadcast(marks.select("rid")), "rid", "left_semi") if few else rows
    affected = written(held.join(marks, "rid"), "repeats-affected")
    strings = written(string_hashes(affected, length, span), "repeats-strings")
    starts = strings.join(twice(strings, "string"), "string").groupBy("rid").agg(F.collect_set("start").alias("starts"))
    span_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            spans, kept = [], []
            for text, known, single in zip(*(part.column(c).to_pylist() for c in ("text", "marks", "starts")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                found = intervals(raw, length, span)
                change = np.zeros(len(raw) + 1, np.int32)
                for m in known:
                    if m["mark"] != OPEN:
                        i, e, _ = found[m["k"]]
                        change[i] += 1
                        change[e - 1 + length] -= 1
                for i in single or ():
                    change[i] += 1
                    change[i + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans.append([{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(spans, span_type), pa.array(kept, pa.binary())], ["rid", "doc_id", "spans", "kept"])

    done = affected.join(starts, "rid", "left").select("rid", "doc_id", "text", "marks", "starts")
    return done.mapInArrow(trimmed(run), f"rid long, doc_id {kind}, spans array<struct<from:int,to:int>>, kept binary").filter(F.size("spans") > 0)
