"""Filter interaction audit: what each of five filters removes, in every order of them.

A filter fails a text by itself, or fails a row because a row with a smaller id has the identical text. Rows become masks of the filters they
fail, and counts by mask answer every order.

1. Fingerprints (XXH64) are counted. A bitmap of those that occur twice or more goes to all tasks: 64 bits for each, 2^27 in all at
   most. Rows whose fingerprint is not in it are settled at once. A full bitmap lets more rows through to step 2, never fewer.
2. The others are routed by fingerprint, with their full text. A task first merges identical texts of its own, so a text leaves it once
   a buffer. The receiver keeps a chain of texts for each fingerprint, each with its least id; a row whose id is not the least is emitted as a copy.
   Fingerprints of more than ``LEAST_HOT`` rows and more than one in ``MOST_HOT`` of all go through ``SALTS`` receivers first, and
   then to one.
3. Labels join by id, without texts. Each task adds its masks up to one vector a part, and ``combineByKey`` merges the vectors.

Defined results: null texts are empty; rows with a null id are never copies and have none, and no label; rows with one id and one text are not
copies of each other; a null language is the part of the empty string; an id with several labels is good if any has quality 1, toxic if any
has toxic 1; an empty table gives no part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.llm.common import written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
CAPITALS, ODD = bytes(range(65, 91)), b"#$%&*|"
SEED = 42  # of Spark's xxhash64
#: Bytes of text that a task holds to merge what is identical.
HELD_BYTES = 32 << 20
#: A receiver's share of all texts.
ROUTED_BYTES = 256 << 20
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 64
LEAST_HOT, MOST_HOT, SALTS = 64, 100_000, 32
OUTPUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str, raw: bytes) -> int:
    """The filters that a text fails by itself. ``bytes.split`` cuts at the six blanks of ASCII."""
    words = raw.split()
    n = len(words)
    return (n < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)) << 2 | (len(raw.translate(None, ODD)) < len(raw)) << 3


def _fingerprints(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``fp, n`` of the fingerprints of two or more rows, a written table; rows and bytes of all texts, observed on the way."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.xxhash64(text).alias("fp"), F.octet_length(text).cast("long").alias("size")).groupBy("fp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    seen = Observation()
    repeated = written(each.observe(seen, F.sum("n").alias("rows"), F.sum("size").alias("size")).filter("n > 1").select("fp", "n"), "audit-fingerprints")
    return repeated, seen.get["rows"] or 0, seen.get["size"] or 0


def _sieve(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of fingerprints, by their leading bits, and how many bits those are. At most 2^21 words come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (repeated.count() * BITS_EACH).bit_length()))
    slot = F.shiftrightunsigned("fp", 64 - bits)
    words = repeated.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(fp, {64 - bits}) & 63 AS INT))")).alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return out.view(np.uint64), bits


Entry = tuple  # settled: (id, part, mask, rows); routed: (fp, text, least id, mask, {part: rows})


def _settled(routed: Entry, more: int) -> Iterator[Entry]:
    _, _, ident, mask, parts = routed
    return ((ident, part, mask | more, n) for part, n in parts.items())


class Chains:
    """Texts by fingerprint, each with its least id. ``add`` gives the rows that are copies now."""

    def __init__(self):
        self.by: dict[int, list[Entry]] = {}
        self.size = 0

    def add(self, new: Entry) -> Iterable[Entry]:
        chain = self.by.setdefault(new[0], [])
        for i, old in enumerate(chain):
            if old[1] == new[1]:
                if new[2] == old[2]:
                    chain[i] = (*old[:4], {p: old[4].get(p, 0) + new[4].get(p, 0) for p in old[4] | new[4]})
                    return ()
                if new[2] > old[2]:
                    return _settled(new, COPY)
                chain[i] = new
                return _settled(old, COPY)
        chain.append(new)
        self.size += len(new[1]) + 500
        return ()

    def drain(self) -> Iterator[Entry]:
        for chain in self.by.values():
            yield from chain
        self.by, self.size = {}, 0


def _route(fp: int, salt: int) -> int:
    return (fp + salt * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF


def routed(rows: RDD, sieve: np.ndarray, bits: int, hot: list[int], partitions: int) -> RDD:
    """``(id, part, mask, rows)`` of rows ``(id, part, text)``, with the copies marked."""
    sc = rows.context
    shared = sc.broadcast((sieve, frozenset(hot)))

    def leave(k: int, part: Iterable[tuple]) -> Iterator[tuple[int, Entry]]:
        words, common = shared.value
        chains, at, salt = Chains(), k, k % SALTS
        sent = lambda e: (_route(e[0], salt if e[0] in common else 0), e)
        for ident, lang, text in part:
            raw = text.encode()
            mask, fp = text_mask(text, raw), xxhash.xxh64_intdigest(raw, SEED)
            slot = fp >> (64 - bits)
            if ident is None or not int(words[slot >> 6]) >> (slot & 63) & 1:
                done: Iterable[Entry] = ((ident, lang, mask, 1),)
            else:
                done = chains.add((fp, raw, ident, mask, {lang: 1}))
            for e in done:
                at += 1
                yield at, e
            if chains.size > HELD_BYTES:
                yield from map(sent, chains.drain())
        yield from map(sent, chains.drain())

    def meet(k: int, part: Iterable[tuple[int, Entry]], last: bool) -> Iterator[tuple[int, Entry]]:
        common = () if last else shared.value[1]
        chains, at = Chains(), k
        for _, e in part:
            for done in (e,) if len(e) == 4 else chains.add(e):
                at += 1
                yield at, done
        for e in chains.drain():
            if e[0] in common:
                yield _route(e[0], 0), e
            else:
                for done in _settled(e, 0):
                    at += 1
                    yield at, done

    out = rows.mapPartitionsWithIndex(leave).partitionBy(partitions, lambda key: key).mapPartitionsWithIndex(lambda k, part: meet(k, part, not hot))
    if hot:
        out = out.partitionBy(partitions, lambda key: key).mapPartitionsWithIndex(lambda k, part: meet(k, part, True))
    return out.values()


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, mask, n`` of the rows: the filters they fail, the first letter as the least bit. Equal rows may be one with their number."""
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    repeated, rows, size = _fingerprints(docs)
    sieve, bits = _sieve(repeated)
    at = max(LEAST_HOT, rows // MOST_HOT)
    hot = [r.fp % (1 << 64) for r in repeated.filter(F.col("n") > at).select("fp").collect()]  # MOST_HOT at most
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED_BYTES))
    found = routed(docs.rdd.map(tuple), sieve, bits, hot, partitions)
    kind = docs.schema["id"].dataType.simpleString()
    return spark.createDataFrame(found, f"id {kind}, part string, mask int, n long", verifySchema=False)


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part. counts: rows, good ones and toxic ones by mask."""
    at = np.arange(MASKS)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    total, out, shapley = counts[:, 0], [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            fails, alive = (at & bit[f]) > 0, (at & before) == 0
            gone = counts[fails & alive].sum(axis=0)
            out.append((f, "".join(order), step, int(total[alive & ~fails].sum()), int(gone[0]), int(total[fails & ~alive].sum()), int(total[bit[f]]), int(gone[1]), int(gone[2])))
            shapley[f] += int(gone[0])
            before |= bit[f]
    for f, *row in out:
        yield (part, *row, shapley[f])


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step; see ``OUTPUT``. labels: the id, ``quality`` and ``toxic``."""
    spark = df.sparkSession
    marks = labels.groupBy(labels[id_col].alias("id")).agg(F.coalesce(F.max(labels["quality"] == 1), F.lit(False)).alias("good"), F.coalesce(F.max(labels["toxic"] == 1), F.lit(False)).alias("toxic"))
    known = masks(df, id_col, text_col, part_col).join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

    def vectors(rows: Iterable[tuple]) -> Iterator[tuple[str, np.ndarray]]:
        own: dict[str, np.ndarray] = {}
        for part, mask, n, good, toxic in rows:
            if part not in own:
                own[part] = np.zeros((MASKS, 3), np.int64)
            own[part][mask] += (n, n * good, n * toxic)
        return iter(own.items())

    sums = known.rdd.mapPartitions(vectors).combineByKey(lambda v: v, np.add, np.add)
    return spark.createDataFrame(sums.flatMap(lambda x: report(*x)), OUTPUT, verifySchema=False)
