"""SimHash near-duplicates with pigeonring candidate filtering.

A text's fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes of the text's word shingles.

Two fingerprints that differ in at most t bits, cut into m segments on a ring, have a segment from which every chain of the next
l segments differs in at most floor(l t / m) bits (the pigeonring principle). With t = 2 and m = 8 the first three segments of
such a chain are equal, and of the next four together at most one bit differs, so one half of those is equal too: an
equi-join on 40 bits finds the pairs. The chain budgets then prune, and the Hamming distance decides.

A bucket of more than ``BUCKET`` fingerprints emits no pairs. Its fingerprints are linked through the points at distance one: two
fingerprints differ in at most two bits if and only if both are within one bit of some point, so each gives its 65 points,
and all that share a point are joined to the least of them. That is exact and linear in the bucket.

Pairs of a Jaccard similarity of 0.8 differ in about 15 % of their bits, and in many more where texts are short, so no number of bits
decides them. ``one_of_each`` takes the pairs that pigeonring finds first and counts what their sets of shingles share. That joins
most of a group of near copies. Then it completes the links between what is still apart: it joins the sets of shingles themselves,
by prefix, length and place, and counts again.

Equal fingerprints are one node, so groups of copies of any size cost a row each.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; rows with the same id each get a
row; null ids are kept, with the least other id of their component; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, sliced, trimmed, written
from gridloom.llm.components import roots

BATCH_BYTES = 2_000_000
SEGMENTS, WIDTH, MOST_BITS = 8, 8, 2
BUCKET = 256
SEED = 42
#: A shingle in more prefixes than this is a crowd, whose sets are compared with so many of them first.
CROWDED, PIVOTS = 64, 4
#: One text in so many is sampled for common shingles: those in so many sampled texts, and so many of them at most.
SAMPLED, COMMON, MOST_COMMON = 16, 8, 100_000
#: So many longs (16 MB) are broadcast at most; more are joined by a shuffle.
BROADCAST_LONGS = 2_000_000
#: Words of 64 bits by which a pair is ruled out before its sets are read.
MARKS = 16


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of the text's word shingles, in order, repeats included; of all its words where there are fewer; none without words.
    Words are split at white space (space, tab to carriage return), A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    last = max(1, len(words) - shingle + 1)
    ends = (starts + sizes)[min(shingle, len(words)) - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends.tolist(), strict=True)], np.uint64)


def voted(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        votes += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned fingerprint."""
    return voted(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` of each row, and the long columns to keep; fp is the fingerprint as a signed long."""
    source = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *(df[c] for c in keep))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            found = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found), *(part.column(c) for c in keep)], ["doc_id", "fp", *keep])

    return source.mapInArrow(trimmed(run), f"doc_id {kind}, fp long" + "".join(f", {c} long" for c in keep))


def turned(fp: Column, segments: int) -> Column:
    """The ring turned so that the given segment comes first (lowest)."""
    n = WIDTH * segments
    return F.shiftrightunsigned(fp, n).bitwiseOR(F.shiftleft(fp, 64 - n)) if n else fp


def differing(a: Column, b: Column, mask: int = -1) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x if mask == -1 else x.bitwiseAND(F.lit(mask)))


def keys(nodes: DataFrame) -> DataFrame:
    """``fp, start, key``: 16 keys a fingerprint. A key has the start and 40 bits that are equal in a pair it finds."""
    made = []
    for start in range(SEGMENTS):
        ring = turned(F.col("fp"), start)
        for half, mask in enumerate((0xFF_FFFF | 0xFFFF << 24, 0xFF_FFFF | 0xFFFF << 40)):
            bits = ring.bitwiseAND(F.lit(mask))
            bits = bits if half == 0 else bits.bitwiseAND(F.lit(0xFF_FFFF)).bitwiseOR(F.shiftrightunsigned(bits, 16).bitwiseAND(F.lit(0xFFFF << 24)))
            made.append(F.struct(F.lit(start).alias("start"), bits.bitwiseOR(F.lit((start * 2 + half) << 40)).alias("key")))
    return nodes.select("fp", F.explode(F.array(*made)).alias("k")).select("fp", "k.start", "k.key")


def within_budgets(a: Column, b: Column, start: int) -> Column:
    """Every chain of segments from the start on stays within its share of the differences."""
    x, y = turned(a, start), turned(b, start)
    ok = F.lit(True)
    for length in range(1, SEGMENTS):
        if length * MOST_BITS // SEGMENTS != (length + 1) * MOST_BITS // SEGMENTS:  # the longest chain of each budget
            ok = ok & (differing(x, y, (1 << WIDTH * length) - 1) <= length * MOST_BITS // SEGMENTS)
    return ok


def links(nodes: DataFrame) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints ``fp`` of ``nodes``, with the components of all pairs within 2 bits."""
    every = written(keys(nodes), "simhash-keys")
    sizes = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = every.join(sizes, "key")
    small = shared.filter(F.col("n") <= BUCKET).select("key", "start", "fp")
    a, b = small.select("key", "start", F.col("fp").alias("u")), small.select("key", F.col("fp").alias("v"))
    chain = F.lit(False)
    for start in range(SEGMENTS):
        chain = chain | ((F.col("start") == start) & within_budgets(F.col("u"), F.col("v"), start))
    pairs = a.join(b, "key").filter(F.col("u") > F.col("v")).filter(chain).filter(differing(F.col("u"), F.col("v")) <= MOST_BITS).select("u", "v")
    crowded = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    points = written(crowded.select("fp", F.explode(flips).alias("point")), "simhash-points")
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    stars = points.join(least, "point").filter(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    return pairs.union(stars)


def components(docs: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint of ``docs(doc_id, fp)``; root is the least fingerprint of its component."""
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = roots(links(nodes.select("fp")))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of each row: the least id of all rows that are linked to it, directly or not."""
    docs = written(fingerprints(df, shingle, id_col, text_col), "simhash")
    return docs.join(components(docs).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def common_shingles(df: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many texts, the less common first, from a sample. They only order the prefixes, so a bad sample costs time, not pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            sets = [shingle_set(t or "", shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    sample = df.filter(F.pmod("row", F.lit(SAMPLED)) == 0).select("text").mapInArrow(trimmed(run), "s long")
    found = sample.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()
    return np.array([r.s for r in reversed(found)], np.int64).view(np.uint64)


def prefixes(df: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """``doc_id, row, fp, sim, n, bits, prefix`` of each row of ``df(doc_id, text, row)``: the hash of its shingle set, its fingerprint,
    the set's size, which of ``64 * MARKS`` bits an odd number of its shingles fall on, and the first shingles by one order for all
    texts, so many that two sets of that similarity have one in common."""
    kind = df.schema["doc_id"].dataType.simpleString()
    common = common_shingles(df, shingle)
    sorter = np.argsort(common)
    ascending = common[sorter]

    def first(h: np.ndarray) -> np.ndarray:
        held = len(h) - math.ceil(share * len(h)) + 1 if len(h) else 0
        if not len(common):
            return h[:held]
        at = np.minimum(np.searchsorted(ascending, h), len(common) - 1)
        rank = np.where(ascending[at] == h, sorter[at] + 1, 0)
        return h[np.lexsort((h, rank))][:held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            hashes = [shingle_hashes(t or "", shingle) for t in part.column("text").to_pylist()]
            sim = np.array([voted(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            fp = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            odd = [np.bincount((h % (64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1 for h in sets]
            bits = pa.array([np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64) for x in odd], pa.list_(pa.int64()))
            heads = pa.array([first(h).view(np.int64) for h in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(fp), pa.array(sim), sizes, bits, heads], ["doc_id", "row", "fp", "sim", "n", "bits", "prefix"])

    return df.select("doc_id", "text", "row").mapInArrow(trimmed(run), f"doc_id {kind}, row long, fp long, sim long, n int, bits array<long>, prefix array<long>")


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """``fp, s`` of each row of ``df(fp, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            sets = pa.array([shingle_set(t or "", shingle).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("fp"), sets], ["fp", "s"])

    return df.select("fp", "text").mapInArrow(trimmed(run), "fp long, s array<long>")


def few(table: DataFrame, longs: int = 1) -> DataFrame:
    """A written table of so many longs a row, marked for broadcast if it is proven small."""
    return F.broadcast(table) if table.count() * longs <= BROADCAST_LONGS else table


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``u, v``: pairs of sets ``fp`` of ``nodes(fp, sim)`` whose fingerprints pigeonring finds within ``MOST_BITS`` bits: sets with one
    fingerprint are paired with the least of them, and those of two fingerprints by their least."""
    least = written(nodes.groupBy("sim").agg(F.min("fp").alias("least")), "simhash-prints")
    equal = nodes.select("fp", "sim").join(least, "sim").filter(F.col("fp") > F.col("least")).select(F.col("fp").alias("u"), F.col("least").alias("v"))
    near = links(least.select(F.col("sim").alias("fp")))
    side = lambda one, to: least.select(F.col("sim").alias(one), F.col("least").alias(to))
    across = near.join(side("u", "x"), "u").join(side("v", "y"), "v").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    return written(equal.union(across).distinct(), "simhash-pairs")


def similar_links(nodes: DataFrame, texts: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """Links ``u, v`` between the distinct sets ``fp`` of ``nodes(fp, row, sim, n, bits, prefix)`` with the components of all pairs of that
    similarity.

    Pairs that pigeonring finds come first. Of what is still apart, a pair meets in the first shingle that both prefixes have, where
    its sizes and places still allow the overlap it needs; then its bits must allow it, and the sets decide. In a shingle that more
    than ``CROWDED`` prefixes have, each set is compared with a few of them first; then only sets of different components are
    compared, all of them."""
    over, under = share.numerator, share.numerator + share.denominator

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``fp, s`` of the wanted ``fp``. Rows that occur more than once give their set once."""
        rows = written(nodes.select("fp", "row").join(wanted, "fp"), "simhash-wanted")
        found = written(shingle_sets(texts.select("row", "text").join(few(rows, 2), "row").select("fp", "text"), shingle), "simhash-sets")
        drop_written(rows)
        if found.groupBy("fp").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            return found
        once = written(found.dropDuplicates(["fp"]), "simhash-sets")
        drop_written(found)
        return once

    def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs, a written table, whose sets are similar. Sets of no pair stay where they are."""
        held = sets.join(few(written(ends(pairs), "simhash-ends")), "fp", "left_semi")
        both = pairs.join(held.select(F.col("fp").alias("u"), F.col("s").alias("x")), "u").join(held.select(F.col("fp").alias("v"), F.col("s").alias("y")), "v")
        return both.filter(F.size(F.array_intersect("x", "y")) * under >= (F.size("x") + F.size("y")) * over).select("u", "v")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()

    quick = fingerprint_pairs(nodes)
    sets = sets_of(ends(quick))
    found = written(similar(quick, sets), "simhash-near")
    drop_written(sets)
    apart = written(roots(found), "simhash-roots").withColumnRenamed("node", "fp")
    every = nodes.select("fp", "n", F.posexplode("prefix").alias("at", "key"))
    # counts are pre-aggregated and the join back can be split, as one shingle may be in very many prefixes; most are in one alone
    counts = written(every.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"), "simhash-counts")
    counted = every.join(few(counts, 2), "key")
    shared = written(counted.join(apart, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-shared")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of different components, of two parts of ``shared``, that can be similar as far as the shingle they meet in shows."""
        x = a.select("key", F.col("fp").alias("p"), F.col("n").alias("pn"), F.col("at").alias("pat"), F.col("root").alias("proot"))
        y = b.select("key", F.col("fp").alias("q"), F.col("n").alias("qn"), F.col("at").alias("qat"), F.col("root").alias("qroot"))
        both = x.join(y, "key").filter((F.col("proot") != F.col("qroot")) & (F.least(F.col("pn") - F.col("pat"), F.col("qn") - F.col("qat")) * under >= (F.col("pn") + F.col("qn")) * over))
        both = both.filter("p > q") if a is b else both
        return both.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))

    marks = written(nodes.join(shared.select("fp").distinct(), "fp", "left_semi").select("fp", "n", "bits"), "simhash-marks")

    def likely(pairs: DataFrame) -> DataFrame:
        """Without pairs whose sets differ in too many shingles, as each bit that differs stands for one at least."""
        side = lambda u, x, n: marks.select(F.col("fp").alias(u), F.col("bits").alias(x), F.col("n").alias(n))
        both = pairs.distinct().join(side("u", "x", "un"), "u").join(side("v", "y", "vn"), "v")
        differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
        return both.filter((F.col("un") + F.col("vn") - differ) * under >= (F.col("un") + F.col("vn")) * (2 * over)).select("u", "v")

    scarce = shared.filter(F.col("held") <= CROWDED)
    many = shared.filter(F.col("held") > CROWDED).drop("held")
    least = many.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("fp"))).filter(F.col("i") <= PIVOTS).drop("i")
    first = written(likely(met(scarce, scarce).union(met(many, least))), "simhash-pairs")
    sets = sets_of(ends(first).union(many.select("fp")).distinct())
    found = written(found.union(similar(first, sets)), "simhash-near")
    if many.isEmpty():
        return found
    for more in (PIVOTS * 8, None):  # the rest of each crowd, with more of them and then with all
        known = roots(found).withColumnRenamed("node", "fp")
        rooted = written(many.drop("root").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
        main = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
        rest = rooted.join(main, "key").filter("root <> main").drop("main")
        others = rooted if more is None else rooted.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("fp", F.lit(more))))).filter(F.col("i") <= more).drop("i")
        pairs = written(likely(met(rest, others)), "simhash-pairs")
        found = written(found.union(similar(pairs, sets)), "simhash-near")
        drop_written(rooted)
    for old in (sets, shared, marks, first):
        drop_written(old)
    return found


def one_of_each(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates of that Jaccard similarity of word shingles or more: of each component the row with the
    least id stays (of several with that id, the one with the least hash of all columns). Every pair is found, and its sets of
    shingles decide. Rows keep their columns, whatever the names."""
    share = Fraction(similarity).limit_denominator(1000)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), row.alias("row"))
    docs = written(prefixes(keyed, shingle, share), "simhash")
    nodes = written(docs.groupBy("fp").agg(F.min_by(F.struct("row", "sim", "n", "bits", "prefix"), "row").alias("x")).select("fp", "x.*"), "simhash-nodes")
    slim = written(docs.select("doc_id", "row", "fp"), "simhash-rows")
    drop_written(docs)
    found = roots(similar_links(nodes, keyed, shingle, share)).withColumnRenamed("node", "fp")
    rooted = slim.join(found, "fp", "left").select("doc_id", "row", F.coalesce("root", "fp").alias("root"))
    kept = written(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("x")).select(F.col("x.row").alias("row")).distinct(), "simhash-kept")
    repeats = slim.groupBy("row").agg(F.count("*").alias("k")).filter("k > 1").select("row")
    again = written(repeats.join(few(kept), "row", "left_semi"), "simhash-again")
    for old in (nodes, slim):
        drop_written(old)
    # the whole row is one column here, so no name of the input can clash
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("it"), row.alias("row"))
    held = packed.join(few(kept), "row", "left_semi")
    if not again.isEmpty():  # texts of rows that are there once are not shuffled
        own = Window.partitionBy("row").orderBy("row")
        same = held.join(few(again), "row", "left_semi").withColumn("k", F.row_number().over(own)).filter("k = 1").drop("k")
        held = held.join(few(again), "row", "left_anti").union(same)
    return held.select(*(F.col(f"it.`{c}`").alias(c) for c in df.columns))
