"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Two lines match if the Jaccard similarity of their sets is 0.8 or more. A line is removed if it
matches any line before it, in the order of ids and then of places in the text; so the first of all matching lines stays.

1. Words are ordered by rarity: first those that are not common, then how often the words of a word's hash bucket occur in the
   corpus, in 64 classes, then the word's hash. The histogram has at most 2^16 buckets, however large the corpus; what is common is told
   by a bit for each of 2^20 finer buckets, as in a large corpus each bucket of the histogram counts much by its many rare words.
2. Equal lines become one class, represented by its first line. A hot line is pre-aggregated before the shuffle.
3. In a large group of near copies nearly every line matches one of a few. So each class is first compared with some earlier classes
   that agree with it in one of three sketches (its rarest words, its words with the least hashes, those with the greatest), with the
   first two and the last two of them. Classes beyond the first ``EASY`` of a sketch for which that finds a match, as far as sizes and
   bitmaps tell, are set aside, and their one pair is verified. That costs a row for each class and sketch, however large a group is.
4. Two sets of sizes a <= b that match share a word among the first ``a - ceil(8/9 a) + 1`` of the smaller and the first
   ``b - ceil(0.8 b) + 1`` of the larger (prefix filter). Classes meet by such words; sizes must be within 0.8 (length filter); the
   first shared word leaves room for the overlap that is needed (positional filter); and a bitmap of each set, the parity of its words
   by 6 or 7 bits of their hash, bounds the overlap from above. What is left is verified on the whole sets. This join takes the
   classes that were not set aside.
5. Classes that still have no match meet those that were set aside, in the same way, first a few of a key and then all, and so do
   set-aside classes whose pair failed with all others. So every pair is considered, but for those whose later line has a match
   already: one earlier match decides.
6. A word whose finer bucket counts more than ``COMMON`` emits no pairs by itself. Sets that match also share a second word among the
   first p + 1, so the classes of such a word meet by the word and a second one, and the place that needs room is the one before the
   second word's. Other words are met by ``COMMON`` classes at most.

Words are identified by 57 bits of their hash where classes meet and by 64 where a pair is verified, lines by 64.

Defined results: null and empty texts have no lines to remove; blank lines are kept; rows with the same id take the same place
in the order, so equal places remove nothing of each other; null ids come first; ids that are no integers are ordered by
their hash; ties do not occur otherwise. Lines are what is between line feeds, words what is between spaces. Other columns are
untouched, whatever their names, but for one that has the name of an output column: the output takes its place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, written

LEAST_BUCKETS, MOST_BUCKETS = 1 << 12, 1 << 16
#: So many bytes of text a bucket, roughly.
BUCKET_BYTES = 1_500
#: Classes of rarity, of common words and of others alike; a bit tells which.
CLASSES, CLASS_BITS = 64, 7
#: Words are common if the words of their bucket, of so many, count more.
COMMON, FINE_BUCKETS = 4_096, 1 << 20
#: So many classes of a sketch are never set aside. Sketches of more than so many bytes of text are dealt out further.
EASY, SALT_BYTES = 16, 64 << 30
#: Sets of more words have bitmaps of 128 bits, others of 64.
WIDE_SET = 70
#: So many longs (16 MB) are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Zones of sizes in which classes meet: so many for each factor of e. Keys of a zone have so many bits.
ZONES, KEY_BITS = 1, 40
#: Keys are met in so many rounds.
ROUNDS = 2
#: Lines a text may have; of ids beyond 34 bits.
LINES, FAR_LINES = 1 << 28, 1 << 31
NUM, DEN = 4, 5  # the similarity, 0.8


def order_base(df: DataFrame, id_col: str) -> Column:
    """The place of a row's first line in the order of all lines; the n-th next line is n further on."""
    kind = df.schema[id_col].dataType.simpleString()
    ident = df[id_col]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        ident = F.xxhash64(ident)
        return F.coalesce(ident.cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")) * F.lit(FAR_LINES).cast("decimal(11,0)")
    low, high = df.agg(F.min(ident), F.max(ident)).first()
    if low is None or -(2**34) < low and high < 2**34:
        return F.coalesce(ident.cast("bigint"), F.lit(-(2**34))) * F.lit(LINES)
    return F.coalesce(ident.cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")) * F.lit(FAR_LINES).cast("decimal(11,0)")


def rarity_table(df: DataFrame, text_col: str = "text") -> tuple[list[int], list[int], int]:
    """For each hash bucket (a power of two of them) its rarity class, four for each doubling of a count; a bit for each of
    ``FINE_BUCKETS`` that counts no more than ``COMMON``, 64 in a long, or nothing if all do; and the bytes of all words with a space
    each. One pass: counts of finer buckets are summed to ``MOST_BUCKETS``, and those to as many as the size asks for."""
    # a text's words are those of its lines, so it is split once
    each = df.select(F.explode(F.split(F.replace(df[text_col], F.lit("\n"), F.lit(" ")), " ", -1)).alias("w")).filter("w <> ''")
    fine = each.groupBy(F.xxhash64("w").bitwiseAND(F.lit(FINE_BUCKETS - 1)).cast("int").alias("fine")).agg(F.count("*").alias("n"), F.sum(F.octet_length("w") + 1).alias("bytes"))
    common = F.collect_list(F.when(F.col("n") > COMMON, F.col("fine"))).alias("common")
    # written, so that the shuffle of the finer ones does not stay on disk
    counted = written(fine.groupBy(F.col("fine").bitwiseAND(F.lit(MOST_BUCKETS - 1)).alias("b")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), common), "line-words")
    got = counted.toPandas()
    drop_written(counted)
    size, buckets = int(got["bytes"].sum()), LEAST_BUCKETS
    while buckets < MOST_BUCKETS and buckets * BUCKET_BYTES < size:
        buckets *= 2
    counts = np.zeros(MOST_BUCKETS)
    counts[got["b"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(-1, buckets).sum(axis=0)
    low = np.percentile(counts[counts > 0], 5) if (counts > 0).any() else 1
    classes = np.clip(np.round(4 * np.log2(np.maximum(counts, low) / low)), 0, CLASSES - 1).astype(np.int64)
    rare = np.ones(FINE_BUCKETS, np.uint8)
    for some in got["common"]:
        rare[list(some)] = 0
    return classes.tolist(), [] if rare.all() else np.packbits(rare, bitorder="little").view("<i8").tolist(), size


def hashes(line: Column) -> Column:
    """The hashes of a line's distinct words."""
    return F.array_except(F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def longs(values: list[int]) -> Column:
    # folded to a constant. The driver prints it whole into each report of the plan, so classes are shifted in the rows
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def word_sets(distinct: Column, table: list[int], rare: list[int] | None = None) -> Column:
    """Distinct words in order of rarity, each as a long: class, then 57 bits of the hash. With the bits of ``rare`` (none: all are)
    those that are not common are below zero, the others not."""
    known, bits = longs(table), longs(rare or [])
    last, none = F.lit(len(table) - 1), F.lit(0).cast("bigint")
    at = lambda values, i: F.coalesce(F.get(values, i), none)

    def word(h: Column) -> Column:
        out = F.shiftleft(at(known, h.bitwiseAND(last)), 64 - CLASS_BITS).bitwiseOR(F.shiftrightunsigned(h, CLASS_BITS))
        if rare is None:
            return out
        if not rare:
            return out.bitwiseOR(F.lit(-(2**63)))
        own = at(bits, F.shiftright(h.bitwiseAND(F.lit(FINE_BUCKETS - 1)), 6))
        return out.bitwiseOR(F.shiftleft(F.call_function("shiftright", own, h.bitwiseAND(F.lit(63)).cast("int")), 63))

    # never null, which the coalesce tells Spark: it sorts plain longs then
    return F.sort_array(F.transform(distinct, word))


def lines_of(df: DataFrame, base: Column, text_col: str) -> DataFrame:
    """``place, line`` of every line."""
    return df.select(base.alias("base"), F.posexplode(F.split(df[text_col], "\n", -1)).alias("n", "line")).select((F.col("base") + F.col("n")).alias("place"), "line")


def few(df: DataFrame, longs: int = 1) -> DataFrame:
    """``df``, of so many longs a row, marked for broadcast if it is proven small. It is a written table."""
    return F.broadcast(df) if df.count() * longs <= BROADCAST_ROWS else df


def lines_at(df: DataFrame, base: Column, text_col: str, places: DataFrame) -> DataFrame:
    """``place, line`` at the places wanted, a written table. Texts without one are not taken apart."""
    unit = LINES if places.schema["place"].dataType.simpleString() == "bigint" else FAR_LINES
    bases = written(places.select((F.col("place") - F.pmod("place", F.lit(unit))).alias("base")).distinct(), "lines-bases")
    held = df.withColumn("base", base).join(few(bases), "base", "left_semi")
    return lines_of(held, F.col("base"), text_col).join(few(places), "place", "left_semi")


def matched(pairs: DataFrame, lines: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``hash``: the lines at the places ``b`` that match the line at ``a`` in one of the candidate pairs. The lines are looked up by
    place; each ``b`` is verified with its earliest candidate first, and with the others only where that fails. Sets need no order here,
    and no table of rarity in the plans."""
    pairs = written(pairs, "line-pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct(), "lines-wanted")
    sets = written(lines(wanted).select("place", F.xxhash64("line").alias("hash"), hashes(F.col("line")).alias("s")), "line-sets")

    def matching(some: DataFrame) -> DataFrame:
        both = some.join(sets.select(F.col("place").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("place").alias("b"), "hash", F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.filter(shared * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM).select("b", "hash").distinct()

    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    found = written(matching(first), "line-matches")
    # a place of several rows with one id can hold several lines: all its pairs are looked at again
    shared_places = sets.groupBy("place").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("place").alias("b"))
    settled = found.select("b").join(shared_places, "b", "left_anti")
    rest = written(matching(pairs.join(settled, "b", "left_anti").join(first, ["a", "b"], "left_anti")), "line-matches")
    out = written(found.union(rest).select("hash").distinct(), "lines-matched")
    for old in (pairs, wanted, sets, found, rest):
        drop_written(old)
    return out


#: Columns of a class: its line's hash, its first place, size and bitmaps.
CARRIED = ["hash", "c", "n", "m", "m2"]


def alike(n: Column, m: Column, m2: Column, other: str) -> Column:
    """By sizes and bitmaps, the class can match the one whose columns begin with ``other``."""
    on, om, om2 = (F.col(other + k) for k in CARRIED[2:])
    sizes = (on * DEN >= n * NUM) & (n * DEN >= on * NUM)
    # sets of sizes a and b that share o words differ in a + b - 2 o, and their bitmaps in no more bits
    low, high = om.bitwiseXOR(m), om2.bitwiseXOR(m2)
    differ = F.coalesce(F.bit_count(high) + F.bit_count(low.bitwiseXOR(high)), F.bit_count(low))
    return sizes & ((on + n - differ) * (NUM + DEN) >= (on + n) * (2 * NUM))


def easy_pairs(classes: DataFrame, salts: int) -> DataFrame:
    """``a, b, hash``: for classes beyond the first ``EASY`` of a sketch an earlier class that they seem to match."""
    # the marks of a sketch: its number and its words
    sketches = F.array(*(F.xxhash64(F.lit(k), F.col(f"k{k}")) for k in range(3)))
    rows = classes.select(*CARRIED, F.explode(sketches).alias("key"), F.pmod("hash", F.lit(salts)).alias("salt"))
    # most sketches are of one class alone: the window gets those of more than ``EASY`` classes
    crowds = written(rows.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > EASY).select("key"), "line-crowds")
    rows = rows.join(few(crowds), "key", "left_semi")
    near = Window.partitionBy("key", "salt").orderBy("c", "hash")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct(*CARRIED[1:])
    met = rows.select(*CARRIED, F.row_number().over(near).alias("rank"), F.first(me).over(before).alias("p0"), F.nth_value(me, 2).over(before).alias("p1"), F.lag(me, 1).over(near).alias("p2"), F.lag(me, 2).over(near).alias("p3"))
    own = [F.col(k) for k in CARRIED[2:]]
    choice = F.coalesce(*(F.when((F.col(f"p{k}.c") < F.col("c")) & alike(*own, f"p{k}."), F.col(f"p{k}.c")) for k in range(4)))
    return met.filter(F.col("rank") > EASY).select(choice.alias("a"), F.col("c").alias("b"), "hash").filter("a is not null").groupBy("b", "hash").agg(F.min("a").alias("a")).select("a", "b", "hash")


def keyed(classes: DataFrame) -> DataFrame:
    """A row for each place ``i`` of each prefix, with the ``key`` by which classes meet: the word, or a common one and a second one. Then
    ``i`` is the place before the second one's: sets that share these two first have no more in common than follows there."""
    p = F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1
    w = F.col("w")
    rare = classes.select(*CARRIED, F.posexplode(F.slice("prefix", 1, p)).alias("i", "w")).filter(w < 0).select(*CARRIED, "i", w.alias("key"))
    # the last word of a prefix is its most common one, so most prefixes need not be taken apart again
    crowded = classes.filter(F.get("prefix", p - 1) >= 0).select(*CARRIED, "prefix", F.posexplode(F.slice("prefix", 1, p)).alias("i", "w")).filter(w >= 0)
    # a set of one word has no second one, and matches equal sets alone
    second = F.when(F.col("n") == 1, F.array("w")).otherwise(F.slice("prefix", F.col("i") + 2, F.greatest(F.size("prefix") - F.col("i") - 1, F.lit(0))))
    pairs = crowded.select(*CARRIED, "w", "i", F.posexplode(second).alias("j", "w2"))
    return rare.union(pairs.select(*CARRIED, (F.col("i") + F.col("j")).alias("i"), F.xxhash64("w", "w2").alias("key")))


def met(x: DataFrame, y: DataFrame, more: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """The rows of ``x`` and ``y`` that meet by a key and pass the filters of place and size, the bitmaps and ``more``."""
    # both sides are named anew in the same way, so that one shuffle serves them where they are the same rows
    x = x.select(F.col("key").alias("key_"), *(F.col(k).alias(f"x_{k}") for k in [*CARRIED[1:], "i"]))
    y = y.select(F.col("key").alias("_key"), *(F.col(k).alias(f"y_{k}") for k in [*CARRIED[1:], "i"]))
    room = F.least(F.col("y_n") - F.col("y_i"), F.col("x_n") - F.col("x_i")) * (NUM + DEN) >= (F.col("x_n") + F.col("y_n")) * NUM
    return x.join(y, (x["key_"] == y["_key"]) & more(x, y) & room & alike(*(F.col(f"x_{k}") for k in CARRIED[2:]), "y_"))


def candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """``a, b``: the pairs of an earlier and a later class that meet by a key and pass the filters."""
    return met(later, earlier, lambda x, y: y.y_c < x.x_c).select(F.col("y_c").alias("a"), F.col("x_c").alias("b")).distinct()


def candidates_among(rows: DataFrame) -> DataFrame:
    """``a, b`` of all pairs of classes of ``rows``. The smaller set of a pair needs its first ``a - ceil(8/9 a) + 1`` words alone. Classes meet
    in the zone of the larger one's size: the smaller one is in each zone from its own to that of the largest size its place has room for."""
    n = F.col("n")
    zone = lambda size: F.floor(F.log(size) * ZONES).cast("int")
    # keys that clash are a pair more to rule out
    zoned = lambda z: F.xxhash64("key", z).bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key")
    most = F.floor((n - F.col("i")) * (NUM + DEN) / NUM).cast("int") - n
    small = rows.filter(F.col("i") <= n - F.ceil(n * (2 * NUM) / (NUM + DEN)).cast("int"))
    small = small.select(*CARRIED, "i", "key", F.explode(F.sequence(zone(n), zone(most))).alias("zone")).select(*CARRIED, "i", zoned(F.col("zone")))
    pairs = met(rows.select(*CARRIED, "i", zoned(zone(n))), small, lambda x, y: (y.y_n < x.x_n) & (y.y_c != x.x_c) | (y.y_n == x.x_n) & (y.y_c < x.x_c))
    return pairs.select(F.least("x_c", "y_c").alias("a"), F.greatest("x_c", "y_c").alias("b")).distinct()


def in_rounds(rows: DataFrame) -> DataFrame:
    """``candidates_among`` for some of the keys at a time: rows shuffled for others are not on disk meanwhile. A pair can be there twice."""
    parts = [written(candidates_among(rows.filter(F.pmod("key", F.lit(ROUNDS)) == k)), "line-round") for k in range(ROUNDS)]
    return reduce(DataFrame.union, parts)


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) * 16).cast("int")


def that_may_meet(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Those of ``rows`` that share a key with a row of ``others`` of a size that can match."""
    n = F.col("n")
    reach = F.sequence(size_class(F.ceil(n * NUM / DEN)), size_class(F.floor(n * DEN / NUM)))
    # by one long; where two of them clash, a row more is kept
    wanted = written(others.select("key", F.explode(reach).alias("size")).select(F.xxhash64("key", "size").alias("met")).distinct(), "line-keys-met")
    return rows.withColumn("met", F.xxhash64("key", size_class(n))).join(few(wanted), "met", "left_semi").drop("met")


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``hash, c, kept, again``: the first place of each line with a word, whether it stays there, and whether it is anywhere else,
    where it goes."""
    plain = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    base = order_base(plain, "id")
    lines = lines_of(plain, base, "text")
    wanted = lambda places: lines_at(plain, base, "text", places)
    table, rare, size = rarity_table(plain)
    n = F.size("s")
    own = lines.select("place", F.xxhash64("line").alias("hash"), F.sort_array(hashes(F.col("line"))).alias("h")).select("place", "hash", "h", word_sets(F.col("h"), table, rare).alias("s"))
    # bit k of m is the parity of the words whose hash ends in k; m2 has those with the next bit set, for sets too large for 64 bits
    flipped = lambda m, bit, h: m.bitwiseXOR(F.call_function("shiftleft", bit, h.bitwiseAND(F.lit(63)).cast("int")))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    parity = F.aggregate("s", none, lambda m, h: flipped(m, one, h))
    upper = F.when(n > WIDE_SET, F.aggregate("s", none, lambda m, h: flipped(m, F.shiftright(h, 6).bitwiseAND(one), h)))
    sketches = [F.xxhash64(F.slice("s", 1, 3)), F.xxhash64(F.slice("h", 1, 4)), F.xxhash64(F.slice("h", F.greatest(n - 3, F.lit(1)), 4))]
    # the prefix and one word more
    prefix = F.slice("s", 1, F.least(n, n - F.ceil(n * NUM / DEN).cast("int") + 2))
    own = own.select("place", "hash", n.alias("n"), parity.alias("m"), upper.alias("m2"), *(k.alias(f"k{i}") for i, k in enumerate(sketches)), prefix.alias("prefix"))
    rest = ["n", "m", "m2", "k0", "k1", "k2", "prefix"]
    classes = written(own.groupBy("hash").agg(F.min("place").alias("c"), (F.count("*") > 1).alias("again"), F.any_value(F.struct(*rest)).alias("set")).select("hash", "c", "again", "set.*").filter("n > 0"), "line-classes")
    easy = written(easy_pairs(classes, 1 + size // SALT_BYTES), "line-easy")
    aside = few(easy.select("hash"))
    stay = classes.join(aside, "hash", "left_anti")
    rows = keyed(stay)
    found = matched(in_rounds(rows).union(easy.select("a", "b")), wanted)
    if not easy.isEmpty():
        outside = classes.join(aside, "hash", "left_semi")
        alone = stay.join(few(found), "hash", "left_anti")
        failed = written(outside.join(few(found), "hash", "left_anti"), "line-failed")
        theirs = written(keyed(outside), "line-keys")
        # of sets set aside in vain there are few
        vain = written(keyed(failed), "line-vain")
        shared = written(that_may_meet(keyed(alone), theirs).unionByName(vain), "line-alone")
        ranked = theirs.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("c", "hash")))
        # a few of a group first: what they match needs no others
        first = candidates(shared, ranked.filter(F.col("rank") <= EASY).drop("rank"))
        found = written(found.union(matched(first.union(candidates(vain, that_may_meet(rows, vain))), wanted)).distinct(), "lines-matched")
        rest = shared.join(few(found), "hash", "left_anti")
        found = written(found.union(matched(candidates(rest, theirs), wanted)).distinct(), "lines-matched")
    return classes.select("hash", "c", "again").join(found.withColumn("hit", F.lit(True)), "hash", "left").select("hash", "c", F.col("hit").isNull().alias("kept"), "again")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "deduped", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """``df`` with the deduplicated text, the number of lines and of those removed. A null text has 0 lines and stays null."""
    base = order_base(df, id_col)
    # lines that are there once and stay have nothing to tell
    gone = removals(df, id_col, text_col).filter("again or not kept").drop("again")
    rows = df.select(df[text_col].alias("text"), base.alias("base"))
    every = rows.select("base", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select("base", "h", "n", F.xxhash64("line").alias("hash"))
    hit = every.join(gone, "hash").filter(~F.col("kept") | (F.col("base") + F.col("n") > F.col("c")))
    per_text = written(hit.groupBy("base", "h").agg(F.collect_set("n").alias("gone")), "lines-gone")
    texts_hit, lines_hit = per_text.agg(F.count("*"), F.sum(F.size("gone"))).first()
    small = 4 * texts_hit + (lines_hit or 0) <= BROADCAST_ROWS
    # the whole row is one column here, so no name of the input can clash
    packed = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), df[text_col].alias("text"), base.alias("base"), F.xxhash64(df[text_col]).alias("h"))
    out = packed.join(F.broadcast(per_text) if small else per_text, ["base", "h"], "left")
    # the inner array binds the lines once for all places
    kept = F.expr("transform(array(split(text, '\\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\\n'))[0]")
    made = {
        out_col: F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept),
        lines_col: F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long"),
        removed_col: F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    names = {c.lower() for c in made}
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c.lower() not in names), *(v.alias(c) for c, v in made.items()))
