"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A document leaks an item if a window of 12 of its words agrees in 10 or more places with 12 consecutive words of the item (a
similarity of 0.8 or more), so up to two words in a window may be substituted. Items of 5 to 11 words leak as a whole, where as many
words agree in 0.8 of the places or more: one substitution up to 9 words, two beyond. Shorter ones are too common to tell and never
leak. Words are runs of letters and digits, lower-cased.

Two fixed masks look at 5 of 7 places. Wherever two substitutions are in a window, one of the masks fits somewhere in it
without touching either, so no leak is missed. Short items have masks of three places: blocks side by side, one more of them than
there may be substitutions; five words have room for one block, a second that overlaps it, and a spaced mask for the word they share.
The hashes under the masks at every place of the documents are joined with those of the items. Around each hit the places that agree are marked, and every window that holds the hit is verified.

The items' hashes and the words around them are broadcast while they are at most ``BROADCAST_LONGS`` numbers; beyond that the join
shuffles them.

Defined results: null and empty texts and items leak nothing; equal windows in several items give a row for each item; rows with
the same document id are taken together; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, AGREE = 12, 10
LEAST_WORDS = 5
#: Places that the masks look at; ``tests`` show that they miss no two substitutions.
MASKS = [(0, 1, 2, 5, 6), (0, 1, 3, 5, 6)]
SPAN = 7
#: Masks of items below a window, and for each number of words which mask lies where.
SHORT_MASKS = [(0, 1, 2), (0, 1, 3)]
SHORT_PLACES = {5: [(0, 0), (0, 2), (1, 0)]} | {n: [(0, 0), (0, 3)] for n in range(6, 10)} | {n: [(0, 0), (0, 3), (0, 6)] for n in (10, 11)}
#: Places before and after the start of a hit that its windows can hold.
BEFORE, AROUND = 6, 6 + WINDOW
#: 32 MB.
BROADCAST_LONGS = 4_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_agree(n: Column) -> Column:
    """The places that have to agree in an item of n words, below a window."""
    return F.ceil(n * 4 / 5).cast("int")


def key(words: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(words, at + k) for k in mask))


def keys(words: Column, at: Column, short: bool) -> Column:
    """The hashes under each mask at ``at`` (from 0); with ``short`` also those of items below a window."""
    every = [*enumerate(MASKS), *((-1 - m, mask) for m, mask in enumerate(SHORT_MASKS) if short)]
    return F.array(*(key(words, at, m, mask) for m, mask in every))


def short_keys(words: Column) -> Column:
    """``(item_at, key)`` of an item below a window; a mask that ends beyond the text, which documents may do, holds nulls."""
    placed = lambda n: F.array(*(F.struct(F.lit(at).alias("item_at"), key(words, F.lit(at), -1 - m, SHORT_MASKS[m]).alias("key")) for m, at in SHORT_PLACES[n]))
    return F.coalesce(*(F.when(F.size(words) == n, placed(n)) for n in SHORT_PLACES))


def positions(df: DataFrame, id_col: str, text_col: str, name: str, least: int) -> DataFrame:
    """``name, words, at``: every place where a mask may lie."""
    rows = df.select(df[id_col].alias(name), word_hashes(df[text_col].cast("string")).alias("words"))
    last = F.size("words") - least
    return rows.select(name, "words", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))


def around(words: Column, at: Column) -> Column:
    """The words from ``BEFORE`` before ``at`` on; fewer at the start and the end of a text."""
    return F.slice(words, F.greatest(at - BEFORE, F.lit(0)) + 1, AROUND)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, first_word, last_word, agreeing``: the windows of the document that leak the item, where the first
    begins and the last ends (in words, from 0), and the most places that agree in a window."""
    named = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text"))
    size = F.size(word_hashes(F.col("text").cast("string")))
    short = bool(named.filter(size.between(LEAST_WORDS, WINDOW - 1)).limit(1).count())
    long_keys = positions(named.filter(size >= WINDOW), "item_id", "text", "item_id", SPAN).select("item_id", F.col("at").alias("item_at"), around(F.col("words"), F.col("at")).alias("own"), F.explode(keys(F.col("words"), F.col("at"), False)).alias("key"), F.lit(False).alias("whole"))
    whole = named.filter(size.between(LEAST_WORDS, WINDOW - 1)).select("item_id", word_hashes(F.col("text").cast("string")).alias("own"))
    whole_keys = whole.select("item_id", "own", F.inline(short_keys(F.col("own")))).select("item_id", "item_at", "own", "key", F.lit(True).alias("whole"))
    keyed = long_keys.union(whole_keys) if short else long_keys
    few = (keyed.agg(F.sum(F.size("own") + 4)).first()[0] or 0) <= BROADCAST_LONGS
    every = positions(docs, id_col, text_col, "doc_id", len(SHORT_MASKS[0]) if short else SPAN)
    there = around(F.col("words"), F.col("at"))
    if few:
        hits = every.select("doc_id", "words", "at", F.explode(keys(F.col("words"), F.col("at"), short)).alias("key")).join(F.broadcast(keyed), "key").select("doc_id", "item_id", "at", "item_at", "own", "whole", there.alias("there"))
    else:
        hits = every.select("doc_id", "at", there.alias("there"), F.explode(keys(F.col("words"), F.col("at"), short)).alias("key")).join(keyed, "key").select("doc_id", "item_id", "at", "item_at", "own", "whole", "there")
    # the place of the hit within each slice, and how far both reach to either side
    here, mine = F.least(F.col("at"), F.lit(BEFORE)), F.least(F.col("item_at"), F.lit(BEFORE))
    back = F.least(here, mine)
    reach = F.least(F.size("there") - here, F.size("own") - mine)
    agree = F.transform(F.sequence(-back, reach - 1), lambda k: (F.get("there", here + k) == F.get("own", mine + k)).cast("int"))
    marked = hits.select("doc_id", "item_id", "whole", "at", F.size("own").alias("size"), (F.col("at") - back).alias("from"), back.alias("back"), agree.alias("agree"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y)
    starts = F.when(F.size("agree") >= WINDOW, F.sequence(F.lit(0), F.size("agree") - WINDOW))
    found = F.filter(F.transform(starts, lambda k: F.struct((F.col("from") + k).alias("at"), total(F.slice("agree", k + 1, WINDOW)).alias("agreeing"))), lambda x: x.agreeing >= AGREE)
    windows = marked.filter("not whole").select("doc_id", "item_id", F.explode(found).alias("x"), F.lit(WINDOW).alias("size")).select("doc_id", "item_id", "x.at", "x.agreeing", "size")
    if short:
        like = marked.filter(F.col("whole") & (F.size("agree") == F.col("size"))).withColumn("agreeing", total(F.col("agree")))
        windows = windows.union(like.filter(F.col("agreeing") >= short_agree(F.col("size"))).select("doc_id", "item_id", F.col("from").alias("at"), "agreeing", "size"))
    once = windows.groupBy("doc_id", "item_id", "at").agg(F.max("agreeing").alias("agreeing"), F.max("size").alias("size"))
    return once.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_windows"),
        F.min("at").cast("long").alias("first_word"),
        F.max(F.col("at") + F.col("size")).cast("long").alias("last_word"),
        F.max("agreeing").cast("long").alias("agreeing"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item. A row goes with any row of its id that leaks."""
    found = leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_leaking"]), "left_anti")
