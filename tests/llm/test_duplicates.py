"""Near-duplicates, line dedup, repeats and decontamination against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, decontam, line_dedup, repeats, shard_bwt, simhash
from tests.llm import brute

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(25)]
    out = list(base)
    for b in base[:15]:
        for _ in range(3):
            w = b.split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append("\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)))
    return [*out, None, "", "  \t ", "one two", base[0], "x " * 30_000, "One TWO"]


def test_fingerprints_and_components(spark, texts):
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0), (5, "other text for a used id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    want_fp = [brute.fingerprint(r[1], 3) for r in rows]
    want = brute.components([r[0] for r in rows], want_fp)
    for bucket in (256, 1):
        simhash.BUCKET = bucket
        got = simhash.near_duplicates(df, 3).collect()
        simhash.BUCKET = 256
        assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == sorted(zip([r[0] for r in rows], want_fp, want, strict=True), key=str)
    assert simhash.near_duplicates(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("crowded", [64, 2])
def test_one_of_each_component_stays(spark, crowded):
    """Groups whose members have a similarity of 0.9 or more to the first, and documents that share less than half."""
    rng = random.Random(7)
    rows, firsts = [], []
    for g in range(12):
        w = rng.choices(WORDS, k=400)
        firsts.append(len(rows))
        rows.append((len(rows), " ".join(w), None, "s"))
        for _ in range(g):
            v = list(w)
            for k in rng.sample(range(400), 3):
                v[k] = "edited"
            rows.append((len(rows), "\n".join([" ".join(v[:200]), " ".join(v[200:]).upper()]), None, "s"))
        half = w[:200] + rng.choices(WORDS, k=200)
        firsts.append(len(rows))
        rows.append((len(rows), " ".join(half), None, "s"))
    firsts += [len(rows), len(rows) + 3]
    rows += [(len(rows), None, None, "s"), (len(rows) + 1, "", None, "s"), (len(rows) + 2, " \t", None, "s"), (len(rows) + 3, "few words", None, "s"), (len(rows) + 3, "few words", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, row string").repartition(3)
    simhash.CROWDED = crowded
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    simhash.CROWDED = 64
    assert kept == firsts
    assert simhash.one_of_each(df).columns == df.columns and simhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowded,sampled", [(64, 16), (2, 1)])
def test_pairs_around_the_similarity(spark, crowded, sampled):
    """Pairs that share 160 of 180 + 180 shingles (0.8), 159 (0.79), 165 (0.846), and short texts of 4 against 5 and 3 against 4 shingles."""
    rng = random.Random(8)
    word = lambda: f"v{rng.getrandbits(40)}"
    rows, firsts = [], []

    def add(a, b, near):
        firsts.extend([len(rows)] if near else [len(rows), len(rows) + 1])
        rows.extend([(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))])

    for both in [160] * 30 + [165] * 30 + [159] * 30:
        w = [word() for _ in range(184)]
        add(w, w[: both + 4] + [word() for _ in range(180 - both)], both >= 160)
    for n in [8] * 20 + [7] * 20:
        w = [word() for _ in range(n)]
        add(w, [*w, word()], n == 8)
    frame = [word() for _ in range(100)]  # many texts that share most of their shingles with one text, and less with each other
    firsts.append(len(rows))
    rows += [(len(rows) + k, " ".join(frame[: 100 - k % 9] + [word() for _ in range(k % 9)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = simhash.CROWDED, simhash.SAMPLED
    simhash.CROWDED, simhash.SAMPLED = crowded, sampled
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    simhash.CROWDED, simhash.SAMPLED = held
    assert kept == firsts


def test_repeated_rows_stay_once(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(12)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (7, rows[7][1]), (20, rows[5][1]), (20, rows[5][1]), (None, None), (None, None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    # of texts without a word one stays, and no id comes before all ids
    assert sorted(map(tuple, got.collect()), key=str) == sorted({*rows[:12], (None, None)}, key=str)
    once = simhash.one_of_each(spark.createDataFrame(rows[:12], "doc_id long, text string"))
    assert "Window" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 12


def test_random_fingerprints_near_the_threshold(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        prints += [p, *(p ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 2, 4))]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.components(df).collect()}
    assert [got[p] for p in signed] == brute.components(list(range(len(prints))), prints)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    random.Random(3).shuffle(links)
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("common,easy", [(4096, 16), (3, 0), (0, 1)])
def test_line_dedup(spark, texts, common, easy):
    rng = random.Random(4)
    rows = {i: t for i, t in enumerate(texts)} | {1000: "same line\nsame line\n\nother words here too\n\nother words here too !", 1001: "the\nthe \n the\nthe the\nthe cat", 1002: "\n".join(" ".join(rng.choices(WORDS[:12], k=6)) for _ in range(60)), 1003: "\n".join(" ".join(rng.sample(WORDS[:110], k=rng.randint(60, 100))) for _ in range(40))}
    base = rng.sample(WORDS, 30)  # a group of near copies: some match the first, some one another, some none
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(30), rng.randint(0, 5)):
            own[k] = rng.choice(WORDS)
        rows[2000 + i] = " ".join(own)
    df = spark.createDataFrame([(i, t, i) for i, t in rows.items()], "doc_id long, text string, hash long")
    line_dedup.COMMON, line_dedup.EASY = common, easy
    got = {r.doc_id: (r.deduped, r.n_lines, r.n_removed) for r in line_dedup.dedup(df).collect()}
    line_dedup.COMMON, line_dedup.EASY = 4096, 16
    assert got == brute.line_dedup(rows)


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.deduped, r.n_removed) for r in line_dedup.dedup(df).collect()), key=str)
    assert got == sorted([(None, "a b c", 0), (1, "", 1), (1, "", 1), (2, None, 0), (3, "", 0)], key=str)
    assert line_dedup.dedup(df.limit(0)).count() == 0
    named = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert sum(r.n_removed for r in line_dedup.dedup(named).collect()) in (1, 2)
    far = spark.createDataFrame([(2**60, "a b c"), (-(2**60), "a b c")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup(far).collect()} == {2**60: 1, -(2**60): 0}


def test_words_are_counted_in_one_pass_over_texts(spark):
    df = spark.createDataFrame([("a b\n\n a",), (None,), ("b\nccc  a",)], "text string")
    table, _, size = line_dedup.rarity_table(df)
    assert size == 14  # six words of eight letters, a space each
    bucket = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] & (len(table) - 1) for w in ("a", "b", "ccc")}
    assert len(table) == line_dedup.LEAST_BUCKETS and table[bucket["a"]] > table[bucket["b"]] > table[bucket["ccc"]] == min(table)


def test_lines_that_have_nothing_to_tell(spark):
    df = spark.createDataFrame([(1, "one two\nthree four\nsix"), (2, "three four\nfive"), (3, "five")], "doc_id long, text string")
    got = sorted((r.c, r.kept, r.again) for r in line_dedup.removals(df).collect())
    unit = line_dedup.LINES
    assert got == [(unit, True, False), (unit + 1, True, True), (unit + 2, True, False), (2 * unit + 1, True, True)]


def test_sets_of_lines_are_plain_longs_and_keys_meet_by_one(spark):
    """Spark sorts longs that may be null as objects, and looks up two columns as rows."""
    df = spark.createDataFrame([("b a c b",), ("d",)], "line string").select(line_dedup.hashes(F.col("line")).alias("h"))
    sets = df.select("h", line_dedup.word_sets(F.col("h"), [3, 0]).alias("s"))
    bits = line_dedup.CLASS_BITS
    assert all(r.s == sorted(([3, 0][h & 1] << 64 - bits) | (h % 2**64 >> bits) for h in r.h) and len(r.s) in (1, 3) for r in sets.collect())
    assert not sets.schema["s"].dataType.containsNull
    rows = spark.createDataFrame([(1, 10), (1, 40), (2, 10), (3, 10)], "key long, n int")
    got = line_dedup.that_may_meet(rows, spark.createDataFrame([(1, 9), (3, 11), (3, 300)], "key long, n int"))
    assert sorted(map(tuple, got.collect())) == [(1, 10), (3, 10)]
    join = next(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in x)
    assert "[met#" in join and "size" not in join


def test_classes_of_far_sizes_do_not_meet(spark, monkeypatch):
    """All classes share one word. Those of sizes that cannot match are not looked at; those that can meet once at least."""
    sizes = [*range(1, 60), 400, 401, 450, 500, 501, 502, 3000]
    rows = spark.createDataFrame([(c, c, n, 0, None, i, 7) for c, n in enumerate(sizes) for i in (0, n // 10)], "hash long, c long, n int, m long, m2 long, i int, key long")
    met, looked = line_dedup.met, []

    def counted(x, y, more):
        looked.append(x.select("key").join(y.select("key"), "key").count())
        return met(x, y, more)

    monkeypatch.setattr(line_dedup, "met", counted)
    got = {tuple(r) for r in line_dedup.candidates_among(rows).collect()}
    assert got == {(a, b) for b, n in enumerate(sizes) for a, k in enumerate(sizes[:b]) if 5 * k >= 4 * n}
    assert looked[0] < (2 * len(sizes)) ** 2 / 2


def test_rare_words_of_full_buckets_are_keys_by_themselves(spark, monkeypatch):
    """In a large corpus each bucket of the histogram counts more than ``COMMON`` by its many rare words. Pairs of them are no keys."""
    lines = [" ".join(f"w{n}x{k}" for k in range(40)) for n in range(30)]
    lines += [" ".join(line.split(" ")[2:] + ["more"]) for line in lines]
    for name, value in (("LEAST_BUCKETS", 4), ("MOST_BUCKETS", 4), ("COMMON", 3), ("EASY", 1000)):
        monkeypatch.setattr(line_dedup, name, value)
    among, held = line_dedup.candidates_among, []
    monkeypatch.setattr(line_dedup, "candidates_among", lambda rows: held.append(rows.count()) or among(rows))
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).agg(F.sum("n_removed")).first()[0]
    assert got == 30 and sum(held) == len(lines) * (40 - 32 + 1) - 30  # 39 words have a prefix of 8


def test_keys_are_met_in_rounds(spark, monkeypatch):
    """Rows of one round's keys alone are shuffled at a time, so those of all keys are never on disk at once."""
    lines = [f"a{n} b{n} c{n} d{n} e{n} f{n}" for n in range(40)]
    lines += [line + " more" for line in lines]
    among, held = line_dedup.candidates_among, []
    monkeypatch.setattr(line_dedup, "EASY", 1000)
    monkeypatch.setattr(line_dedup, "candidates_among", lambda rows: held.append({r.key for r in rows.select("key").collect()}) or among(rows))
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).agg(F.sum("n_removed")).first()[0]
    assert got == 40 and len(held) > 1
    assert max(map(len, held)) < 0.7 * len(set().union(*held)) and sum(map(len, held)) == len(set().union(*held))


def test_plans_hold_the_table_of_rarity_once(spark, texts, monkeypatch):
    """The driver keeps plans as text, with each constant in full: of 65,536 buckets, as at size, a table of longs has over a megabyte."""
    sizes, write = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "LEAST_BUCKETS", line_dedup.MOST_BUCKETS)
    monkeypatch.setattr(line_dedup, "EASY", 0)
    monkeypatch.setattr(line_dedup, "written", lambda df, name: sizes.append((len(df._jdf.queryExecution().executedPlan().toString()), name)) or write(df, name))
    line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {"line-sets", "line-vain", "lines-gone"} <= {name for _, name in sizes}
    assert [name for size, name in sizes if size > 100_000] == ["line-classes"] and max(sizes)[0] < 500_000


def test_masks_miss_no_two_substitutions():
    placed = [{o + p for p in m} for m in decontam.MASKS for o in range(decontam.WINDOW - decontam.SPAN + 1)]
    assert all(any(not s & set(two) for s in placed) for two in combinations(range(decontam.WINDOW), 2))


def test_masks_of_short_items_miss_no_substitution():
    assert sorted(decontam.SHORT_PLACES) == list(range(decontam.LEAST_WORDS, decontam.WINDOW))
    for n, places in decontam.SHORT_PLACES.items():
        placed = [{at + p for p in decontam.SHORT_MASKS[m]} for m, at in places]
        wrong = n - -(-4 * n // 5)
        assert max(at for _, at in places) <= decontam.BEFORE and all(max(p) < n for p in placed)
        assert all(any(not p & set(out) for p in placed) for out in combinations(range(n), wrong)), n


def test_short_items_in_sql(spark, tmp_path):
    import duckdb

    from gridloom.llm import queries

    rng = random.Random(8)
    items = {n: [f"i{n}k{k}" for k in range(n)] for n in range(4, 14)}
    docs, planted = [], set()
    for n, v in items.items():
        for wrong in range(4):
            drawn = set(rng.sample(range(n), wrong))
            w = ["zz" if k in drawn else x for k, x in enumerate(v)]
            planted |= {(len(docs), n)} if n >= 5 and 5 * (n - wrong) >= 4 * n else set()
            docs.append(" ".join(rng.choices(WORDS, k=rng.randint(0, 9)) + w + rng.choices(WORDS, k=rng.randint(0, 9))))
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(v)) for n, v in items.items()], "item_id long, text string")
    got = {tuple(r) for r in decontam.leaks(a, b).select("doc_id", "item_id", "n_windows", "first_word", "last_word", "agreeing").collect()}
    a.toPandas().to_parquet(tmp_path / "d.parquet")
    b.toPandas().to_parquet(tmp_path / "b.parquet")
    with duckdb.connect() as db:
        for name, file in (("documents", "d"), ("benchmark", "b")):
            db.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{file}.parquet'")
        want = set(db.sql(queries.ORACLES["op9_decontaminate"]).fetchall())
    assert got == want and {r[:2] for r in got if r[1] < 12} == {x for x in planted if x[1] < 12}


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks(spark, most):
    rng = random.Random(5)
    items = {i: " ".join(rng.choices(WORDS[:60], k=n)) for i, n in enumerate([3, 5, 8, 11, 12, 13, 30, 40])} | {50: None, 51: "", 52: "w1 w2 w3 w4 w5 w6", 53: " ".join(WORDS[:9]), 54: " ".join(WORDS[:10])}
    docs = {}
    for d in range(60):
        w = rng.choices(WORDS[:60], k=rng.randint(0, 50))
        if d % 2:
            v = items[rng.randrange(8)].split(" ")
            v = [x if rng.random() > 0.12 else "zzz" for x in v]
            w = w + [v[0].upper() + ",", *v[1:]] + w[:5]
        docs[d] = " ".join(w)
    docs |= {103: "w1 w2 w3 w4 w5", 104: "w2 w3 w4 w5 w6", 105: "zz w2 w3 w4 w5 w6", 106: "w0 w1 zz w3 w4 w5 w6 w7 w8", 107: "zz w1 w2 w3 w4 zz w6 w7 w8 w9", 108: "w1 w2 w3"}
    docs |= {100: None, 101: "", 102: items[7] + " " + items[7]}
    decontam.BROADCAST_LONGS = most
    a = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.last_word, r.agreeing) for r in decontam.leaks(a, b).collect()}
    assert got == brute.leaks(docs, items) and got
    kept = {r.doc_id for r in decontam.without_leaks(a, b).collect()}
    decontam.BROADCAST_LONGS = 4_000_000
    assert kept == set(docs) - {d for d, _ in got}
    assert decontam.leaks(a.limit(0), b).count() == decontam.leaks(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("length,span", [(60, 16), (40, 24)])
def test_repeats(spark, length, span):
    rng = random.Random(6)
    letter = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage = [letter(n) for n in (70, 100, 45, 200)]
    texts = [letter(rng.randint(0, 300)) + rng.choice(passage) + letter(rng.randint(0, 80)) for _ in range(40)]
    texts += ["=" * 300, "ab" * 100, texts[0], None, "", "x" * length, "x" * (length - 1), passage[3][5:150] + "Z" + passage[3][80:]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rid int").repartition(3)
    got = {r.doc_id: ([[s["from"], s["to"]] for s in r.spans], bytes(r.kept)) for r in repeats.repeated(df, length=length, span=span).collect()}
    want = {i: x for i, x in enumerate(brute.repeats(texts, length)) if x[0]}
    assert got == want
    assert repeats.repeated(df.limit(0), length=length, span=span).count() == 0
    twice = df.filter("doc_id = 1").union(df.filter("doc_id = 1"))
    assert all(bytes(r.kept) == b"" for r in repeats.repeated(twice, length=length, span=span).collect())


CLASHING = ["_n", "_row", "_h", "_base", "n_lines", "n_removed", "deduped", "_score", "score", "_text", "_gone", "row", "it", "k", "h", "base", "gone", "s", "word", "place", "hash", "key", "fp", "found", "_leaking"]


def test_no_name_of_the_input_clashes(spark, texts):
    import public_tokenizers

    from gridloom.llm import bpe, langid, media, pii, token_fst, toxicity

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHING))
    plain = docs.select("doc_id", "text")
    items = spark.createDataFrame([(1, texts[3])], "item_id long, text string").withColumn("key", F.lit(1))
    labels = plain.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    d = line_dedup.dedup(docs)
    assert same(line_dedup.dedup(plain), d) and {*d.columns} == {*docs.columns} and d.filter("row <> 'row!' or k <> 'k!'").isEmpty()
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and same(simhash.one_of_each(plain), one) and one.filter("row <> 'row!' or it <> 'it!' or _n <> '_n!'").isEmpty()
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns and same(decontam.without_leaks(plain, items), kept)
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and same(toxicity.score(plain, model), scored)
    for run in (
        lambda x: simhash.near_duplicates(x),
        lambda x: repeats.repeated(x, length=40, span=8).select("doc_id", "spans"),
        lambda x: token_fst.token_counts(x, public_tokenizers.path("byte_bpe_50k.json")),
        lambda x: bpe.encode(x, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        lambda x: pii.pseudonymise(x, b"key"),
        lambda x: media.store_texts(x),
        lambda x: langid.predict(x, {}),
        lambda x: decontam.leaks(x, items),
    ):
        assert same(run(plain), run(docs))


@pytest.mark.parametrize("length", [1, 3, 40])
def test_merged_transforms(length):
    rng = random.Random(9)
    some = ["".join(rng.choices("ab", k=rng.randint(0, 90))) for _ in range(20)] + ["", "a" * 200, "abcabc" * 30]
    some += [some[3] + "x" + some[22], some[21]]
    raw = [t.encode() for t in some]
    want = [i for i, _ in brute.repeats(some, length)]
    for cuts in (1, 2, 5):
        shards = [raw[k::cuts] for k in range(cuts)]
        found, rounds, _ = shard_bwt.merged(shards, length)
        assert rounds < length or length == 1
        for k in range(cuts):
            for text, starts, spans in zip(shards[k], found[k], want[k::cuts], strict=True):
                gone = np.zeros(len(text), bool)
                for i in starts:
                    gone[i : i + length] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2).tolist()
                assert edges == spans
