"""Exact dedup and the filter audit against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, filter_audit

BLANK = ["", " ", "\t\n", "  ", "\u00a0"]


def plain_classes(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(ident)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = ids.index(least)
        out += [(i, least, len(ids), n == kept, sha) for n, i in enumerate(ids)]
    return sorted(map(str, out))


def given_classes(df):
    return sorted(str((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex())) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    some = [*BLANK, None, "a b", "a  b", "a\u000bb", "A b", "a b ", "ａ b", "long " * 30_000, *("w%d x" % i for i in range(40))]
    rows = [(i, rng.choice(some)) for i in range(400)] + [(None, "a b"), (None, "only null"), (None, "only null"), (7, "same id"), (7, "same id"), (7, "same  id"), (3, "other")]
    rows += [(1000 + i, "hot text") for i in range(900)]
    return rows, spark.createDataFrame([(i, t, "x", b"y", 1) for i, t in rows], "doc_id long, text string, digest string, id binary, row int").repartition(7)


@pytest.mark.parametrize("fan,order", [(4, 64), (1, 64), (2, 3)])
def test_classes_equal_brute_force(docs, fan, order):
    rows, df = docs
    got = exact_dedup.classes(df, fan_bits=fan, order_bits=order)
    assert given_classes(got) == plain_classes(rows)


def test_few_groups_are_hot(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 5)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 50)
    assert given_classes(exact_dedup.classes(df)) == plain_classes(rows)


def test_one_row_of_each_group_stays(docs):
    rows, df = docs
    kept = exact_dedup.unique(df)
    assert kept.columns == df.columns
    want = Counter(x.split(", ")[-1] for x in plain_classes(rows) if ", True, " in x)
    got = Counter(f"'{hashlib.sha256(re.sub('[ \t-\r]+', ' ', r.text or '').encode()).hexdigest()}')" for r in kept.collect())
    assert got == want and set(got.values()) == {1}


def test_classes_of_other_ids_and_of_nothing(spark, docs):
    rows, df = docs
    texts = exact_dedup.classes(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert given_classes(texts) == plain_classes([(None if i is None else str(i), t) for i, t in rows])
    assert exact_dedup.classes(df.limit(0)).count() == exact_dedup.unique(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [64, 1, 5])
def test_merge_of_runs(order):
    rng = np.random.default_rng(order)
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(60)]
    digests += [d[:8] + bytes(24) for d in digests[:20]]  # begin like others
    rows = [(digests[i], int(rng.integers(50)), k, int(rng.integers(1, 4))) for k, i in enumerate(rng.integers(80, size=1500))]
    table = lambda part: pa.table({"digest": [r[0] for r in part], "id": [r[1] for r in part], "row": [r[2] for r in part], "n": [r[3] for r in part]})
    runs = [exact_dedup.merge([table(rows[i : i + 100])], order) for i in range(0, 1500, 100)]
    got = exact_dedup.merge(runs, order).to_pylist()
    want = {}
    for d, i, k, n in rows:
        least, total = want.get(d, ((i, k), 0))
        want[d] = (min(least, (i, k)), total + n)
    assert {r["digest"]: ((r["id"], r["row"]), r["n"]) for r in got} == want and len(got) == len(want)
    if order == 64:
        assert [r["digest"] for r in got] == sorted(want)


def plain_audit(rows, labels):
    """rows: id, text, lang."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    cases = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        copy = i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        cases.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {c[0] for c in cases}:
        own, shapley = [c for c in cases if c[0] == part], Counter()
        steps = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [c for c in own if f in c[1] and not c[1] & before]
                shapley[f] += len(gone)
                steps.append((order, step, f, len([c for c in own if not c[1] & (before | {f})]), gone, len([c for c in own if f in c[1] and c[1] & before]), len([c for c in own if c[1] == {f}])))
        for order, step, f, kept, gone, redundant, alone in steps:
            out[part, "".join(order), step + 1] = (kept, len(gone), redundant, alone, sum(c[2] for c in gone), sum(c[3] for c in gone), shapley[f])
    return out


@pytest.mark.parametrize("held,hot", [(32 << 20, 64), (2000, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, held, hot):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    monkeypatch.setattr(filter_audit, "LEAST_HOT", hot)
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(n)}" for _ in range(n))
    some = [None, "", " ", "A B", "#x", "É é", words(99), words(100), "a " * 120, "X" * 50 + " " + words(130), words(300) + " |", "long " * 40_000, "a b c"]
    rows = [(i, rng.choice(some), rng.choice(["en", "fr", None, ""])) for i in range(150)] + [(i, "hot copy", "en") for i in range(200, 400)]
    rows += [(None, "a b", "en"), (None, "A B", "fr"), (5, "twice", "fr"), (5, "twice", "en"), (9, "twice", "fr"), (9, "twice", "fr"), (4, "", "de")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, c, 1, "x", 0) for i, t, c in rows], "doc_id long, text string, lang string, mask int, part string, n int").repartition(6)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == plain_audit(rows, labels)


def test_all_rows_and_bytes_are_observed(spark):
    docs = spark.createDataFrame([("aa",), ("aa",), ("é",), (None,)] * 3 + [("once",)], "text string").repartition(4)
    repeated, rows, size = filter_audit._fingerprints(docs)
    assert (repeated.count(), rows, size) == (3, 13, 3 * (2 + 2 + 2) + 4)
    bits, n = filter_audit._sieve(repeated)
    assert n == filter_audit.LEAST_BITS and sum(bin(w).count("1") for w in bits.tolist()) == 3
    assert all(int(bits[(f := r.fp % (1 << 64)) >> (64 - n) >> 6]) >> ((f >> (64 - n)) & 63) & 1 for r in repeated.collect())


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs.limit(0), none).count() == 0
    got = filter_audit.audit(docs, none).filter("step = 1 AND substr(filter_order, 1, 1) = 'A'").collect()
    assert len(got) == 24 and all((r.part, r.kept, r.removed, r.good_lost, r.shapley) == ("", 0, 1, 0, 120) for r in got)


def test_chains_keep_texts_apart_that_share_a_fingerprint():
    chains = filter_audit.Chains()
    out = []
    for text, ident in [(b"x", 5), (b"y", 4), (b"x", 3), (b"y", 9), (b"z", 1), (b"x", 3)]:
        out += chains.add((77, text, ident, 1, {"en": 1}))
    assert out == [(5, "en", 1 | filter_audit.COPY, 1), (9, "en", 1 | filter_audit.COPY, 1)]
    assert sorted(chains.drain()) == [(77, b"x", 3, 1, {"en": 2}), (77, b"y", 4, 1, {"en": 1}), (77, b"z", 1, 1, {"en": 1})] and not list(chains.drain())


def test_masks_at_the_thresholds():
    of = lambda t: filter_audit.text_mask(t, t.encode())
    hundred = " ".join(f"w{i}" for i in range(100))
    assert of(hundred) == 0 and of(hundred[:-4]) == 1
    assert of(" ".join(f"w{i % 80}" for i in range(100))) == 0 and of(" ".join(f"w{i % 79}" for i in range(100))) == 2
    assert of("A" + "é" * 9) == 1 and of("A" + "é" * 8) == 5 and of("") == 1 and of("€$") == 9
