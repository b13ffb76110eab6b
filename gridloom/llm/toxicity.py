"""Toxicity: a logistic classifier with a counterfactual penalty.

Features are the presence of words and of their first and last 4 to 6 letters, the most telling of the training rows. Besides the
usual loss, training adds for each labelled text with identity terms its counterfactuals: the same text with those
terms swapped for others of their kind. A difference between the two scores is penalised, so a term for a group weighs
nothing by itself and a neutral mention of a group raises no score.

Defined results: null and empty texts get the score of a text without any known feature; without labelled rows, or with rows
of one label only, every score is the share of toxic rows (0 without rows). Rows with the same id stay separate rows; a
label for an id that occurs more than once counts for each of its rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, sliced, texts, trim, trimmed, written

#: At most so many labelled rows train the classifier: those with the smallest hash of their id.
TRAINING_ROWS = 8_000
FEATURES = 1_024
LEAST_ROWS = 5
BATCH_BYTES = 4_000_000
CACHE_WORDS = 50_000
RIDGE, COUNTERFACTUAL, STEPS = 3e-4, 1.0, 400

#: Groups of terms that may stand for each other.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual"],
    ["transgender", "cisgender"],
    ["immigrant", "native", "refugee"],
    ["immigrants", "natives", "refugees"],
    ["old", "young"],
    ["disabled", "blind", "deaf"],
]
WORDS = re.compile(r"[^\W\d_]+")
_groups = {term: group for group in IDENTITY_TERMS for term in group}


def word_features(word: str) -> list[str]:
    out = [word]
    for k in (4, 5, 6):
        if len(word) > k:
            out += [f"{word[:k]}~", f"~{word[-k:]}"]
    return out


def features_of(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def swapped(words: set[str]) -> list[set[str]]:
    """The word sets of the counterfactual texts: the n-th has each identity term replaced by the n-th next of its kind."""
    held = words & _groups.keys()
    if not held:
        return []
    most = max(len(_groups[w]) for w in held)
    out = []
    for step in range(1, most):
        out.append((words - held) | {(g := _groups[w])[(g.index(w) + step) % len(g)] for w in held})
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    constant: float | None = None  # the score of every text, where nothing could be learned

    def score(self, total: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + total))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int, apart: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
    """Minimise log-loss + ridge + COUNTERFACTUAL * mean squared difference of the logits of a text and its counterfactual.

    apart: of the features in which a pair differs the pair, the feature, and 1 or -1."""
    n, d = x.shape
    w, b = np.zeros(d), math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    pair, feature, sign = apart
    for k in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(x @ w.astype(np.float32) + b)))
        g = x.T @ (p - y).astype(np.float32) / n + RIDGE * w
        if pairs:
            gap = np.bincount(pair, sign * w[feature], minlength=pairs)
            g = g + 2 * COUNTERFACTUAL * np.bincount(feature, sign * gap[pair], minlength=d) / pairs
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * min(1.0, 2 - 2 * k / STEPS)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = TRAINING_ROWS) -> Model:
    """The classifier for ``labels``, from ``most_rows`` labelled rows at most."""
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    chosen = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_rows))
    # an id may occur in many rows
    every = texts(docs, id_col, text_col).join(chosen, "doc_id").select("text", "label", F.xxhash64("doc_id", "text", "label").alias("order")).dropDuplicates(["order"])
    edge = every.select("order").orderBy("order").limit(most_rows).agg(F.max("order")).first()[0]
    rows = written(every.filter(F.col("order") <= F.lit(edge)).select("text", "label"), "toxicity-rows")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, toxic = sum(counts.values()), counts.get(1, 0)
    if not 0 < toxic < n:
        return Model({}, 0.0, toxic / n if n else 0.0)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", BATCH_BYTES):
            held: dict[str, list[int]] = {}
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                for f in features_of(words_of(text)):
                    own = held.setdefault(f, [0, 0])
                    own[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["feature", "clean", "toxic"])

    seen = rows.mapInArrow(trimmed(explode), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(F.col("c") + F.col("t") >= LEAST_ROWS)
    share = (F.col("c") + F.col("t")) / n
    gap = F.abs(F.col("t") / toxic - F.col("c") / (n - toxic)) / F.sqrt(share * (1 - share) + 1e-6)
    vocabulary = [r.feature for r in seen.orderBy(gap.desc(), "feature").limit(FEATURES).collect()]
    vocabulary += sorted({f for term in _groups for f in word_features(term)} - set(vocabulary))
    index = {f: i for i, f in enumerate(vocabulary)}

    def chosen_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a counterfactual only what differs goes to the driver: f + 1 for a feature that the text has alone, -(f + 1) for the other's
        kinds = (pa.list_(pa.int32()), pa.int32(), pa.list_(pa.list_(pa.int32())))
        ids = lambda words: {index[f] for f in features_of(words) if f in index}
        for part in sliced(batches, "text", BATCH_BYTES):
            own, other = [], []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                mine = ids(words)
                own.append(sorted(mine))
                other.append([sorted([f + 1 for f in mine - theirs] + [-f - 1 for f in theirs - mine]) for theirs in map(ids, swapped(words))])
            yield pa.RecordBatch.from_arrays([pa.array(own, kinds[0]), part.column("label"), pa.array(other, kinds[2])], ["f", "label", "other"])

    data = sorted((tuple(r.f), r.label, tuple(map(tuple, r.other))) for r in rows.mapInArrow(trimmed(chosen_features), "f array<int>, label int, other array<array<int>>").collect())
    x, y = np.zeros((len(data), len(index)), np.float32), np.array([r[1] for r in data], float)
    for i, r in enumerate(data):
        x[i, list(r[0])] = 1
    apart = [o for r in data for o in r[2]]
    signed = np.array([f for o in apart for f in o], np.int64)
    pair = np.repeat(np.arange(len(apart)), [len(o) for o in apart])
    drop_written(rows)
    w, b = fit(x, y, len(apart), (pair, np.abs(signed) - 1, np.sign(signed).astype(float)))
    del data, apart, x
    trim()
    return Model({f: float(v) for f, v in zip(vocabulary, w, strict=True) if v}, b)


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with each row's score, over its whole text. A column of ``df`` that has the score's name gives way to it."""
    names = [c for c in df.columns if c.lower() != out_col.lower()]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    schema = df.withColumn(out_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for part in sliced(batches, text_col, BATCH_BYTES):
            out = []
            for text in part.column(text_col).to_pylist():
                active: set[str] = set()
                for w in words_of(text):
                    own = known.get(w)
                    if own is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        own = known[w] = tuple(f for f in word_features(w) if f in model.weights)
                    if own:
                        active.update(own)
                out.append(model.score(sum(model.weights[f] for f in sorted(active))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], [*names, out_col])

    return df.mapInArrow(trimmed(run), schema)
