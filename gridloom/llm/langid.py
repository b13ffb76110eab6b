"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its letters' vectors, the
first rotated by two places, the second by one. A text's vector bundles (sums) the vectors of its trigrams, a language's prototype
bundles the vectors of its training texts, each of length one. A text gets the language whose prototype has the largest cosine with it.

Runs of characters that are no letters count as one separator with a vector of its own. Texts are lower-cased.

Defined results: a text that is null, empty or without letters gets ``und`` with score 0; without any training row every text does.
Ties go to the first language in alphabetical order. Rows with the same id stay separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import sliced, texts, trimmed

DIMENSIONS = 1024
SEED = 20_240_731
BATCH_BYTES = 1_000_000
BATCH_ROWS = 256
#: At most so many documents train the prototypes: those with the smallest hash of their id.
TRAINING_ROWS = 4_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True at the code points of letters."""
    import regex

    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"\p{L}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))]] = True
    return out


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


def text_vectors(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter."""
    n = len(values)
    joined = "".join(f" {v.lower().replace(chr(10), ' ')}\n" for v in values)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(codes == 10) - (codes == 10)
    letter = letters()[codes]
    has = np.bincount(doc[letter], minlength=n)[:n] > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the separator after a letter
    keep[np.flatnonzero(np.diff(doc, prepend=-1))] = True  # and the one in front of a text
    seq, doc = np.where(letter, codes, 0)[keep], doc[keep]
    alphabet, small = np.unique(seq, return_inverse=True)
    ok = (doc[2:] == doc[:-2]) & (seq[1:-1] != 0) if len(seq) > 2 else np.zeros(0, bool)
    a, b, c, doc = small[:-2][ok].astype(np.int64), small[1:-1][ok], small[2:][ok], doc[2:][ok]
    size = len(alphabet)
    key = (a * size + b) * size + c
    if size**3 <= 8_000_000:
        present = np.flatnonzero(np.bincount(key, minlength=1))
        lookup = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
        lookup[present] = np.arange(len(present))
        at = lookup[key]
    else:
        present, at = np.unique(key, return_inverse=True)
    base = np.stack([letter_vector(int(x)) for x in alphabet]) if size else np.zeros((0, DIMENSIONS), np.int8)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for i in range(0, len(present), 4096):  # so many trigrams at a time
        part = present[i : i + 4096]
        bound = twice[part // size**2] * once[part // size % size] * base[part % size]
        own = (at >= i) & (at < i + 4096)
        counts = np.bincount(doc[own] * len(part) + at[own] - i, minlength=n * len(part)).reshape(n, len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, has


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sliced(batches, "text", BATCH_BYTES):
        for i in range(0, part.num_rows, BATCH_ROWS):
            yield part.slice(i, BATCH_ROWS)


def learn(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language, from the distinct rows of ``df`` with a language, ``most_rows`` at most."""
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang")).filter("lang is not null and text is not null")
    order = F.xxhash64("doc_id", "lang", "text")
    edge = rows.select(order.alias("h")).orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in small_batches(batches):
            vectors, has = text_vectors(part.column("text").to_pylist())
            for lang, v, ok in zip(part.column("lang").to_pylist(), unit(vectors), has, strict=True):
                if ok:
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    out: dict[str, np.ndarray] = {}
    for lang, v in sorted(tuple(r) for r in rows.filter(order <= edge).dropDuplicates(["doc_id", "lang", "text"]).select("text", "lang").mapInArrow(trimmed(run), "lang string, v binary").collect()):
        out[lang] = out.get(lang, 0) + np.frombuffer(bytes(v))
    return {lang: unit(v).astype(np.float32) for lang, v in out.items()}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the language with the nearest prototype and that cosine (0 if negative)."""
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            vectors, has = text_vectors(part.column("text").to_pylist())
            if names:
                near = unit(vectors) @ matrix.T
                best = near.argmax(axis=1)
                score = np.where(has, np.clip(near[np.arange(len(best)), best], 0, 1), 0).astype(float)
                said = [names[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
            else:
                score, said = np.zeros(part.num_rows), ["und"] * part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(said), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double")
