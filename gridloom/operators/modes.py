"""Spatial modes: EOF, rotated EOF, maximum covariance. After regional selection a mode's matrix is a few hundred square, so the long
table is reduced to one dense group; the reduction to complete cells and anomalies is done before, in plans. The dimension that grows is
never gathered: for tall tables the Gram matrix of the columns is summed where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fix_signs(components: np.ndarray) -> np.ndarray:
    """+1 or -1 for each row: its entry of largest size becomes positive."""
    at = np.abs(components).argmax(axis=1)
    s = np.sign(components[np.arange(len(components)), at])
    return np.where(s == 0, 1, s)


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred Gram matrix of an array column. Partitions sum their own and the parts are added on the cluster, so the
    driver gets columns x columns values; where columns outnumber rows, ``coupled.time_gram`` has the smaller matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0.0, 0.0
        for b in batches:
            col = b.column(0)
            if len(col):
                x = np.asarray(col.flatten(), float).reshape(len(col), -1)
                n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        if n:
            rows = np.vstack([np.full(len(total), float(n)), total, gram])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(total))), pa.array(list(rows), pa.list_(pa.float64()))], ["i", "row"])

    parts = df.select(column).mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = [(r.i, r.j, r.v) for r in cells.toLocalIterator()]
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    k = 1 + max(j for _, j, _ in found)
    whole = np.zeros((k + 2, k))
    for i, j, v in found:
        whole[i + 2, j] = v
    n, mean = int(whole[0, 0]), whole[1] / whole[0, 0]
    return n, mean, whole[2:] - n * np.outer(mean, mean)


def eof(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` unit patterns (rows) and their shares of variance."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    patterns = vectors[:, order[:k]].T
    return patterns * fix_signs(patterns)[:, None], values[order[:k]] / max(values.sum(), 1e-300)


def varimax(loadings: np.ndarray, steps: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Rotated loadings and the orthogonal rotation. loadings: variables x modes."""
    p, k = loadings.shape
    rotation, last = np.eye(k), 0.0
    for _ in range(steps):
        turned = loadings @ rotation
        u, s, v = np.linalg.svd(loadings.T @ (turned**3 - turned * (turned**2).mean(axis=0)))
        rotation = u @ v
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    return loadings @ rotation, rotation


def reof(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated patterns (rows) in the order of the modes they come from, the rotation, and the share in percent that each one's series has
    of the variance of all ``k`` rotated series."""
    patterns, _ = eof(gram, k)
    turned, rotation = varimax(patterns.T)
    turned = turned.T
    signs = fix_signs(turned)
    variance = np.einsum("ij,jk,ik->i", turned, gram, turned)
    return turned * signs[:, None], rotation * signs, 100 * variance / max(variance.sum(), 1e-300)


def mca(cross: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right patterns (rows) and squared covariance fractions in percent of a cross-covariance matrix."""
    u, s, v = np.linalg.svd(cross, full_matrices=False)
    signs = fix_signs(u[:, :k].T)
    return u[:, :k].T * signs[:, None], v[:k] * signs[:, None], 100 * s[:k] ** 2 / max((s**2).sum(), 1e-300)


def scores(df: DataFrame, column: str, keep: list[str], mean: np.ndarray, patterns: np.ndarray, names: list[str]) -> DataFrame:
    """Principal components: each row's projections on the patterns, beside the kept columns."""
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(column).flatten(), float).reshape(b.num_rows, -1)
                y = (x - mean) @ patterns.T
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(y[:, j]) for j in range(y.shape[1]))], [*keep, *names])

    return df.select(*keep, column).mapInArrow(run, schema)


def ec_rotation(pc1, pc2):
    """The east and central indices: E = (pc1 + pc2) / sqrt 2, C = (pc1 - pc2) / sqrt 2. Works for columns and arrays; their signs
    follow those of the components, which ``fix_signs`` settles."""
    return (pc1 + pc2) / 2**0.5, (pc1 - pc2) / 2**0.5
