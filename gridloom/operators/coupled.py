"""Modes of one field or of two coupled fields whose cells outnumber their times. Cells stay where they are: only times x times matrices
are summed, and patterns are projections of each cell's own series."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid, season, stats


def prepared(df: DataFrame, cell: list[str], signal: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    """``cell, season, value, weight``: a regional field without a signal (a cell with gaps keeps it), standardised by calendar month,
    weighted by the root of the cosine of latitude. df: ``cell`` (with ``lat``), ``season, value``; signal: ``season, value``."""
    if signal is not None:
        both = df.join(F.broadcast(signal.select("season", F.col("value").alias("_x"))), "season", "left")
        df = stats.remove_unless_gaps(both, cell, "_x", "value", "value").drop("_x")
    scaled = season.zscore_month(df, cell, ddof=ddof)
    weight = grid.sqrt_weight(F.col("lat"))
    return scaled.select(*cell, "season", (F.col("z") * weight).alias("value"), weight.alias("weight"))


def series(df: DataFrame, cell: list[str], n: int) -> DataFrame:
    """``cell, weight, x``: the cells that have a value at all ``n`` times, each as an array in order of time."""
    held = df.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = held.groupBy(*cell).agg(F.any_value("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("season", "value"))).alias("s"))
    return rows.filter(F.size("s") == n).select(*cell, "weight", F.col("s.value").alias("x"))


def time_gram(df: DataFrame, n: int) -> np.ndarray:
    """The sum over cells of the products of all pairs of times, of anomalies in time. Partitions sum their own; the parts are added on the
    cluster, so the driver gets n x n values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, n)
                x = x - x.mean(axis=1, keepdims=True)
                gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "row"])

    parts = df.select("x").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((n, n))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = r.v
    return out


def root(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and singular values of the matrix times x cells with that Gram matrix; those near 0 are cut."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    keep = values > max(values[0], 0) * 1e-12
    return vectors[:, keep], np.sqrt(values[keep])


class Modes(NamedTuple):
    """Times x modes: principal components of either side, the projections that give the patterns, and percentages."""

    left: np.ndarray
    right: np.ndarray
    left_projection: np.ndarray
    right_projection: np.ndarray
    percent: np.ndarray


def maximum_covariance(left: np.ndarray, right: np.ndarray, k: int) -> Modes:
    """The first ``k`` modes of two fields from their Gram matrices over time. The cross-covariance has the singular values of a matrix
    no larger than times x times."""
    (u, s), (w, t) = root(left), root(right)
    p, d, q = np.linalg.svd((s[:, None] * (u.T @ w)) * t, full_matrices=False)
    k = min(k, int((d > d[:1].max(initial=0) * 1e-12).sum()))
    a, b = (u * s) @ p[:, :k], (w * t) @ q[:k].T
    signs = np.sign(a[np.abs(a).argmax(axis=0), np.arange(k)])
    signs[signs == 0] = 1
    return Modes(a * signs, b * signs, (u / s) @ p[:, :k] * signs, (w / t) @ q[:k].T * signs, 100 * d[:k] ** 2 / max((d**2).sum(), 1e-300))


def principal(gram: np.ndarray, k: int) -> Modes:
    """The first ``k`` modes of one field, both sides alike; percentages of the variance."""
    u, s = root(gram)
    signs = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    u = u * np.where(signs == 0, 1, signs)
    a, g = (u * s)[:, :k], (u / s)[:, :k]
    return Modes(a, a, g, g, 100 * s[:k] ** 2 / max((s**2).sum(), 1e-300))


def inflated(cells: DataFrame, cell: list[str], projection: np.ndarray, pcs: np.ndarray, ddof: int = 0) -> DataFrame:
    """``cell, mode, pattern``: each mode's pattern on its cells without the weights, times the deviation of its component. cells: ``series``."""
    scale = pcs.std(axis=0, ddof=ddof)
    fields = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten(), float).reshape(b.num_rows, -1)
                weight = np.asarray(b.column("weight"), float)[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = (x - x.mean(axis=1, keepdims=True)) @ projection / weight * scale
                p = np.where(np.isfinite(p), p, np.nan)
                k = p.shape[1]
                take = np.repeat(np.arange(b.num_rows), k)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(take)) for c in cell), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(p.ravel(), from_pandas=True)], [*cell, "mode", "pattern"])

    return cells.mapInArrow(run, f"{fields}, mode int, pattern double")


def components(spark, seasons: list, modes: Modes) -> DataFrame:
    """``season, mode, left, right``: the components, standardised by calendar month."""
    rows = [(s, m + 1, float(modes.left[i, m]), float(modes.right[i, m])) for i, s in enumerate(seasons) for m in range(modes.left.shape[1])]
    df = spark.createDataFrame(rows, "season date, mode int, left double, right double")
    for side in ("left", "right"):
        df = season.zscore_month(df, ["mode"], side, side)
    return df


def mca(left: DataFrame, right: list[DataFrame], cell: list[str], k: int = 4, ddof: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame], np.ndarray]:
    """Components, the pattern of the left field, those of the right fields (one for a scalar, two for a vector whose parts are taken
    together), and squared covariance fractions in percent. Fields are ``prepared``; times are those that all have."""
    common = left.select("season").distinct()
    for r in right:
        common = common.join(r.select("season").distinct(), "season")
    seasons = [r.season for r in common.orderBy("season").collect()]
    n, at = len(seasons), F.broadcast(common)
    a, bs = series(left.join(at, "season"), cell, n), [series(r.join(at, "season"), cell, n) for r in right]
    modes = maximum_covariance(time_gram(a, n), sum(time_gram(b, n) for b in bs), k)
    patterns = [inflated(b, cell, modes.right_projection, modes.right, ddof) for b in bs]
    return components(left.sparkSession, seasons, modes), inflated(a, cell, modes.left_projection, modes.left, ddof), patterns, modes.percent


def cold_tongue(sst: DataFrame) -> DataFrame:
    """``season, value``: the area mean over 6S-6N, 180-90W, standardised by calendar month. sst: ``lat, lon`` (any convention), ``season, value``."""
    box = sst.filter(F.col("lat").between(-6, 6) & grid.lon_360(F.col("lon")).between(180, 270))
    return season.zscore_month(grid.area_mean(box, ["season"]), [], out="value")


def drive(sst: DataFrame, u: DataFrame, v: DataFrame, box: tuple[float, float, float, float], cell: list[str], k: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """The meridional-mode driver, from fields to modes: the cold tongue's signal is taken out of all fields in the box, they are standardised
    by calendar month and weighted, and the surface temperature is coupled with both wind components together. Wind cells count where both
    components are known at all times.

    Gives the components ``season, mode, left, right``, the pattern of the temperature, those of both winds ``cell, mode, u, v``, and the squared
    covariance fractions. Fields: ``cell`` (with ``lat, lon``), ``season, value``; box: lat_min, lat_max, lon_min, lon_max."""
    signal = cold_tongue(sst)
    left, *winds = (prepared(f.filter(grid.in_box(*box)), cell, signal) for f in (sst, u, v))
    known = lambda w: w.groupBy(*cell).agg(F.count_if(F.col("value").isNotNull() & ~F.isnan("value")).alias("n"))
    both = known(winds[0]).join(known(winds[1]), [*cell, "n"]).select(*cell)
    parts, pattern, patterns, percent = mca(left, [w.join(both, cell, "left_semi") for w in winds], cell, k)
    own = [p.withColumnRenamed("pattern", n) for p, n in zip(patterns, "uv", strict=True)]
    return parts, pattern, own[0].join(own[1], [*cell, "mode"]), percent
