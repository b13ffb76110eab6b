"""Search for the region whose index has the strongest effect, by a genetic algorithm over rectangles. A generation is evaluated as one
query; the driver holds a population of a few dozen rectangles."""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rect(NamedTuple):
    lat_min: int
    lat_max: int
    lon_min: int
    lon_max: int


class Bounds(NamedTuple):
    lat_min: int
    lat_max: int
    lon_min: int
    lon_max: int
    least_lat: int = 5
    least_lon: int = 10


def valid(r: Rect, b: Bounds) -> bool:
    return b.lat_min <= r.lat_min and r.lat_max <= b.lat_max and b.lon_min <= r.lon_min and r.lon_max <= b.lon_max and r.lat_max - r.lat_min >= b.least_lat and r.lon_max - r.lon_min >= b.least_lon


def valid_column(b: Bounds) -> Column:
    c = F.col
    return (c("lat_min") >= b.lat_min) & (c("lat_max") <= b.lat_max) & (c("lon_min") >= b.lon_min) & (c("lon_max") <= b.lon_max) & (c("lat_max") - c("lat_min") >= b.least_lat) & (c("lon_max") - c("lon_min") >= b.least_lon)


def to_vertices(r: Rect) -> list[tuple[int, int]]:
    return [(r.lon_min, r.lat_min), (r.lon_max, r.lat_min), (r.lon_max, r.lat_max), (r.lon_min, r.lat_max)]


def to_rect(vertices: list[tuple[int, int]]) -> Rect:
    lons, lats = sorted({v[0] for v in vertices}), sorted({v[1] for v in vertices})
    if len(lons) != 2 or len(lats) != 2 or len(set(vertices)) != 4:
        raise ValueError("not an axis-aligned rectangle")
    return Rect(lats[0], lats[1], lons[0], lons[1])


def _fit(r: Rect, b: Bounds) -> Rect:
    """The nearest valid rectangle: clipped to the bounds, then widened to the least size."""

    def side(low: int, high: int, first: int, last: int, least: int) -> tuple[int, int]:
        low, high = sorted((min(max(low, first), last), min(max(high, first), last)))
        grow = max(0, least - (high - low))
        high = min(last, high + grow)
        return min(low, high - least), high

    return Rect(*side(r.lat_min, r.lat_max, b.lat_min, b.lat_max, b.least_lat), *side(r.lon_min, r.lon_max, b.lon_min, b.lon_max, b.least_lon))


def draw(rng: random.Random, b: Bounds) -> Rect:
    return _fit(Rect(rng.randint(b.lat_min, b.lat_max), rng.randint(b.lat_min, b.lat_max), rng.randint(b.lon_min, b.lon_max), rng.randint(b.lon_min, b.lon_max)), b)


#: How far a shift and a move of an edge reach, as shares of the range times the strength, and how often a rule is tried.
SHIFT, EDGE, TRIES = 0.2, 0.3, 100


def mutate(rng: random.Random, r: Rect, b: Bounds, strength: float = 0.2) -> Rect:
    """The rectangle shifted, or one, two or all of its edges moved, by normal steps in proportion to the range; the first valid outcome of
    ``TRIES``, or the rectangle itself."""
    spans = (b.lat_max - b.lat_min, b.lon_max - b.lon_min)
    step = lambda k, reach: round(rng.gauss(0, strength * spans[k // 2] * reach))
    for _ in range(TRIES):
        edges = rng.choice((0, 1, 2, 4))  # 0: a shift
        if edges:
            moved = rng.sample(range(4), edges)
            side = [x + (step(k, EDGE) if k in moved else 0) for k, x in enumerate(r)]
        else:
            lat, lon = step(0, SHIFT), step(2, SHIFT)
            side = [r.lat_min + lat, r.lat_max + lat, r.lon_min + lon, r.lon_max + lon]
        new = Rect(*sorted(side[:2]), *sorted(side[2:]))
        if valid(new, b):
            return new
    return r


def crossover(rng: random.Random, x: Rect, y: Rect, b: Bounds) -> Rect:
    """The latitudes of one and the longitudes of the other, or the rounded means of both; the first parent if no try gives a valid one."""
    for _ in range(TRIES):
        if rng.random() < 0.5:
            a, c = (x, y) if rng.random() < 0.5 else (y, x)
            child = Rect(*a[:2], *c[2:])
        else:
            child = Rect(*(round((p + q) / 2) for p, q in zip(x, y, strict=True)))
        if valid(child, b):
            return child
    return x


def roulette(df: DataFrame, keys: list[str], fitness: str = "fitness") -> DataFrame:
    """``low, high``: the slice of [0, 1) in which a draw picks the row."""
    order = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.nullif(F.sum(fitness).over(Window.partitionBy(*keys)), F.lit(0.0))
    return df.withColumn("high", F.sum(fitness).over(order) / total).withColumn("low", F.col("high") - F.col(fitness) / total)


def spin(rng: random.Random, scored: list[tuple[Rect, float]]) -> Rect:
    total = sum(f for _, f in scored)
    if total <= 0:
        return rng.choice(scored)[0]
    at = rng.random() * total
    for r, f in scored:
        at -= f
        if at <= 0:
            return r
    return scored[-1][0]


def search(evaluate: Callable[[list[Rect]], list[float]], b: Bounds, population: int = 36, generations: int = 6, mutation: float = 0.35, crossing: float = 0.75, seed: int = 42, refinements: int = 100, reach: int = 3) -> tuple[Rect, float, list[float]]:
    """The best rectangle, its fitness, and the best fitness of each generation. The best one always survives; a tenth are immigrants;
    mutation doubles when the population has converged; at last each side is moved by up to ``reach`` while that helps. Fitness is kept
    with its rectangle throughout, whatever order evaluations end in."""
    rng = random.Random(seed)
    known: dict[Rect, float] = {}

    def scored(rects: list[Rect]) -> list[tuple[Rect, float]]:
        new = [r for r in dict.fromkeys(rects) if r not in known]
        known.update(zip(new, evaluate(new), strict=True) if new else ())
        return [(r, known[r]) for r in rects]

    now, history = scored([draw(rng, b) for _ in range(population)]), []
    for _ in range(generations):
        best = max(now, key=lambda x: (x[1], x[0]))
        history.append(best[1])
        mean = sum(f for _, f in now) / len(now)
        spread = (sum((f - mean) ** 2 for _, f in now) / len(now)) ** 0.5
        rate = min(1.0, mutation * (2 if spread < 0.01 else 1))
        nxt = [best[0]] + [draw(rng, b) for _ in range(max(1, population // 10))]
        while len(nxt) < population:
            x, y = spin(rng, now), spin(rng, now)
            child = crossover(rng, x, y, b) if rng.random() < crossing else x
            nxt.append(mutate(rng, child, b) if rng.random() < rate else child)
        now = scored(nxt)
    best = max(now, key=lambda x: (x[1], x[0]))
    tried = 0
    while tried < refinements:
        near = [r for k in range(4) for d in range(-reach, reach + 1) if d and valid(r := Rect(*(x + d * (i == k) for i, x in enumerate(best[0]))), b)]
        near = near[: refinements - tried]
        tried += len(near)
        top = max(scored(near), key=lambda x: (x[1], x[0]), default=best)
        if top[1] <= best[1]:
            break
        best = top
    history.append(best[1])
    return best[0], best[1], history


def region_means(field: DataFrame, rects: list[Rect], time: str = "t") -> DataFrame:
    """``id, t, value``: the area-weighted mean of each rectangle, for a whole generation in one pass."""
    from gridloom.operators.grid import weighted_mean

    spark = field.sparkSession
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rects)], "id int, lat_min double, lat_max double, lon_min double, lon_max double")
    cells = field.select("lat", "lon").distinct().join(F.broadcast(table), F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))).select("id", "lat", "lon")
    return field.join(cells, ["lat", "lon"]).groupBy("id", time).agg(weighted_mean(F.col("value"), F.col("lat")).alias("value"))


def causal_fitness(fields: DataFrame, panel: DataFrame | pd.DataFrame, rects: list[Rect], target: str, lag: int, right: tuple[str, ...] = (), mode: int = 1, rotated: int = 7, alpha: float = 0.05, most: int = 6) -> DataFrame:
    """``id, effect``: how strongly the index that each rectangle gives acts on the target ``lag`` steps later, in size, 0 if it gives none.

    The index is the standardised component of a rotated mode of ``value`` in the rectangle, or with ``right`` (one column for a scalar,
    two for a vector) the left component of a coupled mode. It joins the panel, and the graph's effect of it on the target is measured.
    fields: ``lat, lon, t, value`` and the columns ``right``; panel: ``t, var, value, masked``, a few hundred rows that travel with the
    plan (as a pandas frame they are fetched once for many calls). A rectangle is a group: cells of a region x times."""
    from gridloom.operators import coupled, modes, pcmci

    table = fields.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rects)], "id int, lat_min double, lat_max double, lon_min double, lon_max double")
    at = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    cells = fields.select("lat", "lon").distinct().join(F.broadcast(table), at).select("id", "lat", "lon")
    held = fields.join(cells, ["lat", "lon"]).select("id", "lat", "lon", "t", "value", *right)
    known = panel if isinstance(panel, pd.DataFrame) else panel.select("t", "var", "value", "masked").toPandas()
    wide = known.pivot(index="t", columns="var", values="value").sort_index()
    hidden = known.pivot(index="t", columns="var", values="masked").sort_index().fillna(False).astype(bool)

    def matrix(pdf: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Times x complete cells, standardised and weighted, and the times."""
        m = pdf.pivot(index="t", columns=["lat", "lon"], values=column).sort_index()
        m = m.loc[:, m.notna().all()]
        x = m.to_numpy(float)
        std = x.std(axis=0)
        weight = np.sqrt(np.maximum(np.cos(np.radians(np.array([c[0] for c in m.columns]))), 0))
        return ((x - x.mean(axis=0)) / np.where(std < 1e-12, 1, std))[:, std >= 1e-12] * weight[std >= 1e-12], m.index.to_numpy()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = matrix(pdf, "value")
        effect = 0.0
        if x.shape[1] and len(t) > most + 3:
            if right:
                parts = [matrix(pdf, c) for c in right]
                y = np.concatenate([m for m, times in parts if len(times) == len(t)] or [np.zeros((len(t), 0))], axis=1)
                pcs = coupled.maximum_covariance(x @ x.T, y @ y.T, mode).left if y.shape[1] else np.zeros((len(t), 0))
            else:
                pcs = x @ modes.reof(x.T @ x, min(rotated, *x.shape))[0].T
            if pcs.shape[1] >= mode and pcs[:, mode - 1].std() > 1e-12:
                pc = pcs[:, mode - 1]
                data = wide.join(pd.Series((pc - pc.mean()) / pc.std(), index=t, name="#region"), how="inner")
                mask = hidden.reindex(data.index).to_numpy(bool)
                lagged = pcmci.Lagged(np.nan_to_num(data.to_numpy(float)), np.column_stack([mask, np.zeros(len(data), bool)]), most)
                names = list(data.columns)
                effect = abs(pcmci.effect_of(lagged, names.index("#region"), lag, names.index(target), alpha)[0])
        return pd.DataFrame([(key[0], effect if np.isfinite(effect) else 0.0)], columns=["id", "effect"])

    return held.groupBy("id").applyInPandas(one, "id int, effect double")


def fitness_of(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name, effect``: the size of the wanted edges' effects, 0 where an edge is missing or has none. wanted: ``name, cause, effect, lag``;
    edges: ``cause, effect, lag, causal_effect``."""
    held = edges.select("cause", "effect", "lag", F.abs("causal_effect").alias("_size")).dropDuplicates(["cause", "effect", "lag"])
    return wanted.join(held, ["cause", "effect", "lag"], "left").select("name", F.coalesce(F.nanvl("_size", F.lit(0.0)), F.lit(0.0)).alias("effect"))
