"""Forecasts by linear models with nested expanding folds, as one plan.

All that ridge regression needs of a set of rows are the sums of products of its columns. Folds only ever train on the rows before some rank, so
every training set is a prefix, and every test block the difference of two:

1. Rows are ranked by time in each design, and cut into segments at the edges that any outer or inner fold has.
2. Products are summed by segment, in partial aggregates; running sums over the segments give the moments before each edge.
3. Each inner fold with each penalty is a row: its coefficients come from the moments before its test block, and its squared error from those
   of the block. The best penalty of an outer fold is an aggregate, and its final fit a row again.
4. The test rows of a fold meet their coefficients by a join.

Python solves batches of small systems; rows never go there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.results import stored


def solve(sums: np.ndarray, alpha: np.ndarray, scaled: bool = True) -> np.ndarray:
    """Intercept and coefficients (b, k + 1) of b regressions from their moments (b, k + 2, k + 2) of ``1, x, y``, with ``alpha`` on predictors
    of unit spread (scaled) or on them as they are; where alpha is 0 the least coefficients that fit."""
    n, k = sums[:, 0, 0], sums.shape[1] - 2
    mean = sums[:, 0, 1:] / n[:, None]
    spread = sums[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    std = np.sqrt(np.maximum(np.einsum("bii->bi", spread)[:, :k], 0) / n[:, None]) if scaled else np.ones((len(n), k))
    std = np.where(std < 1e-12, 1, std)
    gram, goal = spread[:, :k, :k] / (std[:, :, None] * std[:, None, :]), spread[:, :k, k] / std
    w = np.zeros((len(n), k))
    plain = alpha == 0
    if k and (~plain).any():
        w[~plain] = np.linalg.solve(gram[~plain] + alpha[~plain, None, None] * np.eye(k), goal[~plain][:, :, None])[:, :, 0]
    if k and plain.any():
        w[plain] = (np.linalg.pinv(gram[plain], rcond=1e-12, hermitian=True) @ goal[plain][:, :, None])[:, :, 0]
    w = w / std
    return np.column_stack([mean[:, k] - (w * mean[:, :k]).sum(axis=1), w])


def _solved(batches: Iterable[pa.RecordBatch], scaled: bool) -> Iterator[pa.RecordBatch]:
    """Adds ``coefs`` by the moments ``before`` and ``sse``, the squared error over the rows up to the moments ``upto``, if there are any."""
    for batch in batches:
        before, upto = batch.column("before"), batch.column("upto")
        coefs: list = [None] * batch.num_rows
        sse: list = [None] * batch.num_rows
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(before.offsets.to_numpy())):
            by_size.setdefault(int(n), []).append(i)
        alpha = batch.column("alpha").to_numpy()
        for n, own in by_size.items():
            side = round(n**0.5)
            sums = np.stack([before[i].values.to_numpy() for i in own]).reshape(-1, side, side)
            w = solve(sums, alpha[own], scaled)
            for row, i in enumerate(own):
                coefs[i] = w[row]
                if upto[i].is_valid:
                    v = np.append(-w[row], 1.0)
                    sse[i] = max(0.0, float(v @ (upto[i].values.to_numpy().reshape(side, side) - sums[row]) @ v))
        rest = [c for c in batch.schema.names if c not in ("before", "upto")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(coefs, pa.list_(pa.float64())), pa.array(sse, pa.float64())], names=[*rest, "coefs", "sse"])


def fitted(cases: DataFrame, scaled: bool) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema if f.name not in ("before", "upto"))
    return cases.mapInArrow(lambda batches: _solved(batches, scaled), f"{kinds}, coefs array<double>, sse double")


def expanding(n: Column, k: int, fold: Column) -> tuple[Column, Column, Column]:
    """``size, start, end`` of a test block of ``n`` rows in ``k`` folds."""
    size = F.floor(n / (k + 1))
    return size, n - (k - fold) * size, n - (k - fold - 1) * size


def forecasts(design: DataFrame, keys: list[str], k: int, inner: int, alphas: list[float], scaled: bool = True) -> DataFrame:
    """``keys, fold, t, y_true, y_pred``: each of ``k`` test blocks predicted from all rows before it, by the penalty with the least mean error
    over ``inner`` expanding blocks of those rows (the first of ``alphas`` where they are too few, or there are no inner blocks; the first of equals).

    design: ``keys, t, y, x`` with a map of predictors by name; a key's predictors are all names that its rows have. Folds are cut from all rows;
    rows without ``y`` or a predictor neither train nor are predicted."""
    named = design.select(*keys, F.explode(F.map_keys("x")).alias("name")).groupBy(*keys).agg(F.sort_array(F.collect_set("name")).alias("names"))
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    own = Window.partitionBy(*keys)
    rows = design.join(named, keys, "left").withColumn("v", F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.try_element_at("x", n).cast("double")))
    rows = rows.select(*keys, "t", F.col("y").cast("double").alias("y"), "v", (known(F.col("y")) & F.forall("v", known)).alias("ok"), (F.row_number().over(own.orderBy("t")) - 1).alias("pos"), F.count("*").over(own).alias("n"))
    rows = rows.withColumn("rank", F.count_if("ok").over(own.orderBy("pos")) - 1).withColumn("zero", F.min_by(F.when(F.col("ok"), F.struct("v", "y")), F.when(F.col("ok"), F.col("pos"))).over(own))
    rows = rows.withColumn("z", F.when(F.col("ok"), F.concat(F.array(F.lit(1.0)), F.zip_with("v", F.col("zero.v"), lambda a, b: a - b), F.array(F.col("y") - F.col("zero.y")))))
    rows = stored(rows, "nested-rows")  # five parts of the plan read them
    # a key's folds: the rows they train on are counted, and their edges are ranks
    starts = [expanding(F.col("n"), k, F.lit(i)) for i in range(k)]
    per_key = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*(F.count_if(F.col("ok") & (F.col("pos") < s[1])) for s in starts)).alias("train"))
    outer = per_key.select(*keys, "n", F.posexplode("train").alias("fold", "train"))
    size, start, end = expanding(F.col("n"), k, F.col("fold"))
    outer = outer.select(*keys, "fold", "train", start.alias("start"), end.alias("end"), size.alias("size")).filter("size > 0 AND train >= 2").drop("size")
    search = inner > 0 and len(alphas) > 1
    ends = [expanding(F.col("train"), inner, F.lit(i))[1:] for i in range(inner)] if search else []
    edges = outer.select(*keys, F.explode(F.array(*(x.cast("long") for pair in ends for x in pair), "train")).alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_set("edge")).alias("edges"))
    cut = rows.filter("ok").join(edges, keys).withColumn("segment", F.size(F.filter("edges", lambda e: e <= F.col("rank")))).filter(F.col("segment") < F.size("edges"))
    products = F.flatten(F.transform("z", lambda a: F.transform("z", lambda b: a * b)))
    sums = cut.select(*keys, "edges", "segment", F.posexplode(products).alias("at", "p")).groupBy(*keys, "edges", "segment", "at").agg(F.sum("p").alias("p"))
    running = sums.withColumn("p", F.sum("p").over(Window.partitionBy(*keys, "at").orderBy("segment")))
    moments = running.groupBy(*keys, "edges", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("s")).select(*keys, F.get("edges", F.col("segment")).alias("edge"), F.col("s.p").alias("sums"))
    moments = stored(moments, "nested-moments")
    at = lambda name, as_: moments.withColumnRenamed("edge", name).withColumnRenamed("sums", as_)
    if search:
        size, start, end = expanding(F.col("train"), inner, F.col("i"))
        blocks = outer.select(*keys, "fold", "train", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("i")).select(*keys, "fold", start.cast("long").alias("a"), end.cast("long").alias("b"), size.alias("size")).filter("size > 0")
        options = F.posexplode(F.array(*(F.lit(float(a)) for a in alphas))).alias("option", "alpha")
        tried = blocks.join(at("a", "before"), [*keys, "a"]).join(at("b", "upto"), [*keys, "b"]).select(*keys, "fold", "size", "before", "upto", options)
        errors = fitted(tried, scaled).groupBy(*keys, "fold", "option", "alpha").agg(F.avg(F.sqrt(F.col("sse") / F.col("size"))).alias("error"))
        outer = outer.join(errors.groupBy(*keys, "fold").agg(F.min_by("alpha", F.struct("error", "option")).alias("best")), [*keys, "fold"], "left")
    else:
        outer = outer.withColumn("best", F.lit(float(alphas[0])))
    last = outer.join(at("train", "before"), [*keys, "train"])
    models = fitted(last.select(*keys, "fold", "start", "end", F.coalesce("best", F.lit(float(alphas[0]))).alias("alpha"), "before", F.lit(None).cast("array<double>").alias("upto")), scaled)
    met = rows.filter("ok").join(models, keys).filter(F.col("pos").between(F.col("start"), F.col("end") - 1))
    terms = F.zip_with("coefs", F.slice("z", 1, F.size("coefs")), lambda a, b: a * b)
    return met.select(*keys, F.col("fold").cast("int").alias("fold"), F.col("t").cast("int").alias("t"), F.col("y").alias("y_true"), (F.col("zero.y") + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).alias("y_pred"))
