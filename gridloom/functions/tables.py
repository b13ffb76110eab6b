"""Table functions: called from SQL on a table, a partition of it at a time.

    SELECT * FROM regression(TABLE(yx), 'cell', 'y', 'x, x2')

``register`` makes them known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from gridloom.operators import cells


def names(argument: AnalyzeArgument, what: str) -> list[str]:
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a constant string")
    return [x.strip() for x in argument.value.split(",")]


class Regression:
    """``keys, predictor, coef, p_value, r2, n``: least squares with a constant in each group of the keys. Steps with a missing value do not
    count; NULL below k + 2 of them. The arguments are the table, its keys, the response and the predictors; Spark deals the table out by the keys and
    hands over just the columns that are named, so the call needs no PARTITION BY."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.rows: list[tuple] = []
        self.key: tuple | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, y: AnalyzeArgument, predictors: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        own, goal, given = names(keys, "keys"), names(y, "the response"), names(predictors, "predictors")
        known = {f.name: f.dataType for f in table.dataType.fields}
        if lost := [c for c in [*own, *goal, *given] if c not in known]:
            raise ValueError(f"the table has no column {', '.join(lost)}; it has {', '.join(known)}")
        if len(goal) != 1 or {*goal, *given} & {*own}:
            raise ValueError("one response, and no key among the series")
        schema = StructType()
        for c in own:
            schema = schema.add(c, known[c])
        schema = schema.add("predictor", StringType()).add("coef", DoubleType()).add("p_value", DoubleType()).add("r2", DoubleType()).add("n", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(f"`{c}`") for c in own], select=[SelectedColumn(f"`{c}`") for c in dict.fromkeys([*own, *goal, *given])])

    def eval(self, row: Row, keys: str, y: str, predictors: str) -> None:
        if self.key is None:
            self.key = tuple(row[c.strip()] for c in keys.split(","))
            self.given = [c.strip() for c in predictors.split(",")]
        self.rows.append(tuple(row[c] for c in (y.strip(), *self.given)))

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        data = np.array([[np.nan if v is None else float(v) for v in r] for r in self.rows])
        data = data[np.isfinite(data).all(axis=1)]
        fit = cells.ols(data[:, :1], data[:, 1:])
        clean = lambda v: None if np.isnan(v) else float(v)
        for i, p in enumerate(self.given):
            yield (*self.key, p, clean(fit.coef[i, 0]), clean(fit.p[i, 0]), clean(fit.r2[0]), len(data))


def register(spark: SparkSession) -> None:
    spark.udtf.register("regression", udtf(Regression))
