"""Causal runs by target: as many units of work as targets, the same rows as one group a run, failures as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pcmci

SCHEMA = "run int, alpha double, t int, var string, value double, masked boolean"


def panel(spark, runs, n=70, spoil=None):
    rows = []
    for r in range(runs):
        v = np.random.default_rng(r).normal(size=(n, 3))
        v[2:, 1] += 0.8 * v[:-2, 0]
        if r == spoil:
            v[5, 0] = np.inf
        rows += [(r, 0.05 / (r + 1), t, f"v{k}", None if (t, k) == (9, 2) else float(v[t, k]), t % 11 == 0 and k == 1) for t in range(n) for k in range(3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def plain(rows, run, most_sets=10):
    own = [x for x in rows if x[0] == run]
    n = max(x[2] for x in own) + 1
    values, hidden = np.zeros((n, 3)), np.zeros((n, 3), bool)
    for _, _, t, var, v, m in own:
        values[t, int(var[1])], hidden[t, int(var[1])] = v or 0.0, m
    data = pcmci.Lagged(values, hidden, 6)
    parents = {j: pcmci.select_parents(data, j, own[0][1], 1, most_sets) for j in range(3)}
    return {(f"v{i}", f"v{j}", lag): (r, p) for j in range(3) for i, lag, r, p in pcmci.momentary(data, parents, j, 1)}


def test_targets_give_the_rows_of_whole_runs(spark):
    df, rows = panel(spark, 2)
    got = pcmci.discover(df, ["run"]).collect()
    for run in range(2):
        want = plain(rows, run)
        mine = {(r.cause, r.effect, r.lag): (r.causal_effect, r.p_value) for r in got if r.run == run}
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in want)
    only = pcmci.discover(df, ["run"], targets=["v1"]).collect()
    assert {r.effect for r in only} == {"v1"} and len(only) == 36
    adjusted = {(r.cause, r.effect, r.lag): r.p_value for r in pcmci.discover(df.filter("run = 0"), ["run"], fdr=True).collect()}
    p = np.array(sorted(v[1] for v in plain(rows, 0).values()))
    q = np.minimum(np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    assert sorted(adjusted.values()) == pytest.approx(q)


def test_units_are_spread(spark):
    df, _ = panel(spark, 1)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        used = pcmci.attempts(df, ["run"]).select(F.spark_partition_id().alias("p"), "target").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(used) == 3 and len({r.p for r in used}) > 1


def test_a_run_that_fails_leaves_the_others(spark):
    df, rows = panel(spark, 4, spoil=2)
    tried = pcmci.attempts(df, ["run"])
    got = {r.run: (r.ok, r.tests, r.error) for r in pcmci.outcomes(tried, ["run"]).collect()}
    assert got == {r: (False, 0, "v0 is infinite at step 5") if r == 2 else (True, 54, None) for r in range(4)}
    edges = pcmci.discover(df, ["run"]).groupBy("run").count().collect()
    assert {r.run: r["count"] for r in edges} == {0: 54, 1: 54, 3: 54}
    assert pcmci.discover(df.limit(0), ["run"]).count() == 0 == pcmci.outcomes(pcmci.attempts(df.limit(0), ["run"]), ["run"]).count()


def test_a_test_that_fails_is_told(spark, monkeypatch):
    df, _ = panel(spark, 1)
    got = pcmci.outcomes(pcmci.attempts(df, ["run"], test="no such test"), ["run"]).first()
    assert not got.ok and "no such test" in got.error


class Difference:
    """A test of one's own: the effect is the difference of means, and it always counts."""

    def __call__(self, x, y, z):
        return float(x.mean() - y.mean()), 0.0


def test_tests_are_found_by_module_and_name(spark):
    df, _ = panel(spark, 1)
    rows = pcmci.discover(df, ["run"], targets=["v0"], most=2, test="tests.test_causal:Difference").collect()
    assert len(rows) == 6 and {r.p_value for r in rows} == {0.0} and len({r.causal_effect for r in rows}) > 1
