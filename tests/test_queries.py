"""Every query of the registry against its SQL twin, on the smallest tables."""

import pytest

from gridloom.plans import causal, climate, programs, registry, sinks  # noqa: F401
from jobs import queries  # noqa: F401
from tests.compare import TABLES, of_spark, of_sql

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    got = of_spark(registry.QUERIES[name](spark, DATA))
    assert got == of_sql(registry.ORACLES[name], {t: f"{DATA}/{t}.parquet" for t in TABLES})


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"ga_search"}))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["pcmci_edges", "pcmci_fdr", "pcmci_sliding"])
def test_causal_queries_run_all_lags_and_sets(spark, name, monkeypatch):
    asked = []
    discover = causal.pcmci.discover
    monkeypatch.setattr(causal.pcmci, "discover", lambda *a, **b: asked.append(b) or discover(*a, **b))
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert {r.lag for r in rows} == {1, 2, 3, 4, 5, 6} and all(b.get("most_sets", 10) == 10 for b in asked) and asked


def test_ga_search_evaluates_whole_generations(spark, monkeypatch):
    sizes = []
    fitness = causal.region_search.causal_fitness
    monkeypatch.setattr(causal.region_search, "causal_fitness", lambda field, panel, rects, *a: sizes.append(len(rects)) or fitness(field, panel, rects, *a))
    assert registry.QUERIES["ga_search"](spark, DATA).first().fitness > 0
    assert sizes[0] == 36 and len(sizes) >= 8 and sum(sizes) > 150


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
