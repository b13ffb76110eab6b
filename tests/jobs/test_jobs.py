"""The jobs on growing and on odd input, stopped and run again."""

import datetime
import logging
import math
import random
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

from gridloom.sources import progress
from jobs import index_update, text_ledger

BASE = ("1996-01-01", "1999-12-31")
ROOT = Path(__file__).resolve().parents[2]


def observations(rng, n, first, days):
    start = datetime.datetime(first, 1, 1)
    return [(i, rng.randrange(1, 40), start + datetime.timedelta(days=rng.randrange(days)), float(rng.randrange(1000))) for i in range(n)]


ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double"


@pytest.fixture
def tables(spark, tmp_path):
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")
    put([(c, c % 7) for c in range(1, 38)] + [(38, 99), (None, 3)], "c_custkey long, c_nationkey long", "customer")
    put([(n, n % 3) for n in range(7)], "n_nationkey long, n_regionkey long", "nation")
    put([(0, "ASIA "), (1, "EUROPE"), (2, "AFRICA")], "r_regionkey long, r_name string", "region")
    return str(tmp_path)


def add_orders(spark, tables, rows):
    spark.createDataFrame(rows, ORDERS).coalesce(1).write.mode("append").parquet(f"{tables}/in/orders.parquet")


def plain_index(rows):
    months = defaultdict(list)
    for _, cust, t, v in rows:
        if t is not None and v is not None and cust is not None and cust < 38:
            months[cust % 7, t.year, t.month].append(v)
    seasons = defaultdict(list)
    for (cell, y, m), v in months.items():
        k = y * 12 + m  # December is the first month of its season
        seasons[cell, datetime.date(k // 3 * 3 // 12, k // 3 * 3 % 12 + 1, 1)].append(sum(v) / len(v))
    regions = defaultdict(list)
    for (cell, s), v in seasons.items():
        regions[s, ("ASIA", "EUROPE", "AFRICA")[cell % 3]].append((sum(v) / len(v), math.cos(math.radians(-60 + 5 * cell))))
    value = {k: sum(v * w for v, w in x) / sum(w for _, w in x) for k, x in regions.items()}
    out = {}
    for (s, name), v in value.items():
        base = [u for (r, n), u in value.items() if n == name and r.month == s.month and BASE[0] <= str(r) <= BASE[1]]
        out[s, name] = (pytest.approx(v), pytest.approx(v - sum(base) / len(base)) if base else None, len(regions[s, name]))
    return out


def as_dict(df):
    rows = df.collect()
    assert len({(r.season, r.name) for r in rows}) == len(rows) and all(r.year == r.season.year for r in rows)
    return {(r.season, r.name): (r.value, r.anom, r.cells) for r in rows}


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_index_takes_only_new_files(spark, tables, caplog):
    rng = random.Random(3)
    first, second, third = observations(rng, 900, 1995, 2000), observations(rng, 300, 1999, 900), observations(rng, 100, 2004, 200)
    first += [(1, None, datetime.datetime(1996, 1, 1), 1.0), (2, 3, None, 5.0), (3, 3, datetime.datetime(1996, 1, 1), None), (4, 38, datetime.datetime(1996, 1, 1), 9.0)]
    run = lambda: index_update.run(spark, f"{tables}/in", f"{tables}/out", f"{tables}/state", {"base": BASE, "files_per_batch": 1})
    caplog.set_level(logging.INFO)
    seen, said = [], lambda: [int(x) for x in re.findall(r"(\d+) observations read", caplog.text)]
    for rows in (first, second, third):
        add_orders(spark, tables, rows)
        seen += rows
        assert as_dict(run()) == plain_index(seen)
    usable = [sum(None not in r and r[1] < 39 for r in rows) for rows in (first, second, third)]
    assert said() == usable and caplog.text.count("all years of") == 2 and caplog.text.count("their years of") == 1
    years = [{p.parent.parent.name for p in Path(tables, "state/sums").rglob("*.parquet") if p.parent.name == f"batch={b}"} for b in range(3)]
    assert "year=2004" in years[2] and "year=1996" not in years[2]
    before = files(f"{tables}/out")
    assert as_dict(run()) == plain_index(seen) and said() == usable and files(f"{tables}/out") == before


def test_index_after_a_crash(spark, tables, monkeypatch):
    rng = random.Random(4)
    rows = observations(rng, 400, 1996, 1500)
    for part in (rows[:150], rows[150:]):
        add_orders(spark, tables, part)
    run = lambda: index_update.run(spark, f"{tables}/in", f"{tables}/out", f"{tables}/state", {"base": BASE, "files_per_batch": 1})
    publish, calls = progress.publish, []

    def stops(df, path, by):
        calls.append(path)
        if len(calls) == 4:  # the second batch's index, after its sums were written
            raise RuntimeError("killed")
        publish(df, path, by)

    monkeypatch.setattr(progress, "publish", stops)
    with pytest.raises(Exception, match="killed"):
        run()
    assert as_dict(run()) == plain_index(rows) and [c.rsplit("/", 1)[1] for c in calls] == ["sums", "index", "sums", "index", "sums", "index"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, md5 string"
ODD = [("fine words", "en", 10), (None, "en", 0), (None, None, None), ("", "en", 0), ("", "en", 1), ("12345 7", "en", 7), ("a\u0001b", "en", 3), ("x�", " ", 2), ("tab\tand\nline\r", "de", 13), ("y" * 30 + "\nz", "fr", 32), ("ééé", "fr", 6), ("a1", "en", 2)]


def plain_ledger(rows):
    import hashlib

    out, by = {}, defaultdict(list)
    for i, text, lang, source, n, _ in rows:
        t = text or ""
        told = ["no_text"] * (text is None) + ["empty"] * (text == "") + ["length"] * (n != len(t)) + ["control"] * bool(re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", t)) + ["replaced"] * ("�" in t)
        told += ["letters"] * (len(t) > 0 and sum(c.isalpha() for c in t) < 0.5 * len(t)) + ["line"] * any(len(x) > 25 for x in t.split("\n")) + ["no_lang"] * (not (lang or "").strip(" "))
        by[source].append(not told)
        out[i] = (lang, len(t.encode()), 0 if text is None else t.count("\n") + 1, None if text is None else hashlib.md5(t.encode()).hexdigest(), ",".join(told), source)
    return {i: (*x[:5], x[4] == "", len(by[x[5]]), by[x[5]].count(False), 0 if all(by[x[5]]) else 2 if any(by[x[5]]) else 1) for i, x in out.items()}


def given_ledger(df):
    rows = df.collect()
    out = {r.doc_id: (r.lang, r.n_bytes, r.n_lines, r.md5, r.problems, r.ok, r.total, r.failed, r.exit_code) for r in rows}
    assert len(out) == len(rows)
    return out


def test_ledger_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, *ODD[i % len(ODD)][:2], rng.choice(["a", "b", "c", None]), ODD[i % len(ODD)][2], "x") for i in range(100)] + [(200 + i, "good", "en", "all good", 4, None) for i in range(3)] + [(300, None, "en", "all bad", 0, None)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/in/documents.parquet")
    config = {"least_letters": 0.5, "longest_line": 25, "sources_at_once": 2}
    run = lambda: text_ledger.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    publish, calls = progress.publish, []

    def stops(df, path, by):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("killed")
        publish(df, path, by)

    monkeypatch.setattr(progress, "publish", stops)
    with pytest.raises(RuntimeError):
        run()
    first = files(f"{tmp_path}/out/ledger")
    assert first and given_ledger(run()) == plain_ledger(rows) and len(calls) == 4
    now = files(f"{tmp_path}/out/ledger")
    assert first.items() <= now.items()  # what was done is not done again
    assert given_ledger(run()) == plain_ledger(rows) and files(f"{tmp_path}/out/ledger") == now and len(calls) == 4
    rows += [(500, "more", "en", "b", 4, None), (501, "new", "en", "new source", 3, None)]
    spark.createDataFrame(rows[-2:], DOCS).write.mode("append").parquet(f"{tmp_path}/in/documents.parquet")
    assert given_ledger(run()) == plain_ledger(rows) and len(calls) == 5
    kept = {p for p in now if "source=b/" not in p}
    assert kept <= set(files(f"{tmp_path}/out/ledger"))


def test_ledger_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/in/documents.parquet")
    assert text_ledger.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"least_letters": 0.5, "longest_line": 25}).count() == 0


@pytest.mark.parametrize("job,paths", [("index_update", ["target", "checkpoint"]), ("text_ledger", ["target"])])
def test_command_lines(spark, tmp_path, job, paths):
    args = [x for p in paths for x in (f"--{p}", f"{tmp_path}/{p}")]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--tables", "/root/testdata/sf0.001", *args, "--config", f"jobs/{job}.json", "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/target/{'index' if job == 'index_update' else 'ledger'}").count() > 100
