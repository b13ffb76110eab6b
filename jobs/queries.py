"""The jobs as queries: each runs twice into one new folder, and gives its whole output after the second run."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.carriers import sql
from gridloom.plans.registry import query
from gridloom.sources.results import shared_path
from jobs import index_update, text_ledger


def settings(job: str) -> dict:
    """The config file beside the job, part of the program."""
    return json.loads((Path(__file__).parent / f"{job}.json").read_text())


@query("job1_index_update", sql("""
  SELECT season, name, round(value, 4) AS value, round(value - avg(value) FILTER (season BETWEEN '1996-01-01' AND '1999-12-31') OVER (PARTITION BY name, month(season)), 4) AS anom, cells, year(season)::INT AS year
  FROM (SELECT season, trim(r_name) AS name, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS value, count(*) AS cells FROM sea JOIN nation ON n_nationkey = cell JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)"""))
def job1_index_update(spark: SparkSession, d: str) -> DataFrame:
    where = shared_path(spark, "job1")
    for _ in range(2):
        out = index_update.run(spark, d, f"{where}/out", f"{where}/state", settings("index_update"))
    return out.select("season", "name", F.round("value", 4).alias("value"), (F.round("anom", 4) + 0.0).alias("anom"), "cells", "year")


@query("job2_text_ledger", r"""
WITH p AS (SELECT doc_id, lang, source, text, n_chars, length(text) AS chars, string_split(text, chr(10)) AS lines, length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters FROM documents),
l AS (SELECT doc_id, lang, source, coalesce(octet_length(encode(text)), 0) AS n_bytes, coalesce(len(lines), 0) AS n_lines, md5(text) AS md5, array_to_string(list_filter([
  CASE WHEN text IS NULL THEN 'no_text' END, CASE WHEN text = '' THEN 'empty' END, CASE WHEN n_chars IS DISTINCT FROM coalesce(chars, 0) THEN 'length' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control' END, CASE WHEN contains(text, chr(65533)) THEN 'replaced' END,
  CASE WHEN chars > 0 AND letters < chars * 0.5 THEN 'letters' END, CASE WHEN len(list_filter(lines, lambda x: length(x) > 20000)) > 0 THEN 'line' END,
  CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'no_lang' END], lambda x: x IS NOT NULL), ',') AS problems FROM p),
s AS (SELECT source, count(*) AS total, count(*) FILTER (problems <> '') AS failed FROM l GROUP BY source)
SELECT doc_id, lang, n_bytes::BIGINT AS n_bytes, n_lines::BIGINT AS n_lines, md5, problems, problems = '' AS ok, l.source, total, failed, substr(md5('{"least_letters": 0.5, "longest_line": 20000}'), 1, 8) AS settings,
  CASE WHEN failed = 0 THEN 0 WHEN failed = total THEN 1 ELSE 2 END::INT AS exit_code
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
""")
def job2_text_ledger(spark: SparkSession, d: str) -> DataFrame:
    where = shared_path(spark, "job2")
    for _ in range(2):
        out = text_ledger.run(spark, d, f"{where}/out", settings("text_ledger"))
    return out
