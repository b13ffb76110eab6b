"""Text ledger: what arrived from each source of a text table, checked row by row, with an exit code a source.

    python -m jobs.text_ledger --tables DIR --target DIR --config jobs/text_ledger.json

Reads ``documents``. Writes ``<target>/ledger``, partitioned by source, with a row for each document:

    doc_id, lang, n_bytes, n_lines, md5, problems, ok, source

and ``<target>/sources``, partitioned by exit code: ``source, total, succeeded, failed, settings, exit_code``. ``problems`` are, in this order and
joined by commas: ``no_text`` (null), ``empty``, ``length`` (``n_chars`` is not the number of characters), ``control`` (a control character but
tab, line feed and carriage return), ``replaced`` (U+FFFD), ``letters`` (a share of letters under ``least_letters``), ``line`` (a line over
``longest_line`` characters), ``no_lang``. A document is ok if it has none; of a null or empty text only that, ``length`` and ``no_lang`` are
told. The exit code is 0 where all of a source are ok, 1 where none is, else 2. ``settings`` is the hash of the settings.

A source is a chunk: those whose number of rows in the ledger is that of the table are done, the others are made anew,
``sources_at_once`` at a time (0: all). So a run that was stopped goes on where it was, a second run of the same input writes no ledger again, and input that
has grown replaces just the sources that did. With other settings use another target. Null sources are one source of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import progress, scan
from jobs.common import command, log

LEDGER = "doc_id long, lang string, n_bytes long, n_lines long, md5 string, problems string, ok boolean, source string"
SOURCES = "source string, total long, succeeded long, failed long, settings string, exit_code int"


def problems(text: Column, lang: Column, n_chars: Column, least_letters: float, longest_line: int) -> Column:
    chars = F.char_length(text)
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    cases = {
        "no_text": text.isNull(),
        "empty": text == "",
        "length": ~n_chars.eqNullSafe(F.coalesce(chars, F.lit(0))),
        "control": text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
        "replaced": F.contains(text, F.lit("�")),
        "letters": (chars > 0) & (letters < chars * least_letters),
        "line": F.exists(F.split(text, "\n", -1), lambda x: F.char_length(x) > longest_line),
        "no_lang": lang.isNull() | (F.trim(lang) == ""),
    }
    return F.concat_ws(",", *(F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in cases.items()))


def ledger(docs: DataFrame, config: dict) -> DataFrame:
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.md5(text).alias("md5"),
        problems(text, F.col("lang"), F.col("n_chars"), config["least_letters"], config["longest_line"]).alias("problems"),
        F.col("source").cast("string").alias("source"),
    )
    return rows.select("doc_id", "lang", "n_bytes", "n_lines", "md5", "problems", (F.col("problems") == "").alias("ok"), "source")


def run(spark: SparkSession, tables: str, target: str, config: dict) -> DataFrame:
    """Bring the ledger up to the table, and give it with its sources' totals and exit codes, read back."""
    docs = scan.table(spark, tables, "documents")
    sources = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("rows"))

    def work(some: DataFrame) -> DataFrame:
        own = docs.join(F.broadcast(some.select(F.col("source").alias("_source"))), F.col("source").cast("string").eqNullSafe(F.col("_source")), "left_semi")
        return ledger(own, config)

    done = progress.fill(spark, f"{target}/ledger", LEDGER, sources, ["source"], work, config.get("sources_at_once", 0))
    rows = progress.result(spark, f"{target}/ledger", LEDGER)
    said = json.dumps({k: config[k] for k in ("least_letters", "longest_line")}, sort_keys=True)
    hashed = F.substring(F.md5(F.lit(said)), 1, 8)
    by_source = scan.outcomes(rows, F.col("ok"), ["source"]).withColumn("settings", hashed)
    by_source.select("source", "total", "succeeded", "failed", "settings", "exit_code").coalesce(1).write.mode("overwrite").partitionBy("exit_code").parquet(f"{target}/sources")
    found = progress.result(spark, f"{target}/sources", SOURCES)
    n, ok, most = rows.agg(F.count("*"), F.count_if("ok"), F.count_distinct(F.coalesce("source", F.lit("")))).first()
    log.info("read %s/documents: %d sources made anew; %s/ledger has %d rows of %d sources, %d without problems", tables, done, target, n, most, ok)
    return rows.join(found.select(F.col("source").alias("_source"), "total", "failed", "settings", "exit_code"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


if __name__ == "__main__":
    command("Check the documents of each source and keep the ledger.", run, {"tables": "folder of the given tables", "target": "folder of the ledger"})
