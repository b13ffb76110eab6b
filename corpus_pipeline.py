"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes the documents its predecessor kept. All but the last return documents with their columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, line_dedup, simhash, toxicity
from gridloom.llm.common import free_name, table, written
from gridloom.llm.queries import held_out

#: Documents that score this much or more are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go. Documents with no text are scored as such and stay."""
    labels = table(spark, sf_dir, "labels").filter(~F.coalesce(held_out(), F.lit(True)))
    model = toxicity.learn(docs, labels)
    mark = free_name(docs, "score")
    return toxicity.score(docs, model, out_col=mark).filter(F.col(mark) < TOXIC).drop(mark)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line leave the text; every document stays, with its length in ``n_chars``."""
    text, n, gone = (free_name(docs, c) for c in ("text_left", "n_lines", "n_removed"))
    out = line_dedup.dedup(docs, out_col=text, lines_col=n, removed_col=gone)
    length = F.when(F.col(gone) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    fresh = {"text": F.col(text), "n_chars": length}
    return out.select(*(fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return simhash.one_of_each(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document that is left."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("SimHash near-dedup", drop_near_duplicates), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]
#: Toxicity scores and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
