"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, exact_dedup, filter_audit, langid, line_dedup, media, pii, repeats, simhash, token_fst, toxicity
from gridloom.llm.common import table, texts

HELD_OUT = 2


def held_out() -> Column:
    """The fold that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fst.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUERIES["op1_token_counts"] = op1_token_counts


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_features(table(spark, sf_dir, "documents"))


QUERIES["op3_media_sniff"] = op3_media_sniff


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op4_bpe_round_trip"] = op4_bpe_round_trip


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(~F.coalesce(held_out(), F.lit(True))))
    scored = toxicity.score(texts(docs), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES["op8_toxicity"] = op8_toxicity


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.learn(docs.filter(~F.coalesce(held_out(), F.lit(True))))
    return langid.predict(docs, prototypes).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES["op10_language"] = op10_language


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op5_simhash"] = op5_simhash


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("deduped", F.lit("")), 256).alias("text_sha256"))


QUERIES["op2_line_dedup"] = op2_line_dedup
ORACLES["op2_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT line, min(doc_id * 268435456 + n) AS place, list_distinct(list_filter(string_split(line, ' '), lambda x: x <> '')) AS s FROM l GROUP BY line),
c AS (SELECT min(place) AS c, list_sort(s) AS s FROM w WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT c, len(s) AS n, unnest(s) AS w FROM c),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT c, n, w FROM (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS i FROM t JOIN f USING (w)) WHERE i <= n - ceil(n * 0.8) + 1),
k AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.w = b.w AND a.c < b.c AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
m AS (SELECT k.b AS c, min(k.a) AS a FROM k JOIN c x ON x.c = k.a JOIN c y ON y.c = k.b
      WHERE len(list_intersect(x.s, y.s)) * 9 >= (len(x.s) + len(y.s)) * 4 GROUP BY k.b),
u AS (SELECT c.s, coalesce(m.a, c.c) AS upto FROM c LEFT JOIN m USING (c)),
g AS (SELECT w.line, u.upto FROM w JOIN u ON list_sort(w.s) = u.s),
r AS (SELECT l.doc_id, l.n, l.line, coalesce(l.doc_id * 268435456 + l.n > g.upto, false) AS gone FROM l LEFT JOIN g USING (line)),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS text_sha256 FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(text_sha256, sha256('')) AS text_sha256 FROM documents LEFT JOIN d USING (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op9_decontaminate"] = op9_decontaminate
#: Two substitutions in 12 places leave one of three blocks of four intact, so any window that leaks is found by a block.
ORACLES["op9_decontaminate"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(range(len(w) - 11)) AS p, w FROM d WHERE len(w) >= 12),
bw AS (SELECT item_id, unnest(range(len(w) - 11)) AS p, w FROM b WHERE len(w) >= 12),
dx AS (SELECT doc_id, p, w[p + 1 : p + 12] AS x FROM dw),
bx AS (SELECT item_id, p, w[p + 1 : p + 12] AS x FROM bw),
db AS (SELECT doc_id, p, x, unnest([0, 4, 8]) AS o FROM dx),
bb AS (SELECT item_id, x, unnest([0, 4, 8]) AS o FROM bx),
h AS (SELECT DISTINCT doc_id, item_id, db.p, db.x, bb.x AS y FROM db JOIN bb ON db.o = bb.o AND db.x[db.o + 1 : db.o + 4] = bb.x[bb.o + 1 : bb.o + 4]),
v AS (SELECT doc_id, item_id, p, list_sum(list_transform(range(1, 13), lambda i: (x[i] = y[i])::INT)) AS m FROM h),
long AS (SELECT doc_id, item_id, p, max(m) AS m, 12 AS size FROM v WHERE m >= 10 GROUP BY ALL),
short AS (SELECT doc_id, item_id, p, m, size FROM (
    SELECT doc_id, item_id, p, size, list_sum(list_transform(range(1, size + 1), lambda i: (dw[p + i] = bw[i])::INT)) AS m FROM (
      SELECT doc_id, item_id, unnest(range(len(d.w) - len(b.w) + 1)) AS p, len(b.w) AS size, d.w AS dw, b.w AS bw FROM d JOIN b ON len(b.w) BETWEEN 5 AND 11 AND len(d.w) >= len(b.w)))
  WHERE 5 * m >= 4 * size)
SELECT doc_id, item_id, count(*)::BIGINT AS n_windows, min(p)::BIGINT AS first_word, max(p + size)::BIGINT AS last_word, max(m)::BIGINT AS agreeing
FROM (SELECT * FROM long UNION ALL SELECT * FROM short) GROUP BY doc_id, item_id
"""


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lost = repeats.repeated(docs).select("rid", F.aggregate("spans", F.lit(0), lambda n, x: n + x["to"] - x["from"]).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    rows = texts(docs).select("doc_id", repeats.row_key().alias("rid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(lost.dropDuplicates(["rid"]), "rid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


QUERIES["op6_repeats"] = op6_repeats

PII_KEY = b"gridloom surrogate key: set your own"


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


QUERIES["op7_surrogates"] = op7_surrogates


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES["op11_exact_dedup"] = op11_exact_dedup
ORACLES["op11_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op12_filter_audit"] = op12_filter_audit
ORACLES["op12_filter_audit"] = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false)::INT AS good, coalesce(bool_or(toxic = 1), false)::INT AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT [a, b, c, d, e] AS o FROM unnest([1, 2, 3, 4, 5]) t1(a), unnest([1, 2, 3, 4, 5]) t2(b), unnest([1, 2, 3, 4, 5]) t3(c), unnest([1, 2, 3, 4, 5]) t4(d), unnest([1, 2, 3, 4, 5]) t5(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT o, k AS step, o[k] AS x, o[1 : k - 1] AS before FROM o, unnest([1, 2, 3, 4, 5]) t(k)),
r AS (SELECT part, o, step, x, n, good, toxic, fails[x] AS fail, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda i: i)) = 1 AS alone FROM m, s),
g AS (SELECT part, o, step, x, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fail AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost FROM r GROUP BY part, o, step, x)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g
"""
