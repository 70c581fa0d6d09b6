"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm.common import table
from quantspark.llm.decontaminate import contained_items
from quantspark.llm.embeddings import embedding_duplicates
from quantspark.llm.language import predict_language, train_language
from quantspark.llm.licenses import scan_licenses
from quantspark.llm.lm import score_lm, train_lm
from quantspark.llm.mixing import mix_sources
from quantspark.llm.neardup import NearDupConfig, near_duplicates
from quantspark.llm.pages import extract_pages
from quantspark.llm.quality import remainder, score_quality, train_quality
from quantspark.llm.secrets import secret_digest, secret_spans


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM sizes),
weighed AS (
  SELECT *, CAST([5.0, 2.0, 1.0][CAST((r - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, 3 * source_size AS cap FROM named),
ranked AS (
  SELECT *, sum(cap) OVER fill - cap AS before,
         sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () AS total
  FROM weighed WINDOW fill AS (ORDER BY cap / w, r)),
levelled AS (SELECT *, CAST(total - before AS DOUBLE) / open_w AS level FROM ranked),
lvl AS (SELECT level FROM levelled WHERE level * w <= cap ORDER BY cap / w, r LIMIT 1),
targets AS (
  SELECT source, source_size,
         coalesce(least((SELECT level FROM lvl) * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
  FROM levelled),
plan AS (
  SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM targets),
drawn AS (
  SELECT *, (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
            / 4503599627370496.0 AS u FROM base),
tried AS (
  SELECT h.source, h.size, (p.target - p.whole * p.source_size - (sum(h.size * h.n) OVER down - h.size * h.n))
         / sum(CAST(h.size * h.size * h.n AS DOUBLE)) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM (SELECT source, size, count(*) AS n FROM base WHERE size > 0 GROUP BY source, size) h
  JOIN plan p ON h.source IS NOT DISTINCT FROM p.source
  WINDOW down AS (PARTITION BY h.source ORDER BY h.size DESC)),
scales AS (SELECT source, greatest(arg_max(scale, size), 0.0) AS scale FROM tried WHERE scale * size <= 1 GROUP BY source),
odds AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         coalesce(s.scale, 0.0) AS scale, d.u / (1 - d.u) AS random_odds, coalesce(s.scale, 0.0) * d.size AS pi
  FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN scales s ON d.source IS NOT DISTINCT FROM s.source),
ranked_docs AS (
  SELECT *, pi >= 1 AS certain, CASE WHEN pi > 0 AND pi < 1 THEN random_odds / (pi / (1 - pi)) END AS pareto,
         coalesce(sum(CASE WHEN pi >= 1 THEN size END) OVER (PARTITION BY source), 0) AS certain_words
  FROM odds),
picked AS (
  SELECT *, sum(CASE WHEN pareto IS NOT NULL THEN size ELSE 0 END)
            OVER (PARTITION BY source ORDER BY pareto ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ranked_docs),
copied AS (
  SELECT *, CAST(least(whole + CASE WHEN certain THEN 1 WHEN pareto IS NOT NULL AND upto - size / 2.0 <= rest - certain_words THEN 1 ELSE 0 END, 3)
                 AS INT) AS copies FROM picked)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM copied
"""

def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
si AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS sh
  FROM ik),
n AS (SELECT item_id, count(*) AS q FROM si GROUP BY item_id),
sd AS (
  SELECT DISTINCT doc_id, k, sh FROM (
    SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS sh
    FROM d, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k)),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sd JOIN si USING (k, sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, q AS n_item, CAST(n_shared AS DOUBLE) / q AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= q * 0.8 - 1e-9
"""


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDupConfig(words=2))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict_language(docs, train_language(docs)).select("doc_id", held_out, "lang_pred", "score")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_lm(docs, train_lm(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_spans(table(spark, sf_dir, "documents")))


QUERIES = {"op1_embeddings": op1_embeddings, "op9_lm": op9_lm, "op7_pages": op7_pages, "op5_licenses": op5_licenses, "op6_language": op6_language, "op2_quality": op2_quality, "op4_near_dup": op4_near_dup, "op3_decontamination": op3_decontamination, "op10_secrets": op10_secrets, "op8_mixing": op8_mixing}
ORACLE = {"op3_decontamination": OP3_SQL, "op8_mixing": OP8_SQL}
