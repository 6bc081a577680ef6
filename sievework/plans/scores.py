"""Metrics lane: labels joined with the deterministic stand-in score."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import metrics as M
from sievework.plans.registry import query, table

S = "WITH s AS (SELECT doc_id, lang, quality AS label, (('0x' || substr(sha1(text), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"
CELLS = "count(*) FILTER (score >= {0} AND label = 1) AS tp, count(*) FILTER (score >= {0} AND label = 0) AS fp, count(*) FILTER (score < {0} AND label = 1) AS fn, count(*) FILTER (score < {0} AND label = 0) AS tn"
RATES = "tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)::DOUBLE AS accuracy"


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", X.stand_in_score(F.col("text")).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(S + f", c AS (SELECT {CELLS.format('0.5')} FROM s) SELECT {RATES} FROM c")
def confusion_at(spark, sf_dir):
    return M.metrics_at(scored(spark, sf_dir), 0.5)


@query(S + f", c AS (SELECT lang AS grp, count(*) AS n, {CELLS.format('0.5')} FROM s GROUP BY lang) SELECT grp, n, {RATES} FROM c")
def confusion_by_lang(spark, sf_dir):
    return M.metrics_at(scored(spark, sf_dir), 0.5, by=F.col("lang"))


@query(S + f", t(threshold) AS (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)), c AS (SELECT threshold, {CELLS.format('threshold')} FROM s, t GROUP BY threshold) SELECT threshold, {RATES} FROM c")
def threshold_sweep(spark, sf_dir):
    return M.sweep(scored(spark, sf_dir), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@query(S + f", t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i)), c AS (SELECT threshold, {CELLS.format('threshold')} FROM s, t GROUP BY threshold), m AS (SELECT threshold, {RATES} FROM c) SELECT threshold, f1, tp, fp, fn, tn FROM m ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    return M.best_f1(scored(spark, sf_dir))


@query(
    S
    + """, g AS (SELECT score, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM s GROUP BY score),
a AS (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pa, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na FROM g)
SELECT round(sum(n * pa + 0.5::DOUBLE * n * p) / (sum(p) * sum(n)), 9) AS roc_auc, round(sum(p * (p + pa) / (p + pa + n + na)) / sum(p), 9) AS pr_auc FROM a"""
)
def roc_pr_auc(spark, sf_dir):
    return M.areas(scored(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


@query("SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (quality = 0)) AS w0, count(*) / (2.0::DOUBLE * count(*) FILTER (quality = 1)) AS w1 FROM labels")
def class_weights(spark, sf_dir):
    return M.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("label")))


@query(S + f", c AS (SELECT {CELLS.format('0.5')} FROM s), m AS (SELECT {RATES} FROM c), g(metric, floor, value) AS (SELECT 'f1', 0.9::DOUBLE, f1 FROM m UNION ALL SELECT 'recall', 0.1, recall FROM m UNION ALL SELECT 'absent', 0.1, NULL FROM m) SELECT * FROM g WHERE value IS NULL OR value < floor")
def quality_gate(spark, sf_dir):
    return M.quality_gate(spark, M.metrics_at(scored(spark, sf_dir), 0.5), {"f1": 0.9, "recall": 0.1, "absent": 0.1, "precision": None})


@query("WITH s AS (SELECT doc_id, (('0x' || substr(sha1(text), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS score FROM documents) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def topk_global(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.stand_in_score(F.col("text")).alias("score"))
    return docs.orderBy(F.desc("score"), "doc_id").limit(10)


@query("WITH s AS (SELECT doc_id, source, (('0x' || substr(sha1(text), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS score FROM documents) SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM s WHERE score >= 0.3) WHERE k <= 3")
def topk_per_file(spark, sf_dir):
    """The three best of a source at or over the threshold; Spark limits each group before it is shuffled."""
    from pyspark.sql.window import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", X.stand_in_score(F.col("text")).alias("score")).where("score >= 0.3")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return docs.withColumn("k", place).where("k <= 3").select("doc_id", "source", "score")


@query("SELECT doc_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'very low' END AS plain, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS with_rule FROM (SELECT doc_id, (('0x' || substr(sha1(text), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS score FROM documents)")
def confidence_buckets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.stand_in_score(F.col("text")).alias("score"))
    return docs.select("doc_id", X.confidence(F.col("score"), F.lit(False)).alias("plain"), X.confidence(F.col("score"), F.lit(True)).alias("with_rule"))
