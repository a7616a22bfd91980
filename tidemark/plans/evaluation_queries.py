"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as e
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query


def r9(df: DataFrame, *names: str, n: int = 9) -> DataFrame:
    return df.withColumns({x: F.round(F.col(x), n) for x in names})


def _steps(rows: str, by: str) -> str:
    return f"""
ties AS (SELECT {by}, p_break, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM {rows} GROUP BY ALL),
steps AS (SELECT *, CAST(sum(pos) OVER dn AS BIGINT) AS tp, CAST(sum(neg) OVER dn AS BIGINT) AS fp, CAST(sum(pos) OVER ev AS BIGINT) AS n_pos, CAST(sum(neg) OVER ev AS BIGINT) AS n_neg FROM ties
  WINDOW dn AS (PARTITION BY {by} ORDER BY p_break DESC), ev AS (PARTITION BY {by})),
areas AS (SELECT {by}, max(n_pos) + max(n_neg) AS n, max(n_pos) AS n_pos, CASE WHEN max(n_pos) * max(n_neg) > 0 THEN sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (max(n_pos) * max(n_neg)) END AS roc_auc,
  CASE WHEN max(n_pos) * max(n_neg) > 0 THEN sum(pos * (tp / (tp + fp)::DOUBLE)) / max(n_pos) END AS average_precision FROM steps GROUP BY ALL),
cand AS (SELECT DISTINCT {by}, t FROM (SELECT {by}, p_break AS t FROM {rows} UNION ALL SELECT {by}, 0.0::DOUBLE FROM {rows} UNION ALL SELECT {by}, 1.0::DOUBLE FROM {rows})),
conf AS (SELECT {by}, t, (SELECT count(*) FILTER (label = 1 AND p_break >= t) FROM {rows} r WHERE r.{by} = cand.{by}) AS tp, (SELECT count(*) FILTER (label = 0 AND p_break >= t) FROM {rows} r WHERE r.{by} = cand.{by}) AS fp,
  (SELECT count(*) FILTER (label = 1) FROM {rows} r WHERE r.{by} = cand.{by}) AS n_pos, (SELECT count(*) FILTER (label = 0) FROM {rows} r WHERE r.{by} = cand.{by}) AS n_neg FROM cand)"""


def _sql(body: str, rows: str = "resolved", by: str = "geography", views: str = "resolved") -> str:
    return with_views(views, "SELECT 1").removesuffix("\nSELECT 1") + "," + _steps(rows, by) + "\n" + body


@query(_sql("SELECT geography, n, n_pos, round(roc_auc, 9) AS roc_auc FROM areas"))
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return r9(e.auc(c.resolved(spark, d), ["geography"]), "roc_auc").drop("average_precision")


@query(_sql("SELECT geography, n, round(average_precision, 9) AS average_precision FROM areas"))
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return r9(e.auc(c.resolved(spark, d), ["geography"]), "average_precision").select("geography", "n", "average_precision")


@query(with_views("resolved", """SELECT geography, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS tpr, round(fp / nullif(fp + tn, 0)::DOUBLE, 9) AS fpr, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS precision FROM (
  SELECT geography, count(*) FILTER (p_break >= 0.25 AND label = 1) AS tp, count(*) FILTER (p_break >= 0.25 AND label = 0) AS fp, count(*) FILTER (p_break < 0.25 AND label = 1) AS fn, count(*) FILTER (p_break < 0.25 AND label = 0) AS tn FROM resolved GROUP BY 1)"""))
def confusion_at(spark: SparkSession, d: str) -> DataFrame:
    return r9(e.confusion_at(c.resolved(spark, d), ["geography"], 0.25), "tpr", "fpr", "precision")


@query(_sql("""SELECT geography, b.t AS threshold, b.cost AS cost, b.tp AS tp, b.fp AS fp, b.fn AS fn, b.tn AS tn FROM (
  SELECT geography, arg_min({'t': t, 'cost': fp + (n_pos - tp) * 15.0::DOUBLE, 'tp': tp, 'fp': fp, 'fn': n_pos - tp, 'tn': n_neg - fp}, (fp + (n_pos - tp) * 15.0::DOUBLE, t)) AS b FROM conf GROUP BY 1)"""))
def optimal_threshold(spark: SparkSession, d: str) -> DataFrame:
    return e.optimal_threshold(c.resolved(spark, d), ["geography"])


@query(_sql("""SELECT geography, CAST(ratio AS INTEGER) AS ratio, b.t AS threshold, b.cost AS cost FROM (
  SELECT geography, ratio, arg_min({'t': t, 'cost': (fp + (n_pos - tp) * ratio)::DOUBLE}, (fp + (n_pos - tp) * ratio, t)) AS b FROM conf, (SELECT unnest([5, 10, 15, 20]) AS ratio) GROUP BY 1, 2)"""))
def cost_curve(spark: SparkSession, d: str) -> DataFrame:
    return e.cost_curve(c.resolved(spark, d), ["geography"])


@query(with_views("resolved", """SELECT CAST((p_break >= 0.2)::INT + (p_break >= 0.4)::INT + (p_break >= 0.6)::INT + (p_break >= 0.8)::INT AS INTEGER) AS bin, count(*) AS n, round(avg(p_break), 9) AS mean_p, round(avg(label::DOUBLE), 9) AS break_rate FROM resolved GROUP BY 1"""))
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return r9(e.calibration_bins(c.resolved(spark, d)), "mean_p", "break_rate")


@query(with_views("resolved", """SELECT geography, count(*) AS n, round(avg(label::DOUBLE), 9) AS base_rate, round(avg((p_break - label) * (p_break - label)), 9) AS brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 7) AS log_loss
FROM (SELECT *, greatest(1e-12, least(1 - 1e-12::DOUBLE, p_break)) AS q FROM resolved) GROUP BY 1"""))
def probability_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r9(r9(e.probability_metrics(c.resolved(spark, d), ["geography"]), "base_rate", "brier"), "log_loss", n=7)


_COHORTS = """, coh AS (SELECT unnest(['all', 'quarter:' || year(announce_date) || '-Q' || quarter(announce_date), 'geography:' || coalesce(geography, '?'), 'deal_type:' || coalesce(deal_type, '?')]) AS cohort, p_break, label FROM resolved)"""


@query(
    with_views("resolved", "SELECT 1").removesuffix("\nSELECT 1") + _COHORTS + "," + _steps("coh", "cohort")
    + """
SELECT cohort, a.n, a.n_pos, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, b.t AS threshold, b.cost AS cost, b.tp AS tp, b.fp AS fp, b.fn AS fn, b.tn AS tn, round(a.n_pos / a.n::DOUBLE, 9) AS base_rate, a.n < 20 AS thin
FROM areas a JOIN (SELECT cohort, arg_min({'t': t, 'cost': fp + (n_pos - tp) * 15.0::DOUBLE, 'tp': tp, 'fp': fp, 'fn': n_pos - tp, 'tn': n_neg - fp}, (fp + (n_pos - tp) * 15.0::DOUBLE, t)) AS b FROM conf GROUP BY 1) USING (cohort)"""
)
def scorecard_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    return r9(e.scorecard(c.resolved(spark, d)), "roc_auc", "average_precision", "base_rate")
