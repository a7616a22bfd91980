"""Preparation, registry, baselines, challengers and covariances over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import MIN_CLASS_N, MIN_SAMPLE_N, SNAPSHOT_POLICIES
from tidemark.operators import experiment, model
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query

_CUTS, _HORIZON = ("1996-06-30", "1997-06-30", "1998-06-30"), "1999-12-31"
_SETS = f"""w(window_no, cutoff, test_end) AS (VALUES {", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(zip(_CUTS, (*_CUTS[1:], _HORIZON))))}),
m AS (SELECT window_no, cutoff, test_end, deal_id, label, sha256(deal_id || chr(31) || strftime(announce_date, '%Y-%m-%d') || chr(31) || label) AS d, CASE WHEN resolution_date <= cutoff AND announce_date <= cutoff THEN 'train' WHEN announce_date > cutoff AND resolution_date <= DATE '{_HORIZON}' THEN 'test' END AS role
  FROM (SELECT *, CASE status WHEN 'broken' THEN 1 ELSE 0 END AS label FROM deals WHERE resolution_date IS NOT NULL AND deal_id % 5 <> 0) d JOIN w ON announce_date <= test_end),
s AS (SELECT window_no, cutoff, test_end, role, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, sha256(count(*) || '|' || CAST(sum(('0x' || substr(d, 1, 15))::BIGINT) AS VARCHAR) || '|' || CAST(sum(('0x' || substr(d, 16, 15))::BIGINT) AS VARCHAR)) AS f FROM m WHERE role IS NOT NULL GROUP BY 1, 2, 3, 4),
p AS (SELECT window_no, cutoff, test_end, coalesce(max(n) FILTER (role = 'train'), 0) AS n_train, coalesce(max(n_pos) FILTER (role = 'train'), 0) AS n_pos_train, coalesce(max(n) FILTER (role = 'test'), 0) AS n_test, coalesce(max(n_pos) FILTER (role = 'test'), 0) AS n_pos_test, max(f) FILTER (role = 'train') AS fingerprint_train, max(f) FILTER (role = 'test') AS fingerprint_test FROM s GROUP BY 1, 2, 3)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return c.deals(spark, d).where("resolution_date is not null").selectExpr("deal_id", "announce_date as feature_at", "if(status = 'broken', 1, 0) as label", "resolution_date as resolved_at")


@query(with_views("deals", "SELECT 1").removesuffix("\nSELECT 1") + f",\n{_SETS}\nSELECT window_no, cutoff, test_end, n_train, n_pos_train, n_test, n_pos_test, fingerprint_train, fingerprint_test, n_train >= {MIN_SAMPLE_N} AND least(n_pos_train, n_train - n_pos_train) >= {MIN_CLASS_N} AS meets_minimum, 'PREPARED_NOT_FITTED' AS status FROM p")
def experiment_plan(spark: SparkSession, d: str) -> DataFrame:
    """The sets of each window of a frozen cohort; nothing is fitted."""
    rows = _labelled(spark, d)
    cohort = c.table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("deal_id"))
    return experiment.prepared_plan(rows, cohort, _CUTS, _HORIZON, dict(experiment.LOCKED)).withColumnRenamed("window", "window_no")


@query(with_views("deals", "SELECT deal_id, (SELECT avg(CASE status WHEN 'broken' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM deals WHERE resolution_date <= DATE '1997-06-30') AS p_constant FROM deals WHERE resolution_date IS NOT NULL AND announce_date > DATE '1997-06-30'"))
def constant_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return experiment.constant_baseline(rows.where("resolved_at <= date'1997-06-30'"), rows.where("feature_at > date'1997-06-30'")).select("deal_id", "p_constant")


@query(with_views("deals", f"SELECT policy, counted_in, after, n_snapshots, recommended, CASE WHEN n_snapshots > 1 THEN 'deal_equal_snapshot_weight' END AS weighting, false AS uses_resolution, (SELECT count(*) FROM deals) AS n_deals, (SELECT count(*) FROM deals WHERE resolution_date IS NOT NULL) AS n_resolved FROM (VALUES " + ", ".join(f"('{n}', '{k}', {x}, {len(o)}, {str(n == 'ann_tplus_10_session').lower()})" for n, (k, o) in SNAPSHOT_POLICIES.items() for x in o) + ") t(policy, counted_in, after, n_snapshots, recommended)"))
def policy_document(spark: SparkSession, d: str) -> DataFrame:
    """The draft's policies with the deals that they would be applied to."""
    covered = c.deals(spark, d).agg(F.count("*").alias("n_deals"), F.count("resolution_date").alias("n_resolved"))
    return experiment.policy_document(spark).crossJoin(F.broadcast(covered))  # one row


@query("SELECT 'a' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'removed' WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM part")
def contract_flags(spark: SparkSession, d: str) -> DataFrame:
    """A locked baseline's artifacts before and after a run."""
    k = c.table(spark, d, "part").selectExpr("p_partkey as k", "concat('a', p_partkey) as name")
    gone = F.col("k") % 5 == 0
    return experiment.contract_flags(k.where(gone | (F.col("k") % 7 != 0)).selectExpr("name", "'x' as sha256"), k.where(~gone).selectExpr("name", "if(k % 3 = 0, 'y', 'x') as sha256"))


@query(with_views("resolved", "SELECT deal_id, least(1.0::DOUBLE, p_break + (deal_id % 7) / 10.0::DOUBLE) - p_break AS delta FROM resolved"))
def challenger_delta(spark: SparkSession, d: str) -> DataFrame:
    return c.resolved(spark, d).select("deal_id", experiment.diagnostic_delta(F.expr("least(1.0D, p_break + (deal_id % 7) / 10.0D)"), F.col("p_break")).alias("delta"))


_COLUMNS = 50


def _cell(k: int) -> str:
    return f"(p_retailprice - 900) * {k * 7 % 11 + 1} / 100 + p_size * {k * 3 % 5} + p_partkey % {k + 2}"


@query("WITH x AS (SELECT p_partkey, unnest([" + ", ".join(str(k) for k in range(_COLUMNS)) + "]) AS k, unnest([" + ", ".join(f"({_cell(k)})::DOUBLE" for k in range(_COLUMNS)) + "]) AS v FROM part) SELECT 'x' || a.k AS a, 'x' || b.k AS b, round(covar_samp(a.v, b.v), 3) AS cov FROM x a JOIN x b USING (p_partkey) GROUP BY 1, 2")
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's shape: n rows of 50 columns."""
    rows = c.table(spark, d, "part").selectExpr(*[f"cast({_cell(k)} as double) as x{k}" for k in range(_COLUMNS)])
    return model.covariance_matrix(rows, rows.columns).select("a", "b", F.round("cov", 3).alias("cov"))
