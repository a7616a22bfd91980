"""Evaluation of rare-event scores: rank AUC, average precision, confusion, thresholds, calibration, scorecards.

All take rows of ``cohort columns, p_break, label``. Ties of the score are aggregated first; what lies above a score is
summed over ranges of cohort and score, so a cohort of very many scores spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import COST_FN, COST_FP, COST_RATIO_GRID, MIN_SAMPLE_N
from tidemark.operators.ordering import running_sums


def resolved_deals(deals: DataFrame, cutoff: str) -> DataFrame:
    """Closed and broken deals with a score, resolved by the cut-off, with ``label`` 1 for broken; pending ones are censored."""
    rows = deals.where(F.col("status").isin("closed", "broken") & (F.col("resolution_date") <= F.lit(cutoff).cast("date")) & F.col("p_break").isNotNull())
    return rows.withColumn("label", (F.col("status") == "broken").cast("int"))


def by_score(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per cohort and distinct score: positives and negatives there, and above it."""
    ties = rows.groupBy(*by, "p_break").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return running_sums(ties, by, [F.col("p_break").desc()], {"tp": "pos", "fp": "neg"}, {"n_pos": "tp", "n_neg": "fp"})


def auc(rows: DataFrame, by: Sequence[str], steps: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney AUC with ties counted half, and average precision by steps; null if a class is missing. ``steps`` is
    what by_score gives, if it is there already."""
    steps = by_score(rows, by) if steps is None else steps
    below = F.col("n_neg") - F.col("fp")  # negatives with a lower score
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    both = F.max("n_pos") * F.max("n_neg")
    area = F.when(both > 0, wins / both)
    ap = F.when(both > 0, F.sum(F.col("pos") * precision) / F.max("n_pos"))
    return steps.groupBy(*by).agg((F.max("n_pos") + F.max("n_neg")).alias("n"), F.max("n_pos").alias("n_pos"), area.alias("roc_auc"), ap.alias("average_precision"))


def thresholds(rows: DataFrame, by: Sequence[str], steps: DataFrame | None = None) -> DataFrame:
    """Every distinct score, 0 and 1 as a threshold with the confusion it gives; flagged means p >= threshold."""
    steps = by_score(rows, by) if steps is None else steps
    ends = rows.groupBy(*by).agg(F.sum("label").cast("long").alias("n_pos"), F.sum(1 - F.col("label")).cast("long").alias("n_neg"), F.count_if(F.col("p_break") >= 1).alias("_"), F.sum(F.when(F.col("p_break") >= 1, F.col("label")).otherwise(0)).cast("long").alias("tp1"), F.sum(F.when(F.col("p_break") >= 1, 1 - F.col("label")).otherwise(0)).cast("long").alias("fp1"))
    zero = ends.select(*by, F.lit(0.0).alias("t"), F.col("n_pos").alias("tp"), F.col("n_neg").alias("fp"), "n_pos", "n_neg")
    one = ends.select(*by, F.lit(1.0).alias("t"), F.col("tp1").alias("tp"), F.col("fp1").alias("fp"), "n_pos", "n_neg")
    own = steps.where("p_break <> 0 and p_break <> 1").select(*by, F.col("p_break").alias("t"), "tp", "fp", "n_pos", "n_neg")
    return own.unionByName(zero).unionByName(one).withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})


def optimal_threshold(rows: DataFrame, by: Sequence[str], cost_fp: float = COST_FP, cost_fn: Column | float = COST_FN, steps: DataFrame | None = None) -> DataFrame:
    """The cheapest threshold, the smallest of equally cheap ones, with its cost and confusion."""
    cost = F.col("fp") * cost_fp + F.col("fn") * cost_fn
    best = F.min_by(F.struct("t", cost.alias("cost"), "tp", "fp", "fn", "tn"), F.struct(cost, F.col("t")))
    return thresholds(rows, by, steps).groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.t").alias("threshold"), "b.cost", "b.tp", "b.fp", "b.fn", "b.tn")


def cost_curve(rows: DataFrame, by: Sequence[str], ratios: Sequence[int] = COST_RATIO_GRID) -> DataFrame:
    """The cheapest threshold for each cost ratio."""
    every = thresholds(rows, by).withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    cost = F.col("fp") + F.col("fn") * F.col("ratio")
    best = every.groupBy(*by, "ratio").agg(F.min_by(F.struct("t", cost.cast("double").alias("cost")), F.struct(cost, F.col("t"))).alias("b"))
    return best.select(*by, "ratio", F.col("b.t").alias("threshold"), "b.cost")


def confusion_at(rows: DataFrame, by: Sequence[str], t: float) -> DataFrame:
    hit = F.col("p_break") >= t
    yes = F.col("label") == 1
    got = rows.groupBy(*by).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    return got.withColumns({"tpr": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp"))})


def calibration_bins(rows: DataFrame, n: int = 5) -> DataFrame:
    """Equal-width bins, the last closed on the right; empty ones are left out."""
    edges = [i / n for i in range(1, n)]
    place = sum((F.when(F.col("p_break") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p_break").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("break_rate"))


def probability_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Base rate, Brier score and log loss."""
    p, y = F.col("p_break"), F.col("label")
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    loss = -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y.cast("double")).alias("base_rate"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"))


def scorecard(rows: DataFrame, min_n: int = MIN_SAMPLE_N) -> DataFrame:
    """AUC, average precision and the cheapest threshold for all deals and for cohorts by quarter, geography and deal type."""
    quarter = F.concat(F.year("announce_date").cast("string"), F.lit("-Q"), F.quarter("announce_date").cast("string"))
    named = F.array(
        F.concat(F.lit("all"), F.lit("")), F.concat(F.lit("quarter:"), quarter), F.concat(F.lit("geography:"), F.coalesce("geography", F.lit("?"))), F.concat(F.lit("deal_type:"), F.coalesce("deal_type", F.lit("?")))
    )
    long = rows.select(F.explode(named).alias("cohort"), "p_break", "label")
    steps = by_score(long, ["cohort"])
    best = optimal_threshold(long, ["cohort"], steps=steps)
    return auc(long, ["cohort"], steps).join(best, "cohort").withColumns({"base_rate": F.col("n_pos") / F.col("n"), "thin": F.col("n") < min_n})
