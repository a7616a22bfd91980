"""Canonical events and deals: merging by id, outcomes as of a time, names and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import short_hash

#: Verification levels by rank, and those good enough for a label.
VERIFICATION_RANK = {"sec_metadata_confirmed": 4, "press_multi": 3, "press_single": 2, "unverified_staging": 1, "reported_only": 0}
LABEL_GRADE = ("sec_metadata_confirmed", "press_multi")


def event_ids(rows: DataFrame) -> DataFrame:
    """``event_id`` from what the event is: deal, type and valid date."""
    return rows.withColumn("event_id", short_hash(F.col("deal_id"), F.col("event_type"), F.date_format("valid_at", "yyyy-MM-dd")))


def merge_events(rows: DataFrame) -> DataFrame:
    """One row per event id: how much evidence, the best level, the primary evidence (best level, then earliest known, then id), all sources.

    Merging again changes nothing.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in VERIFICATION_RANK.items() for x in kv]), F.col("level"))
    order = F.struct(-rank, F.col("known_at"), F.col("evidence_id"))
    return rows.groupBy("event_id").agg(
        F.min("deal_id").alias("deal_id"), F.min("event_type").alias("event_type"), F.min("valid_at").alias("valid_at"), F.count_distinct("evidence_id").alias("n_evidence"), F.min_by("level", order).alias("level"),
        F.min_by("evidence_id", order).alias("primary_id"), F.min_by("known_at", order).alias("known_at"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )


def outcome_as_of(events: DataFrame, cutoff: Column) -> DataFrame:
    """Y0 closed, Y1 broken, a conflict to review, or censored; only label-grade evidence counts."""
    seen = events.where((F.col("valid_at") <= cutoff) & (F.col("known_at") <= cutoff))
    good = F.col("level").isin(*LABEL_GRADE)
    closed, broken = good & (F.col("event_type") == "closing"), good & F.col("event_type").isin("termination", "withdrawal")
    rows = events.select("deal_id").distinct().join(
        seen.groupBy("deal_id").agg(F.bool_or(closed).alias("c"), F.bool_or(broken).alias("b"), F.min_by("event_id", F.when(closed | broken, F.struct("valid_at", "event_type", "event_id"))).alias("resolution_event_id")), "deal_id", "left"
    )
    out = F.when(F.col("c") & F.col("b"), "conflict").when(F.col("c"), "Y0_closed").when(F.col("b"), "Y1_broken").otherwise("censored")
    return rows.select("deal_id", out.alias("outcome_candidate"), F.when(out.isin("Y0_closed", "Y1_broken"), F.col("resolution_event_id")).alias("resolution_event_id"))


def reconcile_ids(reviewed: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Ids on one side only; empty if both sides match."""
    a, b = reviewed.select(key, F.lit(True).alias("in_reviewed")), staged.select(key, F.lit(True).alias("in_staged"))
    both = a.join(b, key, "full_outer")
    return both.where("in_reviewed is null or in_staged is null").select(key, F.when(F.col("in_reviewed").isNull(), "staged_only").otherwise("reviewed_only").alias("side"))


def common_universe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each id with where it occurs: both, a_only or b_only."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "a_only").otherwise("b_only").alias("side"))
