"""Cached coverage rows and prints, by hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import coverage

ROW = "deal_id int, tiingo_n int, yahoo_n int, tiingo_status string, yahoo_status string, row_schema_version int, overlap_sessions int, exact_matches int, tolerable_matches int, material_conflicts int, canonical_status string, identity_proofs string, reconcile_rule string, tiingo_identity_verified boolean"
FULL = ("s", "A", "r", True)


def test_old_rows_are_migrated_only_on_what_they_say(spark):
    rows = [
        (1, 3, 3, "AVAILABLE", "AVAILABLE", 2, 3, 2, 1, 0, *FULL), (2, 3, 3, "AVAILABLE", "AVAILABLE", None, 3, 2, 1, 0, *FULL), (3, 0, 3, "NO_HISTORY", "AVAILABLE", 1, None, None, None, None, *FULL), (4, 3, 3, "AVAILABLE", "AVAILABLE", 1, 3, None, 1, 0, *FULL),
        (5, 0, None, "PROVIDER_ERROR", None, 2, 0, 0, 0, 0, *FULL), (6, 1, 0, "TRANSIENT_FAILURE", None, 1, 0, 0, 0, 0, *FULL), (7, 3, 3, "AVAILABLE", "AVAILABLE", 1, 3, 2, 0, 0, *FULL), (8, 3, 3, "AVAILABLE", "AVAILABLE", 2, 3, 2, 1, 0, "s", None, "r", True), (9, 1, 1, "AVAILABLE", "TRANSIENT_FAILURE", 2, 0, 0, 0, 0, *FULL),
    ]
    got = {r["deal_id"]: (r["cache"], r["row_schema_version"], r["exact_matches"]) for r in coverage.cached_rows(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {
        1: ("reuse", 2, 2), 2: ("migrated", 2, 2), 3: ("migrated", 2, 0), 4: ("unclassified_overlap", 1, None), 5: ("infrastructure", 2, 0), 6: ("infrastructure", 1, 0), 7: ("overlap_mismatch", 1, 2), 8: ("missing_identity_proofs", 2, 2), 9: ("not_reusable", 2, 0),
    }


def test_failures_are_tried_again_within_bounds(spark):
    rows = spark.createDataFrame([("AVAILABLE", None, 9), ("TRANSIENT_FAILURE", True, 2), ("TRANSIENT_FAILURE", True, 3), ("TRANSIENT_FAILURE", False, None), ("TRANSIENT_FAILURE", None, 3), (None, None, None)], "s string, h boolean, n int")
    got = [r[0] for r in rows.select(coverage.retry_decision(F.col("s"), F.col("h"), F.col("n"))).collect()]
    assert got == ["accept", "hourly_wait", "unresolved", "bounded_retry", "unresolved", "accept"]


def test_a_batch_that_comes_again_adds_nothing(spark):
    kind = "n int, deal_id string, observed_at timestamp_ntz, target_price double, source_name string, source_identifier string, known_at timestamp_ntz, outcome_hint string"
    t = datetime(2026, 1, 5)
    batch = spark.createDataFrame([(1, "d", t, 5.0, "s", "u", t, "x"), (2, "d", t, 6.0, "s", "u", t, "x"), (3, "d", t, 0.0, "s", "u", None, "x"), (4, "zz", t, 5.0, "s", "u", t, "x"), (5, None, None, None, None, None, None, None)], kind)
    deals = spark.createDataFrame([("d",), ("d",)], "deal_id string")
    got = coverage.ingested_prints(batch, deals, batch.limit(0), "n")
    assert [(r["outcome"], r["problems"].count(";")) for r in got.orderBy("n").collect()] == [("accepted", 0), ("duplicate", 0), ("quarantined", 1), ("quarantined", 0), ("quarantined", 4)]
    again = coverage.ingested_prints(batch, deals, got.where("outcome = 'accepted'"), "n")
    assert again.where("outcome = 'accepted'").count() == 0
