"""States at many cut-offs by one sweep, as-of joins over ranges of a hot key, broadcasts of measured tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tidemark.operators import evidence, model, ordering, pit
from tidemark.plans import carriers

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def facts(spark, n, seed, deals=7, span=200):
    rng = random.Random(seed)
    price = lambda: rng.choice([None, 1.0 * rng.randint(1, 9)])
    rows = [(rng.choice([None, *range(deals)]), i, rng.choice([None, *range(span)]), rng.choice([None, *range(span)]), price(), price()) for i in range(n)]
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600).cast("timestamp_ntz").alias(c)
    return rows, spark.createDataFrame(rows, "deal_id long, seq long, observed_at long, known_at long, a double, b double").select("deal_id", "seq", at("observed_at"), at("known_at"), "a", "b")


@pytest.mark.parametrize("cuts", [[], [0], [199, 5, 5, 80], range(0, 230, 3), range(-5, 400)])
def test_states_at_any_cutoffs(spark, cuts):
    rows, df = facts(spark, 300, len(cuts))
    cutoffs = spark.createDataFrame([(c,) for c in cuts], "c long").select(F.timestamp_seconds(F.col("c") * 3600).cast("timestamp_ntz").alias("cutoff"))
    got = pit.state_as_of(df, cutoffs, ["a", "b"], ["observed_at", "known_at", "seq"], "observed_at", stale={"a": 2}, provenance=["seq"])
    seen = {(r["deal_id"], r["h"]): (r["a"], r["a_seq"], r["b"], r["b_seq"]) for r in got.withColumn("h", (F.unix_seconds(F.col("cutoff").cast("timestamp")) / 3600).cast("long")).collect()}
    expected = {}
    for c in set(cuts):
        for deal in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == deal and r[2] is not None and r[3] is not None and max(r[2], r[3]) <= c]
            if own:
                last = [max((r for r in own if r[k] is not None), key=lambda r: (r[2], r[3], r[1]), default=None) for k in (4, 5)]
                a = last[0] if last[0] and (c - last[0][2]) * 3600 <= 2 * 86400 else None
                expected[deal, c] = (a and a[4], a and a[1], last[1] and last[1][5], last[1] and last[1][1])
    assert seen == expected
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_ten_thousand_cutoffs_make_no_pairs(spark):
    _, df = facts(spark, 200, 1)
    cutoffs = spark.range(10_000).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("cutoff"))
    got = pit.state_as_of(df, cutoffs, ["a"], ["observed_at", "known_at", "seq"], "observed_at")
    assert "NestedLoop" not in plan(got) and got.agg(F.count_distinct("cutoff")).first()[0] > 9_000


def test_statuses_by_the_sweep_are_those_of_the_records_in_effect(spark):
    records = carriers.evidence(spark, SF)
    cutoffs = spark.sql("select explode(sequence(timestamp_ntz '2023-12-30 00:00:00', timestamp_ntz '2024-02-10 00:00:00', interval 31 hours)) as cutoff")
    slow = evidence.status(evidence.effective(records, cutoffs)).select("event_id", "cutoff", "status")
    got = evidence.status_at(records, cutoffs)
    assert spark_rows(got) == spark_rows(slow) and "NestedLoop" not in plan(got)


def test_predictions_at_cutoffs(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), rng.randint(0, 40), rng.randint(0, 40), f"run{rng.randint(0, 2)}", rng.random()) for _ in range(200)]
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c).cast("int")).alias(c)
    df = spark.createDataFrame(rows, "deal_id long, as_of long, training_cutoff long, model_run_id string, p_break double").select("deal_id", day("as_of"), day("training_cutoff"), "model_run_id", "p_break")
    got = {(r["deal_id"], r["c"]): (r["a"], r["state"]) for r in model.prediction_as_of(df, spark.range(60).select(day("id").alias("cutoff"))).select("deal_id", F.datediff("cutoff", F.lit("2024-01-01")).alias("c"), F.datediff("as_of", F.lit("2024-01-01")).alias("a"), "state").collect()}
    expected = {}
    for deal in range(5):
        for c in range(60):
            own = [r for r in rows if r[0] == deal and r[2] <= r[1] <= c]
            if own:
                last = max(r[1] for r in own)
                expected[deal, c] = (last, "ok" if len({r[3] for r in own if r[1] == last}) == 1 else "ambiguous")
    assert got == expected


@pytest.mark.parametrize("keys", [1, 3, 500])
def test_as_of_join_splits_a_hot_key(spark, keys):
    rng = random.Random(keys)
    left = [(rng.randrange(keys), rng.randrange(500), i) for i in range(3_000)]
    right = [(rng.randrange(keys), rng.randrange(500), i, 1.0 * i) for i in range(2_000)]
    ldf, rdf = spark.createDataFrame(left, "k long, t long, n long"), spark.createDataFrame(right, "k long, u long, seq long, v double")
    got = {r["n"]: r["v"] for r in pit.as_of_join(ldf, rdf, "k", "t", "u", ["v"], "seq").collect()}
    by_key = {}
    for r in right:
        by_key.setdefault(r[0], []).append(r)
    expected = {n: max(((u, seq, v) for _, u, seq, v in by_key.get(k, []) if u <= t), default=(0, 0, None))[2] for k, t, n in left}
    assert got == expected


def test_ranges_of_one_key_are_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        one_key(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def one_key(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("t"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    carried = ordering.running_max(rows, ["k"], ["t"], "v")
    tasks = carried.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 1 and max(r["n"] for r in tasks) < 30_000
    assert carried.where("t = 2").agg(F.max("v")).first()[0] == 39_998 - 39_998 % 7


def test_tables_made_on_the_driver_are_measured(spark):
    few = spark.createDataFrame([(i, "x" * 10) for i in range(5)], "a long, b string")
    many = spark.createDataFrame([("x" * 1000,)] * 200, "a string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(ordering.small(few)) and ordering.measured(few) < 1_000
    assert ordering.measured(many) > 200_000
