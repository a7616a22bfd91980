"""Simulation, model, fingerprint."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tidemark.operators import model, review, simulation


def book(spark, n=40):
    return spark.createDataFrame([(i, 0.1, 100.0, 20.0) for i in range(n)], "deal_id long, p_break double, downside_notional double, upside_notional double")


def test_simulation_is_unbiased_and_reproducible(spark):
    a = simulation.simulate(book(spark), paths=6000, rho=0.15, seed=1).toPandas()
    b = simulation.simulate(book(spark).repartition(7), paths=6000, rho=0.15, seed=1).toPandas()
    assert len(a) == 6000 and a.breaks.mean() == pytest.approx(4.0, rel=0.05)
    a, b = a.sort_values("path").reset_index(drop=True), b.sort_values("path").reset_index(drop=True)
    assert (a.breaks == b.breaks).all() and np.allclose(a.pnl, b.pnl)


def test_correlation_fattens_the_tail(spark):
    tails = []
    for rho in (0.0, 0.5):
        report = {r["level"]: r for r in simulation.risk_report(simulation.simulate(book(spark), paths=4000, rho=rho)).collect()}
        assert report[0.99]["expected_shortfall"] >= report[0.99]["value_at_risk"] >= 0
        tails.append(report[0.99]["expected_shortfall"])
    assert tails[1] > tails[0]


def training(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 2 * x)))).astype(float)
    rows = [(i, date(2020 + i % 3, 1, 1), date(2020 + i % 3, 6, 1), float(y[i]), None if i % 10 == 0 else float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "deal_id long, announce_date date, resolution_date date, label double, x1 double")


def test_logit_recovers_the_slope(spark):
    rows = training(spark)
    fitted = model.fit(rows, ["x1"])
    assert fitted[1].coefficients[0] > 1
    p = model.predict(rows, fitted).agg(F.avg("p_model").alias("p"), F.avg("label").alias("y")).first()
    assert p["p"] == pytest.approx(p["y"], abs=0.01)
    with pytest.raises(model.InsufficientData):
        model.fit(rows.limit(10), ["x1"])


def test_walk_forward_scores_only_later_deals(spark):
    got = model.walk_forward(training(spark), ["x1"], ("2020-12-31", "2021-12-31", "2022-12-31"))
    assert got.where("announce_date <= train_cutoff").count() == 0 and got.count() == 200


def test_fingerprint_sees_content_not_order(spark):
    rows = training(spark, 50)
    cols = rows.columns
    one = spark_rows(model.fingerprint(rows, cols))
    assert one == spark_rows(model.fingerprint(rows.repartition(5), cols))
    assert one != spark_rows(model.fingerprint(rows.withColumn("label", F.when(F.col("deal_id") == 7, 1 - F.col("label")).otherwise(F.col("label"))), cols))


@pytest.mark.parametrize(("n", "method"), [(400, "isotonic"), (60, "platt"), (8, "none")])
def test_calibration(spark, n, method):
    """Scores twice too high come down to the rate of breaks; missing ones stay missing."""
    sample = spark.range(n).selectExpr("(id % 10) / 10.0D as p_break", "cast(id div 10 % 20 < id % 10 as int) as label")
    rows = spark.createDataFrame([(1, 0.2), (2, 0.8), (3, None)], "deal_id long, p_break double")
    got = {r["deal_id"]: r for r in review.calibrated(sample, rows).collect()}
    assert {r["method"] for r in got.values()} == {method} and got[3]["p_calibrated"] is None
    assert got[1]["p_calibrated"] <= got[2]["p_calibrated"]
    if method == "none":
        assert got[2]["p_calibrated"] == 0.8
    if method == "isotonic":
        assert got[2]["p_calibrated"] == pytest.approx(0.4, abs=0.1)


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_exact_quantiles_of_all_columns_at_once(spark, q):
    rng = np.random.default_rng(int(q * 10))
    columns = {"a": rng.normal(size=501) * 10.0 ** rng.integers(-300, 300, 501).astype(float), "b": rng.integers(-2, 3, 501).astype(float), "c": np.full(501, -0.0), "d": np.where(rng.random(501) < 0.9, np.nan, rng.random(501))}
    rows = [tuple(None if name == "d" and np.isnan(v[i]) else float(v[i]) for name, v in columns.items()) + (None,) for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = model.exact_quantile(df, ["a", "b", "c", "d", "e"], q)
    for name, v in columns.items():
        assert got[name] == pytest.approx(np.quantile(v[~np.isnan(v)], q), rel=1e-12, abs=0), name
    assert got["e"] is None and model.exact_quantile(df.limit(0), ["a"]) == {"a": None}
    assert got["a"] == pytest.approx(df.agg(F.percentile("a", F.lit(q))).first()[0], rel=1e-12)


def test_windows_that_cannot_be_fitted_have_a_status(spark):
    rows = training(spark)
    cuts = ("2000-01-01", "2020-12-31", "2021-12-31", "2022-12-31", "2023-12-31", "2024-12-31")
    status = {r["window"]: r for r in model.walk_forward_status(rows, cuts).collect()}
    assert [status[i]["status"] for i in range(5)][-1] == "no_test_rows" and status[0]["n_train"] == 0
    assert status[0]["status"] in ("no_test_rows", "insufficient_data") and status[0]["train_prevalence"] is None
    assert "fitted" in {r["status"] for r in status.values()}
    scored = model.walk_forward(rows, ["x1"], cuts, spread="x1")
    fitted = {str(r["train_cutoff"]) for r in status.values() if r["status"] == "fitted"}
    assert {str(r[0]) for r in scored.select("train_cutoff").distinct().collect()} == fitted
    assert scored.where("abs(p_model - p_spread) > 1e-9 or p_constant is null").count() == 0
    assert model.walk_forward(rows.limit(3), ["x1"], cuts).count() == 0


def pooled(points):
    """Pool adjacent violators on one node: (score, label) -> fitted value by score."""
    blocks = []
    by = {}
    for s, y in points:
        by.setdefault(s, []).append(y)
    for s in sorted(by):
        blocks.append([sum(by[s]), len(by[s]), [s]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, scores = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + scores]
    return {s: total / n for total, n, scores in blocks for s in scores}


def test_isotonic_calibration_is_exact(spark):
    rng = np.random.default_rng(9)
    scores = np.concatenate([rng.random(600), rng.integers(0, 40, 600) / 40, 0.5 + rng.integers(0, 9, 300) * 1e-7])
    labels = (rng.random(1500) < scores).astype(int)
    sample = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "p_break double, label int").repartition(6)
    got = {r["p_break"]: r["p_calibrated"] for r in review.calibrated(sample, sample.select("p_break").distinct()).collect()}
    expected = pooled(zip(scores.tolist(), labels.tolist()))
    assert all(got[s] == pytest.approx(min(max(v, 1e-6), 1 - 1e-6), abs=1e-9) for s, v in expected.items())
