"""Adding the future changes nothing about the past."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tidemark.operators import evidence, market, pit
from tidemark.plans import carriers as c

SF = "/root/testdata/sf0.001"
T = "2024-01-15 00:00:00"


def cut(text=T):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("operator", ["state", "label", "disposition", "prints", "panel"])
def test_point_in_time(spark, operator):
    cutoffs = spark.range(1).select(cut().alias("cutoff"))
    run = {
        "state": lambda o, e: pit.state_as_of(o, cutoffs, ["target_price", "offer_price"], ["observed_at", "known_at", "seq"], "observed_at", stale=pit.STALE_PRINT),
        "label": lambda o, e: pit.first_resolution(e, cut()),
        "disposition": lambda o, e: pit.training_disposition(c.lifecycle(spark, SF).select("deal_id").distinct(), e, cut()),
        "prints": lambda o, e: pit.print_series(o, cut()),
        "panel": lambda o, e: pit.spread_panel(o, e, cut()),
    }[operator]
    obs, events = c.observations(spark, SF), c.lifecycle(spark, SF)
    past = F.col("known_at") <= cut()
    assert spark_rows(run(obs, events)) == spark_rows(run(obs.where(past), events.where(past)))


@pytest.mark.parametrize("value", ["z", "pctile", "signal"])
def test_series(spark, value):
    rows = c.market(spark, SF).where("series_id in ('1-URGENT', '2-HIGH')")
    early = rows.where("obs_date <= date'1997-06-30'")
    run = {
        "z": lambda r: market.zscore(r, "close", 10),
        "pctile": lambda r: market.expanding_percentile(r, "close"),
        "signal": lambda r: market.add_metrics(r.drop("mtd_return")).withColumn("signal", market.classify()).drop("mtd_return"),
    }[value]
    assert spark_rows(run(rows).where("obs_date <= date'1997-06-30'")) == spark_rows(run(early))


def test_status(spark):
    rows = c.evidence(spark, SF)
    at = datetime(2026, 9, 1)
    early = evidence.status_history(rows.where(F.col("known_at") <= F.lit(at)))
    assert spark_rows(evidence.status_history(rows).where(F.col("as_of_utc") <= F.lit(at))) == spark_rows(early)


def test_order_of_rows_does_not_matter(spark):
    rows = c.evidence(spark, SF)
    assert spark_rows(evidence.status_history(rows)) == spark_rows(evidence.status_history(rows.orderBy(F.rand(1))))


def test_an_offer_counts_from_when_it_is_known(spark):
    """The offer of day 2 is known on day 4 only; the late correction of day 1 doesn't replace it then."""
    day = "timestamp_ntz'2024-01-0{} 00:00:00'"
    rows = [(1, 1, 1, None, 10.0), (2, 2, 4, None, 20.0), (3, 1, 5, None, 11.0), (4, 3, 3, 5.0, None), (5, 4, 4, 5.0, None), (6, 6, 6, 5.0, None)]
    obs = spark.createDataFrame(rows, "seq long, a int, b int, target_price double, offer_price double").selectExpr(
        "1L as deal_id", "seq", f"{day.format(1)} + make_dt_interval(a - 1) as observed_at", f"{day.format(1)} + make_dt_interval(b - 1) as known_at", "target_price", "offer_price"
    )
    got = {r["seq"]: r["offer_price"] for r in pit.print_series(obs, cut()).collect()}
    assert got == {4: 10.0, 5: 20.0, 6: 20.0}
