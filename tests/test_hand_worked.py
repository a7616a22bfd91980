"""Numbers worked out by hand."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import dates, extract, finance, text
from tidemark.operators import deals, evaluation, evidence, features, market, pit, prices, warehouse

SERIES = "series_id string, obs_date date, close double"


def series(spark, closes, name="s", start=20):
    days = [date(2026, 4, d) for d in (20, 21, 22, 23, 24, 27, 28, 29, 30)]
    return spark.createDataFrame([(name, days[i], c) for i, c in enumerate(closes)], SERIES)


def by_day(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("obs_date").collect()]


def test_locked_constants():
    assert (config.COST_FP, config.COST_FN, config.COST_RATIO_GRID, config.MIN_SAMPLE_N) == (1.0, 15.0, (5, 10, 15, 20), 20)
    assert (config.RULESET, config.BUY_THRESHOLD, config.SELL_THRESHOLD, config.MA_WINDOW) == ("ma5_v1", 0.0025, -0.0025, 5)
    assert config.POSITIVE_CLASS == "broken" and config.CENSOR_STATUS == "pending" and len(config.EVENT_TYPES) == 19


def test_gap_is_not_padded(spark):
    got = by_day(market.add_metrics(series(spark, [100.0, None, 102.0, 103.0, 104.0])), "daily_return", "n_window", "window_complete")
    assert [g[0] for g in got][:3] == [None, None, None]
    assert got[4][1:] == (4, False)


@pytest.mark.parametrize(("closes", "label"), [([100, 100.5, 101, 101.5, 108], "BUY"), ([100, 101, 102, 103, 103.05], "HOLD"), ([100, 101, 102, 103, None], "NO_DATA"), ([100, 99, 98, 97, 90], "SELL")])
def test_signal(spark, closes, label):
    rows = market.add_metrics(series(spark, [None if c is None else float(c) for c in closes])).withColumn("signal", market.classify())
    assert by_day(rows, "signal")[-1] == label


def test_month_to_date_anchor_is_the_first_print(spark):
    assert by_day(market.add_metrics(series(spark, [None, 200.0, 210.0])), "mtd_return")[2] == pytest.approx(0.05)


def test_expanding_percentile(spark):
    got = by_day(market.expanding_percentile(series(spark, [2.0, 1.0, None, 3.0, 2.0]), "close"), "pctile")
    assert got == [1.0, 0.5, None, 1.0, 0.75]


def test_flat_window_has_no_score(spark):
    assert by_day(market.zscore(series(spark, [5.0] * 4), "close", 3), "z") == [None] * 4


def test_expected_value(spark):
    one = spark.range(1).select(finance.break_adjusted_ev(F.lit(100.0), F.lit(95.0), F.lit(80.0), F.lit(0.1)).alias("ev")).first()
    assert one["ev"] == pytest.approx(3.0)


def test_tied_rank_auc(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.2, 0), ("a", 0.9, 1)], "g string, p_break double, label int")
    got = evaluation.auc(rows, ["g"]).first()
    assert got["roc_auc"] == pytest.approx(0.875)
    one_class = evaluation.auc(rows.where("label = 1"), ["g"]).first()
    assert one_class["roc_auc"] is None and one_class["average_precision"] is None


def test_threshold_takes_the_smallest_of_equal_costs(spark):
    rows = spark.createDataFrame([("a", 0.6, 1), ("a", 0.7, 1), ("a", 0.2, 0), ("a", 0.3, 0)], "g string, p_break double, label int")
    got = evaluation.optimal_threshold(rows, ["g"]).first()
    assert (got["threshold"], got["cost"], got["tp"], got["tn"]) == (0.6, 0.0, 2, 2)


TRADE = "deal_id string, entry_date date, entry_price double, offer_price double, unaffected_price double, expected_close_date date, status string, resolution_date date, capital double, consideration_type string, break_exit_price double, break_exit_source string, break_exit_date date, p_break double, p_break_as_of date"


def trade(**x):
    base = dict(deal_id="d", entry_date=date(2026, 1, 1), entry_price=95.0, offer_price=100.0, unaffected_price=80.0, expected_close_date=None, status="closed", resolution_date=date(2026, 7, 1), capital=1e6, consideration_type="cash", break_exit_price=None, break_exit_source=None, break_exit_date=None, p_break=None, p_break_as_of=None)
    return tuple((base | x).values())


def test_trades(spark):
    rows = [
        trade(deal_id="closed"),
        trade(deal_id="modeled", status="broken"),
        trade(deal_id="sourced", status="broken", break_exit_price=83.0, break_exit_source="tape", break_exit_date=date(2026, 7, 1)),
        trade(deal_id="pending", status="pending", resolution_date=None),
        trade(deal_id="stock", consideration_type="stock"),
        trade(deal_id="late", p_break=0.1, p_break_as_of=date(2026, 1, 2)),
        trade(deal_id="unresolved", status="broken", unaffected_price=None),
    ]
    got = {r["deal_id"]: r for r in deals.evaluate_trades(spark.createDataFrame(rows, TRADE), bps=0.0).collect()}
    assert got["closed"]["realized_pnl"] == pytest.approx(1e6 / 95 * 5) and got["closed"]["holding_days"] == 181
    assert got["modeled"]["modeled_break_pnl"] == pytest.approx(-15 / 95 * 1e6) and got["modeled"]["realized_pnl"] is None
    assert got["sourced"]["realized_pnl"] == pytest.approx(-12 / 95 * 1e6)
    assert got["pending"]["censored"] and got["pending"]["pnl_type"] is None
    assert got["stock"]["validation_error"] == "unsupported_consideration" and got["late"]["validation_error"] == "prediction_after_entry"
    assert got["unresolved"]["pnl_type"] == "unresolved_exit"


def test_concentration_and_loss(spark):
    book = spark.createDataFrame([("a", 300.0, 0.2, 100.0, "x", None, None, "antitrust"), ("b", 100.0, 0.1, 50.0, None, "S", None, "financing")], "deal_id string, capital double, p_break double, downside_notional double, sector string, sponsor string, geography string, break_vector string")
    got = {r["bucket"]: r for r in deals.concentration(book, "sector").collect()}
    assert set(got) == {"x", "?"} and got["x"]["hhi"] == pytest.approx(0.75**2 + 0.25**2)
    stress = {r["scenario"]: r for r in deals.stress_table(book).collect()}
    assert stress["antitrust_shock"]["scenario_expected_loss"] == pytest.approx(105.0) and stress["cfius_shock"]["positions_stressed"] == 0
    assert stress["broad_risk_off"]["scenario_expected_loss"] == pytest.approx(0.35 * 150)


def test_drawdown_peak_starts_at_zero(spark):
    pnl = spark.createDataFrame([("b", "1", date(2026, 1, 1), -100.0), ("b", "2", date(2026, 1, 2), 300.0), ("b", "3", date(2026, 1, 3), -250.0)], "book string, deal_id string, date date, pnl double")
    assert [r["drawdown"] for r in deals.drawdown(pnl, "book").orderBy("date").collect()] == [-100.0, 0.0, -250.0]


def test_bare_dates(spark):
    got = spark.sql("select '2026-01-05' as t").select(dates.as_of(F.col("t")).alias("a"), dates.stored(F.col("t")).alias("s"), dates.stored(F.lit("2026-01-05T10:00:00Z")).alias("z")).first()
    assert got["a"] == datetime(2026, 1, 5, 23, 59, 59, 999999) and got["s"] == datetime(2026, 1, 5) and got["z"] is None


def test_partial_dates(spark):
    rows = spark.createDataFrame([("2024",), ("2024-02",), ("2024-02-03",), ("2024-02-03T04:05",), ("x",)], "t string")
    got = {r["s"]["value"]: (r["s"]["precision"], r["s"]["earliest"], r["s"]["latest"]) for r in rows.select(dates.stamp(F.col("t")).alias("s")).collect()}
    assert got["2024"] == ("year", datetime(2024, 1, 1), datetime(2024, 12, 31, 23, 59, 59))
    assert got["2024-02"][2] == datetime(2024, 2, 29, 23, 59, 59) and got["2024-02-03T04:05"][:2] == ("minute", datetime(2024, 2, 3, 4, 5))
    assert got["x"][0] is None


def test_event_known_later_is_invisible(spark):
    rows = spark.createDataFrame([("d", 1, datetime(2026, 1, 1), datetime(2026, 1, 10), "announcement")], "deal_id string, seq long, event_at timestamp_ntz, known_at timestamp_ntz, event_type string")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    assert pit.visible(rows, at("2026-01-05"), "event_at").count() == 0 and pit.visible(rows, at("2026-01-11"), "event_at").count() == 1


def test_versions_close(spark):
    rows = spark.createDataFrame([("d", date(2026, 1, i), s) for i, s in ((1, "pending"), (2, "pending"), (3, "closed"))], "deal_id string, day date, status string")
    got = warehouse.scd2(rows, "deal_id", "day", ["status"]).orderBy("valid_from").collect()
    assert [(r["status"], r["valid_to"], r["is_current"]) for r in got] == [("pending", date(2026, 1, 3), False), ("closed", date(9999, 12, 31), True)]


def test_names(spark):
    pairs = [("The Acme Corp.", "ACME Holdings Inc", True), ("Acme & Sons", "Acme", True), ("Acme", "Apex", False), ("The Inc", "The Inc", False), (None, "Acme", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r["got"] == r["same"] for r in rows.withColumn("got", text.names_agree(F.col("a"), F.col("b"))).collect())


def test_urls(spark):
    got = spark.range(1).select(text.canonical_url(F.lit("HTTPS://User@Ex.COM/a/b/?utm_source=1&b=2&a=1#f")).alias("u")).first()["u"]
    assert got == "https://ex.com/a/b?a=1&b=2"


def test_terms(spark):
    body = "for $12.50 per share in cash, or $12.50 in cash per share, not $99 per share in cash, and 0.5 of a share of X (NASDAQ: ABC)"
    found = spark.createDataFrame([(body,)], "t string").select(extract.deal_terms(F.col("t")).alias("f"))
    f, got = found.select("f", extract.decided_terms(F.col("f")).alias("t")).first()
    assert sorted(f["cash"]) == [12.5, 12.5, 12.5, 99.0, 99.0] and f["ratio"] == [0.5] and not f["unsupported"]
    assert (got["offer_price"], got["consideration_type"], got["reason"]) == (12.5, "cash", None)


def test_two_independent_publishers_corroborate(spark):
    kind = "evidence_id long, event_id string, publisher string, stance string, claim_type string, source_type string, retrieved boolean, known_at timestamp_ntz, valid_at timestamp_ntz, revises long, revision_kind string"
    t = [datetime(2026, 1, d) for d in range(1, 8)]
    rows = spark.createDataFrame(
        [
            (1, "e", "p1", "supports", "occurred", "reputable_secondary", True, t[0], t[0], None, None),
            (2, "e", "p2", "supports", "occurred", "reputable_secondary", True, t[2], t[0], None, None),
            (3, "e", "p3", "contradicts", "occurred", "reputable_secondary", True, t[4], t[0], None, None),
            (4, "e", "p3", "supports", "occurred", "reputable_secondary", True, t[6], t[0], 3, "retraction"),
            (5, "e", "p9", "supports", "occurred", "ai_brief", True, None, t[0], None, None),
        ],
        kind,
    )
    got = [(r["as_of_utc"], r["status"]) for r in evidence.status_history(rows).orderBy("as_of_utc").collect()]
    assert got == [(t[0], "ATTRIBUTED_CLAIM"), (t[2], "CORROBORATED_SECONDARY"), (t[4], "DISPUTED"), (t[6], "CORROBORATED_SECONDARY")]
    since = evidence.admissible_since(evidence.status_history(rows), F.lit("2026-02-01").cast("timestamp_ntz")).first()
    assert since["admissible_since"] == t[6]


@pytest.mark.parametrize(("a", "b", "rule"), [(10.0, 10.0, "EXACT"), (10.0, 10.005, "TOLERABLE"), (10.0, 10.5, "CONFLICT")])
def test_price_agreement(spark, a, b, rule):
    assert spark.range(1).select(finance.price_agreement(F.lit(a), F.lit(b), 0.01, 1e-4).alias("r")).first()["r"] == rule


def test_stale_context_is_null(spark):
    rows = spark.createDataFrame([("vix", datetime(2026, 1, 1), 1, 20.0)], "field string, at timestamp_ntz, seq long, value double")
    assert features.snapshot(rows, F.lit("2026-01-03").cast("timestamp_ntz")).first()["value"] == 20.0
    assert features.snapshot(rows, F.lit("2026-01-09").cast("timestamp_ntz")).first()["value"] is None


def test_ambiguous_identity_stops_the_chain(spark):
    rows = spark.createDataFrame([("x", 1, "t", "NO_HISTORY"), ("x", 2, "y", "ok"), ("z", 1, "t", "IDENTITY_AMBIGUOUS"), ("z", 2, "y", "ok")], "deal_id string, place int, provider string, status string")
    got = {r["deal_id"]: (r["chosen_place"], r["result"]) for r in prices.fallback_choice(rows).collect()}
    assert got == {"x": (2, "OK"), "z": (None, "IDENTITY_AMBIGUOUS")}


def test_time_points_and_codes(spark):
    cells = [None, " ", "N/D", "2026-02-30", "2026-02-28", "2026-02-28T10:00:00", "2026-02-28 10:00:00+02:00", "soon"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, t string")
    got = [tuple(r["p"]) for r in rows.orderBy("i").select(dates.time_point(F.col("t")).alias("p")).collect()]
    assert [g[0] for g in got] == [None, None, None, "refused", "day", "refused", "second", "refused"]
    assert got[4][1] == datetime(2026, 2, 28, 23, 59, 59, 999999) and got[6][1] == datetime(2026, 2, 28, 8)
    names = spark.createDataFrame([("The Big Company, Inc.",), ("A B",), ("3M Co",), ("Co",)], "n string")
    assert [r[0] for r in names.select(text.ticker_token(F.col("n"))).collect()] == ["BIG", "B", "3M", "UNK"]


def test_running_sums_over_ranges_equal_a_window(spark):
    from pyspark.sql import Window
    from tidemark.operators.ordering import running_sums

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, null, if(id % 1000 = 1, 'rare', 'hot')) AS k", "hash(id) AS o", "id % 7 AS x", "id AS y")
    w = Window.partitionBy("k").orderBy(F.col("o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"sx": F.sum("x").over(w), "sy": F.sum("y").over(w)})
    got = running_sums(rows, ["k"], [F.col("o").desc()], {"sx": "x", "sy": "y"})
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert running_sums(rows.limit(0), ["k"], [F.col("o").desc()], {"sx": "x"}).count() == 0
