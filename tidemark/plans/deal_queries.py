"""Deal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SCENARIOS
from tidemark.operators import deals as o
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query

TODAY = "1998-06-30"


def today() -> F.Column:
    return F.lit(TODAY).cast("date")


def r9(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 9) for n in names})


_RANK = f"""
SELECT deal_id, CASE WHEN offer_price IS NOT NULL AND current_price IS NOT NULL AND unaffected_price IS NOT NULL AND p_break IS NOT NULL THEN 'ranked' ELSE 'awaiting_quote' END AS state,
  (offer_price - current_price) / nullif(current_price, 0) AS gross_spread,
  (1 - p_break) * (offer_price - current_price) - p_break * (current_price - unaffected_price) AS ev,
  (offer_price - current_price) / nullif((offer_price - current_price) + (current_price - unaffected_price), 0) AS breakeven_p,
  CAST(greatest(expected_close_date - DATE '{TODAY}', 1) AS INTEGER) AS days_to_close, current_price FROM deals WHERE status = 'pending'"""


@query(with_views("deals", f"SELECT deal_id, state, round(gross_spread, 9) AS gross_spread, round(ev, 9) AS ev, round(breakeven_p, 9) AS breakeven_p, days_to_close, round(CASE WHEN state = 'ranked' THEN ev / nullif(current_price, 0) * (365.0::DOUBLE / days_to_close) END, 9) AS annualized_ev FROM ({_RANK})"))
def merger_ev_rank(spark: SparkSession, d: str) -> DataFrame:
    return r9(o.rank_live_deals(c.deals(spark, d), today()), "gross_spread", "ev", "breakeven_p", "annualized_ev")


@query(with_views("deals", f"SELECT CAST(row_number() OVER (ORDER BY k DESC, deal_id) AS INTEGER) AS place, deal_id FROM (SELECT deal_id, round(ev / nullif(current_price, 0) * (365.0::DOUBLE / days_to_close), 9) AS k FROM ({_RANK}) WHERE state = 'ranked') ORDER BY k DESC, deal_id LIMIT 25"))
def merger_ev_top(spark: SparkSession, d: str) -> DataFrame:
    """The 25 best live deals (a top-k report)."""
    return o.top_deals(c.deals(spark, d), today(), 25).select("place", "deal_id")


@query(
    with_views(
        "deals",
        f"""SELECT deal_id, offer AS offer_value, basis AS offer_value_basis, offer - current_price AS raw_spread, round(pct, 9) AS pct_spread, dtc AS days_to_expected_close,
  round(CASE WHEN dtc > 0 THEN pct * (365.0::DOUBLE / dtc) END, 9) AS annualized_spread, current_price - unaffected_price AS downside_to_unaffected, round((offer - unaffected_price) / nullif(unaffected_price, 0), 9) AS premium_to_unaffected,
  round(CASE WHEN deal_value > 0 THEN ln(deal_value) END, 9) AS log_deal_value, deal_type IN ('LBO', 'take_private') AS is_sponsor, consideration_type = 'cash' AS is_all_cash
FROM (SELECT *, (offer - current_price) / nullif(current_price, 0) AS pct, CAST(expected_close_date - DATE '{TODAY}' AS INTEGER) AS dtc FROM (
  SELECT *, CASE consideration_type WHEN 'cash' THEN offer_price WHEN 'stock' THEN exchange_ratio * acquirer_price WHEN 'mixed' THEN offer_price + exchange_ratio * acquirer_price END AS offer,
    CASE WHEN consideration_type IN ('cash', 'stock', 'mixed') THEN consideration_type ELSE 'unknown_consideration' END AS basis FROM deals))""",
    )
)
def deal_features(spark: SparkSession, d: str) -> DataFrame:
    return r9(o.features(c.deals(spark, d), today()), "pct_spread", "annualized_spread", "premium_to_unaffected", "log_deal_value")


_EVAL = """
e AS (SELECT *, coalesce(capital, 1000000.0::DOUBLE) AS money, status = 'pending' OR resolution_date IS NULL AS pending, status = 'broken' AND break_exit_price IS NOT NULL AS sourced FROM trades),
f AS (SELECT *, CASE WHEN consideration_type IS NULL OR consideration_type <> 'cash' THEN 'unsupported_consideration'
    WHEN p_break IS NOT NULL AND (p_break_as_of IS NULL OR p_break_as_of > entry_date) THEN 'prediction_after_entry'
    WHEN NOT pending AND resolution_date < entry_date THEN 'resolution_before_entry'
    WHEN NOT pending AND sourced AND (break_exit_source IS NULL OR break_exit_date IS NULL) THEN 'exit_without_provenance'
    WHEN NOT pending AND sourced AND break_exit_date < resolution_date THEN 'exit_before_resolution' END AS validation_error FROM e),
g AS (SELECT *, CASE WHEN validation_error IS NOT NULL OR pending THEN NULL WHEN status = 'closed' OR sourced THEN 'realized' WHEN status = 'broken' AND unaffected_price IS NOT NULL THEN 'modeled_break' ELSE 'unresolved_exit' END AS pnl_type,
    CASE WHEN status = 'closed' THEN offer_price WHEN sourced THEN break_exit_price ELSE unaffected_price END AS px FROM f),
h AS (SELECT *, pnl_type IN ('realized', 'modeled_break') AS done, money / entry_price AS shares, pending AND validation_error IS NULL AS censored FROM g),
evaluated AS (SELECT *, CASE WHEN done THEN px END AS exit_price, CASE WHEN done THEN (money + shares * px) * 0.001::DOUBLE END AS costs,
    CASE WHEN done THEN shares * (px - entry_price) - (money + shares * px) * 0.001::DOUBLE END AS pnl, CASE WHEN done THEN CAST(greatest(resolution_date - entry_date, 1) AS INTEGER) END AS holding_days FROM h)"""


def _evaluated(body: str) -> str:
    return with_views("trades", "SELECT 1").removesuffix("\nSELECT 1") + f",{_EVAL}\n{body}"


@query(
    _evaluated("""SELECT deal_id, status, censored, validation_error, pnl_type, exit_price, round(costs, 4) AS transaction_costs, holding_days, round(CASE WHEN pnl_type = 'realized' THEN pnl END, 4) AS realized_pnl,
  round(CASE WHEN pnl_type = 'modeled_break' THEN pnl END, 4) AS modeled_break_pnl, round(pnl / money, 9) AS return_on_capital, round(pnl / money * (365.0::DOUBLE / holding_days), 9) AS annualized_return FROM evaluated""")
)
def backtest_trades(spark: SparkSession, d: str) -> DataFrame:
    rows = r9(o.evaluate_trades(c.trades(spark, d)), "return_on_capital", "annualized_return")
    rows = rows.withColumns({n: F.round(n, 4) for n in ("transaction_costs", "realized_pnl", "modeled_break_pnl")})
    return rows.drop("entry_price", "entry_date", "resolution_date", "capital")


@query(
    _evaluated("""SELECT count(*) AS n_trades, count(*) FILTER (censored) AS n_censored, count(*) FILTER (pnl_type = 'realized') AS n_realized, count(*) FILTER (pnl_type = 'modeled_break') AS n_modeled,
  count(*) FILTER (pnl_type = 'unresolved_exit') AS n_unresolved, round(sum(pnl) FILTER (pnl_type = 'realized'), 2) AS realized_pnl, round(sum(pnl) FILTER (pnl_type = 'modeled_break'), 2) AS modeled_break_pnl,
  round(count(*) FILTER (status = 'broken' AND NOT censored)::DOUBLE / nullif(count(*) FILTER (status IN ('closed', 'broken') AND NOT censored), 0), 9) AS break_rate FROM evaluated WHERE validation_error IS NULL""")
)
def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = o.backtest_summary(o.evaluate_trades(c.trades(spark, d)))
    return r9(rows, "break_rate").withColumns({n: F.round(n, 2) for n in ("realized_pnl", "modeled_break_pnl")})


@query(
    with_views(
        "positions",
        """SELECT bucket, round(capital, 2) AS capital, round(capital / total, 9) AS weight, round(sum(capital / total * (capital / total)) OVER (), 9) AS hhi
FROM (SELECT coalesce(sector, '?') AS bucket, sum(capital) AS capital, sum(sum(capital)) OVER () AS total FROM positions GROUP BY 1)""",
    )
)
def concentration_hhi(spark: SparkSession, d: str) -> DataFrame:
    return r9(o.concentration(c.positions(spark, d), "sector"), "weight", "hhi").withColumn("capital", F.round("capital", 2))


@query(with_views("positions", "SELECT deal_id, round(p_break * downside_notional, 9) AS expected_loss, round(p_break * downside_notional / nullif(sum(p_break * downside_notional) OVER (), 0), 9) AS share FROM positions"))
def expected_loss(spark: SparkSession, d: str) -> DataFrame:
    return o.expected_loss(c.positions(spark, d)).select("deal_id", F.round("expected_loss", 9).alias("expected_loss"), F.round("share", 9).alias("share"))


_STRESS = " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, count(*) FILTER ({a}) AS positions_stressed, sum(p_break * downside_notional) AS b, sum(CASE WHEN {a} THEN greatest(p_break, {f}::DOUBLE) ELSE p_break END * downside_notional) AS s FROM positions" for n, a, f in SCENARIOS
)


@query(with_views("positions", f"SELECT scenario, positions_stressed, round(b, 4) AS base_expected_loss, round(s, 4) AS scenario_expected_loss, round(s - b, 4) AS incremental_loss FROM ({_STRESS})"))
def stress_table(spark: SparkSession, d: str) -> DataFrame:
    rows = o.stress_table(c.positions(spark, d))
    return rows.withColumns({n: F.round(n, 4) for n in ("base_expected_loss", "scenario_expected_loss", "incremental_loss")})


@query(
    _evaluated("""SELECT sector, deal_id, round(cumulative, 3) AS cumulative, round(cumulative - greatest(0, max(cumulative) OVER w), 3) AS drawdown FROM (
  SELECT d.sector, e.deal_id, e.resolution_date AS date, sum(pnl) OVER (PARTITION BY d.sector ORDER BY e.resolution_date, e.deal_id) AS cumulative FROM evaluated e JOIN deals d ON d.deal_id = e.deal_id WHERE pnl_type = 'realized')
WINDOW w AS (PARTITION BY sector ORDER BY date, deal_id)""")
)
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    done = o.evaluate_trades(c.trades(spark, d)).where("pnl_type = 'realized'").selectExpr("deal_id", "resolution_date as date", "realized_pnl as pnl")
    rows = o.drawdown(done.join(c.deals(spark, d).select("deal_id", "sector"), "deal_id"), "sector")
    return rows.select("sector", "deal_id", F.round("cumulative", 3).alias("cumulative"), F.round("drawdown", 3).alias("drawdown"))
