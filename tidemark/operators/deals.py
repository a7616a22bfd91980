"""Deal features, ranking, back-test, portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import CAPITAL_PER_DEAL, SCENARIOS, TX_COST_BPS
from tidemark.functions import dates, finance
from tidemark.operators.pit import visible_at


def rank_live_deals(deals: DataFrame, today: Column) -> DataFrame:
    """Pending deals by annualised break-adjusted return, best first; deals without a quote come last, unranked."""
    live = deals.where("status = 'pending'")
    quoted = F.col("offer_price").isNotNull() & F.col("current_price").isNotNull() & F.col("unaffected_price").isNotNull() & F.col("p_break").isNotNull()
    up, down = F.col("offer_price") - F.col("current_price"), F.col("current_price") - F.col("unaffected_price")
    ev = finance.break_adjusted_ev(F.col("offer_price"), F.col("current_price"), F.col("unaffected_price"), F.col("p_break"))
    days = dates.days_to_close(F.col("expected_close_date"), today)
    rows = live.select(
        "deal_id", F.when(quoted, "ranked").otherwise("awaiting_quote").alias("state"), finance.gross_spread(F.col("offer_price"), F.col("current_price")).alias("gross_spread"), ev.alias("ev"),
        finance.breakeven_p(up, down).alias("breakeven_p"), days.alias("days_to_close"), (F.try_divide(ev, F.col("current_price")) * (365.0 / days)).alias("annualized_ev"),
    )
    return rows.withColumn("annualized_ev", F.when(F.col("state") == "ranked", F.col("annualized_ev")))


def top_deals(deals: DataFrame, today: Column, k: int) -> DataFrame:
    """The k best live deals with their places."""
    best = rank_live_deals(deals, today).where("state = 'ranked'").withColumn("key", F.round("annualized_ev", 9)).orderBy(F.col("key").desc(), "deal_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("key").desc(), "deal_id")))


def features(deals: DataFrame, today: Column) -> DataFrame:
    """Economics and structure of each deal; null wherever an input is missing."""
    offer, basis = finance.offer_value(F.col("consideration_type"), F.col("offer_price"), F.col("exchange_ratio"), F.col("acquirer_price"))
    dtc = F.datediff("expected_close_date", today)
    pct = F.try_divide(offer - F.col("current_price"), F.col("current_price"))
    return deals.select(
        "deal_id", offer.alias("offer_value"), basis.alias("offer_value_basis"), (offer - F.col("current_price")).alias("raw_spread"), pct.alias("pct_spread"), dtc.alias("days_to_expected_close"),
        dates.annualized(pct, dtc).alias("annualized_spread"), (F.col("current_price") - F.col("unaffected_price")).alias("downside_to_unaffected"),
        F.try_divide(offer - F.col("unaffected_price"), F.col("unaffected_price")).alias("premium_to_unaffected"), F.when(F.col("deal_value") > 0, F.ln("deal_value")).alias("log_deal_value"),
        F.col("deal_type").isin("LBO", "take_private").alias("is_sponsor"), (F.col("consideration_type") == "cash").alias("is_all_cash"),
    )


def event_features(events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Regulatory flags per deal and cut-off from the types of the events that count."""
    has = lambda *t: F.bool_or(F.col("event_type").isin(*t))
    rows = visible_at(events, cutoffs, "event_at").groupBy("deal_id", "cutoff")
    return rows.agg(
        (has("second_request") & ~has("hsr_clearance", "termination", "closing")).alias("second_request_open"), (has("doj_challenge", "ftc_challenge") & ~has("termination")).alias("under_regulatory_challenge"), F.count("*").alias("n_events")
    )


def evaluate_trades(trades: DataFrame, bps: float = TX_COST_BPS, capital: float = CAPITAL_PER_DEAL, modeled_breaks: bool = True) -> DataFrame:
    """P&L of each trade, or why it has none.

    Exit: the offer if closed; if broken, the sourced break price, else the unaffected price as a model; otherwise
    the exit stays unresolved. Pending trades are censored. ``validation_error`` names the first rule a trade breaks.
    """
    c = F.col
    money = F.coalesce(c("capital"), F.lit(capital))
    pending = (c("status") == "pending") | c("resolution_date").isNull()
    broken = c("status") == "broken"
    sourced = broken & c("break_exit_price").isNotNull()
    error = (
        F.when(c("consideration_type").isNull() | (c("consideration_type") != "cash"), "unsupported_consideration")
        .when(c("p_break").isNotNull() & (c("p_break_as_of").isNull() | (c("p_break_as_of") > c("entry_date"))), "prediction_after_entry")
        .when(~pending & (c("resolution_date") < c("entry_date")), "resolution_before_entry")
        .when(~pending & sourced & (c("break_exit_source").isNull() | c("break_exit_date").isNull()), "exit_without_provenance")
        .when(~pending & sourced & (c("break_exit_date") < c("resolution_date")), "exit_before_resolution")
    )
    kind = (
        F.when(error.isNotNull() | pending, None)
        .when((c("status") == "closed") | sourced, "realized")
        .when(broken & F.lit(modeled_breaks) & c("unaffected_price").isNotNull(), "modeled_break")
        .otherwise("unresolved_exit")
    )
    price = F.when(c("status") == "closed", c("offer_price")).when(sourced, c("break_exit_price")).otherwise(c("unaffected_price"))
    rows = trades.select("deal_id", "status", "entry_price", "entry_date", "resolution_date", money.alias("capital"), error.alias("validation_error"), kind.alias("pnl_type"), price.alias("exit_price"), (pending & error.isNull()).alias("censored"))
    done = c("pnl_type").isin("realized", "modeled_break")
    shares = c("capital") / c("entry_price")
    cost = (c("capital") + shares * c("exit_price")) * (bps / 1e4)
    pnl = shares * (c("exit_price") - c("entry_price")) - cost
    rows = rows.withColumn("exit_price", F.when(done, c("exit_price"))).withColumns({"pnl": F.when(done, pnl), "transaction_costs": F.when(done, cost), "holding_days": F.when(done, F.greatest(F.datediff("resolution_date", "entry_date"), F.lit(1)))})
    return rows.withColumns(
        {
            "realized_pnl": F.when(c("pnl_type") == "realized", c("pnl")),
            "modeled_break_pnl": F.when(c("pnl_type") == "modeled_break", c("pnl")),
            "return_on_capital": c("pnl") / c("capital"),
            "annualized_return": c("pnl") / c("capital") * (365.0 / c("holding_days")),
        }
    ).drop("pnl")


def backtest_summary(evaluated: DataFrame) -> DataFrame:
    """Counts by kind, sums of realized and modeled P&L, and the break rate of resolved trades."""
    ok = evaluated.where("validation_error is null")
    resolved = F.col("status").isin("closed", "broken") & ~F.col("censored")
    return ok.agg(
        F.count("*").alias("n_trades"), F.count_if("censored").alias("n_censored"), F.count_if(F.col("pnl_type") == "realized").alias("n_realized"), F.count_if(F.col("pnl_type") == "modeled_break").alias("n_modeled"),
        F.count_if(F.col("pnl_type") == "unresolved_exit").alias("n_unresolved"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("modeled_break_pnl").alias("modeled_break_pnl"),
        F.try_divide(F.count_if(resolved & (F.col("status") == "broken")), F.count_if(resolved)).alias("break_rate"),
    )


def concentration(positions: DataFrame, key: str) -> DataFrame:
    """Weights of capital by ``key`` (null as ?), with the sum of squared weights."""
    by = positions.groupBy(F.coalesce(F.col(key), F.lit("?")).alias("bucket")).agg(F.sum("capital").alias("capital"))
    total = by.agg(F.sum("capital").alias("total"))
    weighed = by.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide("capital", "total"))
    hhi = weighed.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    return weighed.crossJoin(F.broadcast(hhi)).select("bucket", "capital", "weight", "hhi")


def expected_loss(positions: DataFrame) -> DataFrame:
    """Each position's expected loss and its share of the book's (a one-row broadcast)."""
    rows = positions.withColumn("expected_loss", F.col("p_break") * F.col("downside_notional"))
    total = rows.agg(F.sum("expected_loss").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("deal_id", "expected_loss", F.try_divide("expected_loss", "total").alias("share"))


def stress_table(positions: DataFrame) -> DataFrame:
    """Expected loss per scenario against the base; a scenario raises the break probability of what it applies to."""
    base = F.sum(F.col("p_break") * F.col("downside_notional"))
    aggs = [base.alias("base")]
    for name, applies, floor in SCENARIOS:
        hit = F.coalesce(F.expr(applies), F.lit(False))
        p = F.when(hit, F.greatest(F.col("p_break"), F.lit(floor))).otherwise(F.col("p_break"))
        aggs.append(F.struct(F.lit(name).alias("scenario"), F.count_if(hit).alias("positions_stressed"), F.sum(p * F.col("downside_notional")).alias("scenario_expected_loss")).alias(name))
    one = positions.agg(*aggs)
    rows = one.select("base", F.explode(F.array(*[F.col(n) for n, _, _ in SCENARIOS])).alias("s")).select("s.*", F.col("base").alias("base_expected_loss"))
    return rows.withColumn("incremental_loss", F.col("scenario_expected_loss") - F.col("base_expected_loss"))


def drawdown(pnl: DataFrame, partition: str) -> DataFrame:
    """Cumulative P&L per ``partition`` by date, its peak (from 0) and the distance below it."""
    w = Window.partitionBy(partition).orderBy("date", "deal_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = pnl.withColumn("cumulative", F.sum("pnl").over(w))
    return rows.withColumn("drawdown", F.col("cumulative") - F.greatest(F.lit(0.0), F.max("cumulative").over(w)))
