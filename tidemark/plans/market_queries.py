"""Series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.dates import date_key
from tidemark.operators import market as m
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query

WINDOWS = "WINDOW s AS (PARTITION BY series_id ORDER BY obs_date), w5 AS (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
METRICS = f"""
SELECT series_id, obs_date, close, close / nullif(lag(close) OVER s, 0) - 1 AS daily_return, avg(close) OVER w5 AS ma, count(close) OVER w5 AS n_window,
  close / nullif(first_value(close IGNORE NULLS) OVER (PARTITION BY series_id, date_trunc('month', obs_date) ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) - 1 AS mtd_return,
  lead(close) OVER s / nullif(close, 0) - 1 AS fwd
FROM market {WINDOWS}"""
SIGNAL = "CASE WHEN close IS NULL OR ma IS NULL OR daily_return IS NULL THEN 'NO_DATA' WHEN close > ma AND daily_return > 0.0025::DOUBLE THEN 'BUY' WHEN close < ma AND daily_return < -0.0025::DOUBLE THEN 'SELL' ELSE 'HOLD' END"


def r6(*names: str) -> dict:
    return {n: F.round(F.col(n), 6) for n in names}


@query(with_views("prices calendar", "SELECT p.series_id, p.obs_date, CAST(strftime(p.obs_date, '%Y%m%d') AS INTEGER) AS date_key, md5(p.series_id || '|' || strftime(p.obs_date, '%Y-%m-%d')) AS price_key, p.close FROM prices p JOIN calendar c ON p.obs_date = c.obs_date WHERE c.is_trading"))
def calendar_gate_fact_price(spark: SparkSession, d: str) -> DataFrame:
    gated = m.calendar_gated(c.prices(spark, d), c.calendar(spark, d))
    key = F.md5(F.concat("series_id", F.lit("|"), F.date_format("obs_date", "yyyy-MM-dd")))
    return gated.select("series_id", "obs_date", date_key(F.col("obs_date")).alias("date_key"), key.alias("price_key"), "close")


@query(with_views("market", f"SELECT series_id, obs_date, close, round(daily_return, 6) AS daily_return, round(ma, 6) AS ma, n_window >= 5 AS window_complete, {SIGNAL} AS signal FROM ({METRICS})"))
def signals_ma5(spark: SparkSession, d: str) -> DataFrame:
    rows = m.add_metrics(c.market(spark, d)).withColumn("signal", m.classify())
    return rows.withColumns(r6("daily_return", "ma")).select("series_id", "obs_date", "close", "daily_return", "ma", "window_complete", "signal")


@query(with_views("market", f"SELECT series_id, obs_date, round(mtd_return, 6) AS mtd_return FROM ({METRICS})"))
def mtd_return(spark: SparkSession, d: str) -> DataFrame:
    return m.add_metrics(c.market(spark, d)).withColumns(r6("mtd_return")).select("series_id", "obs_date", "mtd_return")


@query(
    with_views(
        "market",
        f"""SELECT series_id, coalesce(signal, '_ALL_DAYS') AS signal, count(*) AS n, round(avg(fwd), 6) AS mean_fwd, round(avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate
FROM (SELECT *, {SIGNAL} AS signal FROM ({METRICS})) WHERE fwd IS NOT NULL GROUP BY GROUPING SETS ((series_id, signal), (series_id))""",
    )
)
def signal_backtest(spark: SparkSession, d: str) -> DataFrame:
    return m.signal_stats(c.market(spark, d)).withColumns(r6("mean_fwd", "hit_rate")).select("series_id", "signal", "n", "mean_fwd", "hit_rate")


_SWEEP = f"""
base AS (SELECT series_id, obs_date, close, close / nullif(lag(close) OVER s, 0) - 1 AS daily_return, lead(close) OVER s / nullif(close, 0) - 1 AS fwd,
  {", ".join(f"avg(close) OVER (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS ma_{w}" for w in config.SWEEP_WINDOWS)}
  FROM market WINDOW s AS (PARTITION BY series_id ORDER BY obs_date)),
long AS ({" UNION ALL ".join(f'SELECT series_id, close, daily_return, fwd, {w} AS "window", ma_{w} AS ma FROM base WHERE fwd IS NOT NULL' for w in config.SWEEP_WINDOWS)}),
grid AS (SELECT buy, sell FROM (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in config.SWEEP_BUY)}]) AS buy), (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in config.SWEEP_SELL)}]) AS sell)),
marked AS (SELECT *, CASE WHEN close IS NULL OR ma IS NULL OR daily_return IS NULL THEN 'NO_DATA' WHEN close > ma AND daily_return > buy THEN 'BUY' WHEN close < ma AND daily_return < sell THEN 'SELL' ELSE 'HOLD' END AS sig FROM long, grid),
sides AS (SELECT unnest(['BUY', 'SELL']) AS signal),
cells AS (SELECT series_id, "window", buy, sell, signal, count(*) FILTER (sig = signal) AS n, avg(fwd) FILTER (sig = signal) AS mean_fwd,
  avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (sig = signal) AS hit_rate FROM marked, sides GROUP BY ALL),
bl AS (SELECT series_id, avg(fwd) AS baseline FROM base WHERE fwd IS NOT NULL GROUP BY 1),
swept AS (SELECT series_id, "window", buy, sell, signal, n, mean_fwd, hit_rate, baseline, mean_fwd - baseline AS edge, n < 20 AS thin FROM cells JOIN bl USING (series_id))"""


@query(with_views("market", "SELECT 1").removesuffix("\nSELECT 1") + "," + _SWEEP + """
SELECT series_id, "window", buy, sell, signal, n, round(mean_fwd, 6) AS mean_fwd, round(hit_rate, 6) AS hit_rate, round(baseline, 6) AS baseline, round(edge, 6) AS edge, thin FROM swept""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return m.sweep(c.market(spark, d)).withColumns(r6("mean_fwd", "hit_rate", "baseline", "edge"))


@query(with_views("market", "SELECT 1").removesuffix("\nSELECT 1") + "," + _SWEEP + """
SELECT series_id, signal, place, "window", buy, sell FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY series_id, signal ORDER BY thin, CASE WHEN signal = 'BUY' THEN edge ELSE -edge END DESC NULLS LAST, "window", buy, sell) AS INTEGER) AS place
  FROM (SELECT * REPLACE (round(edge, 9) AS edge) FROM swept)) WHERE place <= 5""")
def sweep_top_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = m.sweep(c.market(spark, d)).withColumn("edge", F.round("edge", 9))
    return m.top_cells(cells).select("series_id", "signal", "place", "window", "buy", "sell")


def _z(value: str) -> str:
    w = "OVER (ORDER BY obs_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {w} = 10 AND {value} IS NOT NULL THEN ({value} - avg({value}) {w}) / nullif(stddev_samp({value}) {w}, 0) END"


def _named(legs: DataFrame) -> DataFrame:
    return legs.withColumn("series_id", F.lit("legs"))


@query(with_views("spread_legs", f"SELECT obs_date, spread, round(z, 5) AS z, CASE WHEN z IS NULL THEN 'NO_DATA' WHEN z <= -1 THEN 'LONG' WHEN z >= 1 THEN 'SHORT' ELSE 'FLAT' END AS signal FROM (SELECT obs_date, spread, {_z('spread')} AS z FROM spread_legs)"))
def spread_zscore(spark: SparkSession, d: str) -> DataFrame:
    rows = m.zscore(_named(c.spread_legs(spark, d)), "spread", 10)
    return rows.select("obs_date", "spread", F.round("z", 5).alias("z"), m.entry_signal(F.col("z"), 1.0).alias("signal"))


@query(with_views("spread_legs", f"SELECT obs_date, round(ratio, 6) AS ratio, round(z, 5) AS z, true AS baseline_only FROM (SELECT obs_date, ratio, {_z('ratio')} AS z FROM spread_legs)"))
def ratio_zscore(spark: SparkSession, d: str) -> DataFrame:
    rows = m.zscore(_named(c.spread_legs(spark, d)), "ratio", 10)
    return rows.select("obs_date", F.round("ratio", 6).alias("ratio"), F.round("z", 5).alias("z"), F.lit(True).alias("baseline_only"))


@query(with_views("spread_legs", """
SELECT a.obs_date, a.spread, CASE WHEN a.spread IS NOT NULL THEN (SELECT round(count(*) FILTER (b.spread <= a.spread)::DOUBLE / count(*), 9) FROM spread_legs b WHERE b.spread IS NOT NULL AND b.obs_date <= a.obs_date) END AS pctile
FROM spread_legs a"""))
def expanding_pctile(spark: SparkSession, d: str) -> DataFrame:
    return m.expanding_percentile(_named(c.spread_legs(spark, d)), "spread").select("obs_date", "spread", F.round("pctile", 9).alias("pctile"))


@query(with_views("spread_legs", "SELECT obs_date, leg_a, leg_b, spread FROM spread_legs WHERE spread IS NOT NULL ORDER BY obs_date DESC LIMIT 1"))
def spread_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last session on which both legs printed."""
    rows = c.spread_legs(spark, d).where("spread is not null")
    return rows.agg(F.max_by(F.struct("obs_date", "leg_a", "leg_b", "spread"), "obs_date").alias("r")).select("r.*").where("obs_date is not null")


@query(with_views("market", "SELECT series_id, count(*) AS trading_days, count(close) AS prints, count(*) FILTER (close IS NULL) AS missing FROM market GROUP BY 1"))
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return m.coverage(c.prices(spark, d), c.calendar(spark, d))


@query(with_views("market", "SELECT series_id, obs_date FROM market WHERE close IS NULL"))
def missing_dates(spark: SparkSession, d: str) -> DataFrame:
    return c.market(spark, d).where("close is null").select("series_id", "obs_date")


@query(with_views("prices", """
SELECT o.series_id, o.obs_date, coalesce(CASE WHEN day(o.obs_date) % 7 = 0 THEN o.close * 2 END, o.close) AS close, CASE WHEN day(o.obs_date) % 7 = 0 THEN 'new' ELSE 'old' END AS provenance FROM prices o"""))
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    old = c.prices(spark, d).withColumn("provenance", F.lit("old"))
    new = old.select("series_id", "obs_date", F.when(F.dayofmonth("obs_date") % 7 == 0, F.col("close") * 2).alias("close"), F.lit("new").alias("provenance"))
    return m.upsert_coalesce(old, new)


_PULLS = "SELECT event_type AS series_id, CAST(ts AS DATE) AS obs_date, CASE WHEN event_id % 6 <> 0 THEN CAST(floor(value / 40) AS BIGINT) END AS value, ts AS known_at, event_id FROM events"


@query(f"""
WITH pulls AS ({_PULLS}), w AS (SELECT *, row_number() OVER o AS n, lag(value) OVER o AS before FROM pulls WINDOW o AS (PARTITION BY series_id, obs_date ORDER BY known_at, event_id))
SELECT series_id, obs_date, value, event_id FROM w WHERE n = 1 OR value IS DISTINCT FROM before""")
def append_if_changed(spark: SparkSession, d: str) -> DataFrame:
    pulls = c.table(spark, d, "events").selectExpr(
        "event_type as series_id", "to_date(ts) as obs_date", "if(event_id % 6 <> 0, cast(floor(value / 40) as bigint), null) as value", "struct(ts, event_id) as known_at", "event_id"
    )
    return m.append_if_changed(pulls).select("series_id", "obs_date", "value", "event_id")
