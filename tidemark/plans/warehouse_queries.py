"""Warehouse queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import market, pit
from tidemark.operators import warehouse as w
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query


@query(with_views("calendar", """SELECT CAST(strftime(obs_date, '%Y%m%d') AS INTEGER) AS date_key, obs_date, CAST(year(obs_date) AS INTEGER) AS year, year(obs_date) || '-Q' || quarter(obs_date) AS quarter,
  CAST(month(obs_date) AS INTEGER) AS month, dayname(obs_date) AS day_name, is_trading FROM calendar"""))
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    return w.dim_date(c.calendar(spark, d))


@query(with_views("deals calendar", """SELECT deal_id, md5(deal_id || '|' || coalesce(strftime(announce_date, '%Y-%m-%d'), '')) AS deal_state_key, CAST(strftime(obs_date, '%Y%m%d') AS INTEGER) AS date_key, status, status = 'pending' AS is_censored, p_break
FROM deals LEFT JOIN calendar ON obs_date = announce_date AND is_trading"""))
def fact_deal_state(spark: SparkSession, d: str) -> DataFrame:
    return w.fact_deal_state(c.deals(spark, d), w.dim_date(c.calendar(spark, d)).where("is_trading"))


@query(with_views("deals", "SELECT deal_id, status, p_break, CAST(label AS INTEGER) AS label, (p_break - label) * (p_break - label) AS squared_error FROM (SELECT *, CASE status WHEN 'broken' THEN 1 WHEN 'closed' THEN 0 END AS label FROM deals)"))
def mart_scorecard_brier(spark: SparkSession, d: str) -> DataFrame:
    return w.mart_scorecard(c.deals(spark, d))


_SNAP = "SELECT user_id AS deal_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1, 2"


@query(f"""WITH snap AS ({_SNAP}), h AS (SELECT *, md5(coalesce(status, '__NULL__')) AS hash_diff FROM snap),
s AS (SELECT * FROM (SELECT *, lag(hash_diff) OVER (PARTITION BY deal_id ORDER BY day) AS before FROM h) WHERE before IS NULL OR before <> hash_diff)
SELECT deal_id, status, hash_diff, day AS valid_from, coalesce(lead(day) OVER k, DATE '9999-12-31') AS valid_to, lead(day) OVER k IS NULL AS is_current FROM s WINDOW k AS (PARTITION BY deal_id ORDER BY day)""")
def scd2_satellite(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").groupBy(F.col("user_id").alias("deal_id"), F.to_date("ts").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return w.scd2(e, "deal_id", "day", ["status"])


@query(f"""WITH snap AS ({_SNAP}), h AS (SELECT *, md5(coalesce(status, '__NULL__')) AS hash_diff FROM snap), z AS (SELECT deal_id, max(day) AS last FROM snap GROUP BY 1),
s AS (SELECT * FROM (SELECT *, lag(hash_diff) OVER (PARTITION BY deal_id ORDER BY day) AS before FROM h) WHERE before IS NULL OR before <> hash_diff),
v AS (SELECT deal_id, status, hash_diff, day AS valid_from, coalesce(lead(day) OVER k, DATE '9999-12-31') AS valid_to, lead(day) OVER k IS NULL AS is_current FROM s WINDOW k AS (PARTITION BY deal_id ORDER BY day))
SELECT v.*, CASE WHEN is_current THEN last END AS last_seen FROM v JOIN z USING (deal_id)""")
def scd2_merge(spark: SparkSession, d: str) -> DataFrame:
    """Versions of the first half of the days, after a batch that has all days again."""
    e = c.table(spark, d, "events").groupBy(F.col("user_id").alias("deal_id"), F.to_date("ts").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    old = w.scd2_seen(e.where("day < date'2024-01-15'"), "deal_id", "day", ["status"])
    return w.scd2_merged(old, e, "deal_id", "day", ["status"])


@query("""WITH old AS (SELECT DISTINCT event_type AS series_id, CAST(ts AS DATE) AS obs_date FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'),
b AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS obs_date, event_id, value, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00')
SELECT b.series_id, b.obs_date, event_id, value FROM b WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.series_id = b.series_id AND old.obs_date = b.obs_date)""")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").selectExpr("event_type as series_id", "to_date(ts) as obs_date", "event_id", "value", "ts")
    old = e.where("ts < timestamp_ntz'2024-01-15 00:00:00'").select("series_id", "obs_date").distinct()
    return w.incremental_append(old, e.where("ts >= timestamp_ntz'2024-01-13 00:00:00'").drop("ts"), ["series_id", "obs_date"], "event_id")


_COLUMNS = ["resolution_date", "p_break", "deal_type", "consideration_type", "acquirer_price", "sponsor"]


@query(with_views("deals", " UNION ALL ".join(f"SELECT count(*) AS n_rows, '{x}' AS \"column\", count(*) FILTER ({x} IS NULL) AS missing, count(DISTINCT {x}) AS \"distinct\" FROM deals" for x in _COLUMNS)))
def data_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return w.data_quality(c.deals(spark, d), _COLUMNS)


@query(with_views("resolved", """SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_broken, CASE WHEN count(*) < 20 THEN 'insufficient_sample' WHEN least(sum(label), count(*) - sum(label)) < 2 THEN 'single_class' ELSE 'ready' END AS readiness FROM resolved"""))
def readiness(spark: SparkSession, d: str) -> DataFrame:
    one = c.resolved(spark, d).agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("n_broken"))
    few = F.least("n_broken", F.col("n") - F.col("n_broken")) < 2
    return one.withColumn("readiness", F.when(F.col("n") < 20, "insufficient_sample").when(few, "single_class").otherwise("ready"))


@query(with_views("prices calendar deals", """
SELECT 'no_prices_on_non_trading_days' AS rule, (SELECT count(*) FROM prices p JOIN calendar c USING (obs_date) WHERE c.is_trading AND NOT c.is_trading) AS violations
UNION ALL SELECT 'pending_deals_are_censored', 0 UNION ALL SELECT 'pending_has_no_realized_label', 0
UNION ALL SELECT 'resolution_not_before_announce', (SELECT count(*) FROM deals WHERE resolution_date < announce_date)
UNION ALL SELECT 'no_lookahead_order', (SELECT count(*) FROM deals WHERE status = 'pending' AND resolution_date IS NOT NULL)
UNION ALL SELECT 'no_fabricated_prices', (SELECT count(*) FROM prices WHERE isnan(close))"""))
def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every invariant with the number of rows that break it."""
    deals, cal = c.deals(spark, d), c.calendar(spark, d)
    rules = w.invariants(deals, market.calendar_gated(c.prices(spark, d), cal), cal, w.mart_scorecard(deals))
    parts = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, rows in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(with_views("observations", "SELECT deal_id, count(*) AS n_observations, count(target_price) AS n_prints, max(known_at) AS last_known FROM observations GROUP BY 1"))
def deal_print_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.observations(spark, d).groupBy("deal_id").agg(F.count("*").alias("n_observations"), F.count("target_price").alias("n_prints"), F.max("known_at").alias("last_known"))


@query(with_views("observations", """SELECT deal_id, CASE WHEN n >= 3 THEN 'READY' WHEN n > 0 THEN 'THIN' ELSE 'NO_HISTORY' END AS price_state, n FROM (
  SELECT deal_id, count(*) FILTER (target_price IS NOT NULL AND observed_at <= TIMESTAMP '2024-01-12 00:00:00' AND known_at <= TIMESTAMP '2024-01-12 00:00:00') AS n FROM observations GROUP BY 1)"""))
def price_history_audit(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    obs = c.observations(spark, d)
    prints = pit.visible(obs, cutoff, "observed_at").where("target_price is not null").groupBy("deal_id").agg(F.count("*").alias("n"))
    rows = obs.select("deal_id").distinct().join(prints, "deal_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.select("deal_id", F.when(F.col("n") >= 3, "READY").when(F.col("n") > 0, "THIN").otherwise("NO_HISTORY").alias("price_state"), "n")
