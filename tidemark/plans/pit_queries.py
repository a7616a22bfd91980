"""Point-in-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query

T = "2024-01-20 00:00:00"
CUTOFFS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-28 12:00:00")


def at(text: str = T) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def cutoffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in CUTOFFS], "c string").select(F.col("c").cast("timestamp_ntz").alias("cutoff"))


_CUT = "cuts AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{x}'" for x in CUTOFFS) + "]) AS cutoff)"


@query(with_views("observations", f"SELECT deal_id, seq, observed_at, known_at, target_price FROM observations WHERE observed_at <= TIMESTAMP '{T}' AND known_at <= TIMESTAMP '{T}'"))
def pit_visible(spark: SparkSession, d: str) -> DataFrame:
    return pit.visible(c.observations(spark, d), at(), "observed_at").select("deal_id", "seq", "observed_at", "known_at", "target_price")


def _last(f: str) -> str:
    return f"arg_max({f}, (observed_at, known_at, seq)) FILTER ({f} IS NOT NULL)"


@query(
    with_views(
        "observations",
        f"""SELECT deal_id, cutoff, offer_price, unaffected_price, CASE WHEN floor(epoch(cutoff)) - floor(epoch(target_at)) <= 3 * 86400 THEN target_price END AS target_price
FROM (SELECT deal_id, cutoff, {_last('offer_price')} AS offer_price, {_last('unaffected_price')} AS unaffected_price, {_last('target_price')} AS target_price,
  arg_max(observed_at, (observed_at, known_at, seq)) FILTER (target_price IS NOT NULL) AS target_at
  FROM observations JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in CUTOFFS)}]) AS cutoff) ON observed_at <= cutoff AND known_at <= cutoff GROUP BY 1, 2)""",
    )
)
def pit_state_asof(spark: SparkSession, d: str) -> DataFrame:
    state = pit.state_as_of(c.observations(spark, d), cutoffs(spark), ["target_price", "offer_price", "unaffected_price"], ["observed_at", "known_at", "seq"], "observed_at", stale=pit.STALE_PRINT)
    return state.select("deal_id", "cutoff", "target_price", "offer_price", "unaffected_price")


def many_cutoffs(spark: SparkSession, hours: int) -> DataFrame:
    """Every so many hours of a month."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-02-03 00:00:00', INTERVAL '{hours}' HOUR)) AS cutoff")


def many_cutoffs_sql(hours: int) -> str:
    return f"(SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-03', INTERVAL {hours} HOUR)) AS cutoff)"


@query(
    with_views(
        "observations",
        f"""SELECT deal_id, cutoff, offer_price, target_at, CASE WHEN floor(epoch(cutoff)) - floor(epoch(target_at)) <= 3 * 86400 THEN target_price END AS target_price
FROM (SELECT deal_id, cutoff, {_last('offer_price')} AS offer_price, {_last('target_price')} AS target_price, arg_max(observed_at, (observed_at, known_at, seq)) FILTER (target_price IS NOT NULL) AS target_at
  FROM observations JOIN {many_cutoffs_sql(2)} ON observed_at <= cutoff AND known_at <= cutoff GROUP BY 1, 2)""",
    )
)
def pit_state_sweep(spark: SparkSession, d: str) -> DataFrame:
    """States at the 397 cut-offs that lie two hours apart."""
    state = pit.state_as_of(c.observations(spark, d), many_cutoffs(spark, 2), ["target_price", "offer_price"], ["observed_at", "known_at", "seq"], "observed_at", stale=pit.STALE_PRINT)
    return state.select("deal_id", "cutoff", "offer_price", F.col("target_price_at").alias("target_at"), "target_price")


@query(
    with_views(
        "observations",
        f"""SELECT deal_id, cutoff, offer_price, offer[1] AS offer_price_at, offer[2] AS offer_price_source, offer[3] AS offer_price_known_at, CASE WHEN fresh THEN target_price END AS target_price, target[1] AS target_price_at, CASE WHEN fresh THEN target[2] END AS target_price_source, CASE WHEN fresh THEN target[3] END AS target_price_known_at
FROM (SELECT *, floor(epoch(cutoff)) - floor(epoch(target[1])) <= 3 * 86400 AS fresh FROM (SELECT deal_id, cutoff, {_last('offer_price')} AS offer_price, {_last('target_price')} AS target_price,
  {", ".join(f"arg_max((observed_at, source, known_at), (observed_at, known_at, seq)) FILTER ({f} IS NOT NULL) AS {n}" for f, n in (("offer_price", "offer"), ("target_price", "target")))}
  FROM observations JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in CUTOFFS)}]) AS cutoff) ON observed_at <= cutoff AND known_at <= cutoff GROUP BY 1, 2))""",
    )
)
def state_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Where each value of a state comes from."""
    return pit.state_as_of(c.observations(spark, d), cutoffs(spark), ["offer_price", "target_price"], ["observed_at", "known_at", "seq"], "observed_at", stale=pit.STALE_PRINT, provenance=["source", "known_at"])


@query(
    f"""SELECT series_id, obs_date, value, seq FROM (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS obs_date, CASE WHEN event_id % 6 <> 0 THEN value END AS value, event_id AS seq,
    row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts + INTERVAL 1 DAY * CAST(event_id % 5 AS INTEGER) DESC, event_id DESC) AS k
  FROM events WHERE ts + INTERVAL 1 DAY * CAST(event_id % 5 AS INTEGER) <= TIMESTAMP '{T}') WHERE k = 1"""
)
def pit_series_vintage(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "events").selectExpr(
        "event_type as series_id", "to_date(ts) as obs_date", "if(event_id % 6 <> 0, value, null) as value", "event_id as seq", "ts + make_dt_interval(int(event_id % 5)) as known_at"
    )
    return pit.latest_vintage(rows, at(), ["series_id", "obs_date"]).drop("known_at")


@query(
    with_views(
        "observations",
        """, t AS (SELECT deal_id, seq, observed_at FROM observations WHERE target_price IS NOT NULL), p AS (SELECT * FROM observations WHERE unaffected_price IS NOT NULL)
SELECT t.deal_id, t.seq, arg_max(p.unaffected_price, (p.observed_at, p.seq)) AS prediction, arg_max(p.seq, (p.observed_at, p.seq)) AS prediction_seq
FROM t LEFT JOIN p ON p.deal_id = t.deal_id AND p.observed_at <= t.observed_at GROUP BY 1, 2""",
    ).replace("\n, t AS", ",\nt AS")
)
def asof_predictions(spark: SparkSession, d: str) -> DataFrame:
    obs = c.observations(spark, d)
    trades = obs.where("target_price is not null").select("deal_id", "seq", "observed_at")
    predictions = obs.where("unaffected_price is not null").selectExpr("deal_id", "observed_at as made_at", "seq as prediction_seq", "unaffected_price as prediction")
    return pit.as_of_join(trades, predictions, "deal_id", "observed_at", "made_at", ["prediction", "prediction_seq"], "prediction_seq").drop("observed_at")


_SEEN = f"seen AS (SELECT * FROM lifecycle WHERE event_at <= TIMESTAMP '{T}' AND known_at <= TIMESTAMP '{T}')"
_LABEL = """
res AS (SELECT deal_id, arg_min(event_type, (event_at, seq)) FILTER (event_type IN ('closing', 'termination', 'withdrawal')) AS resolution,
  min(event_at) FILTER (event_type IN ('closing', 'termination', 'withdrawal')) AS resolved_at FROM seen GROUP BY 1),
lab AS (SELECT *, CASE WHEN resolution = 'closing' THEN 0 WHEN resolution IS NOT NULL THEN 1 END AS label FROM res)"""


def _seen(body: str) -> str:
    return with_views("lifecycle", "SELECT 1").removesuffix("\nSELECT 1") + f",\n{_SEEN},{_LABEL}\n{body}"


@query(_seen("SELECT deal_id, resolution, resolved_at, label FROM lab"))
def first_resolution_label(spark: SparkSession, d: str) -> DataFrame:
    return pit.first_resolution(c.lifecycle(spark, d), at())


@query(
    _seen(f"""SELECT deal_id, feature_at, label, CASE WHEN reason IS NULL THEN 'eligible' WHEN reason = 'censored' THEN 'censored' ELSE 'excluded' END AS disposition, nullif(reason, 'censored') AS reason
FROM (SELECT u.deal_id, feature_at, label, CASE WHEN feature_at IS NULL THEN 'no_known_announcement' WHEN feature_at > TIMESTAMP '{T}' THEN 'feature_date_after_cutoff' WHEN label IS NULL THEN 'censored'
    WHEN feature_at >= resolved_at THEN 'feature_date_not_before_resolution' END AS reason
  FROM (SELECT DISTINCT deal_id FROM lifecycle) u LEFT JOIN (SELECT deal_id, arg_min(greatest(event_at, known_at), (event_at, seq)) AS feature_at FROM seen WHERE event_type = 'announcement' GROUP BY 1) f USING (deal_id) LEFT JOIN lab USING (deal_id))""")
)
def training_set_disposition(spark: SparkSession, d: str) -> DataFrame:
    events = c.lifecycle(spark, d)
    return pit.training_disposition(events.select("deal_id").distinct(), events, at())


@query(with_views("lifecycle", """SELECT deal_id, seq, event_type, event_at, announced_at FROM (SELECT *, min(event_at) FILTER (event_type = 'announcement') OVER (PARTITION BY deal_id) AS announced_at FROM lifecycle)
WHERE event_type IN ('closing', 'termination', 'withdrawal') AND (announced_at IS NULL OR event_at < announced_at)"""))
def lifecycle_order_violations(spark: SparkSession, d: str) -> DataFrame:
    return pit.lifecycle_violations(c.lifecycle(spark, d)).select("deal_id", "seq", "event_type", "event_at", "announced_at")


@query(
    with_views("observations", "SELECT 1").removesuffix("\nSELECT 1")
    + f""",
seen AS (SELECT * FROM observations WHERE observed_at <= TIMESTAMP '{T}' AND known_at <= TIMESTAMP '{T}'),
p AS (SELECT t.deal_id, t.seq, t.observed_at, any_value(t.target_price) AS target_price, arg_max(o.offer_price, (o.observed_at, o.known_at, o.seq)) AS offer_price
  FROM seen t LEFT JOIN seen o ON o.deal_id = t.deal_id AND o.offer_price IS NOT NULL AND o.observed_at <= t.observed_at AND o.known_at <= t.observed_at WHERE t.target_price IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT *, (offer_price - target_price) / nullif(target_price, 0) AS spread FROM p),
e AS (SELECT *, spread - last_value(spread IGNORE NULLS) OVER (PARTITION BY deal_id ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM s)
SELECT deal_id, seq, round(spread, 6) AS spread, round(delta, 6) AS delta, round(CASE WHEN count(delta) OVER r >= 3 THEN stddev_samp(delta) OVER r END, 5) AS delta_vol
FROM e WINDOW r AS (PARTITION BY deal_id ORDER BY observed_at, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def spread_delta_vol(spark: SparkSession, d: str) -> DataFrame:
    rows = pit.print_series(c.observations(spark, d), at())
    return rows.select("deal_id", "seq", F.round("spread", 6).alias("spread"), F.round("delta", 6).alias("delta"), F.round("delta_vol", 5).alias("delta_vol"))


_PANEL = with_views("observations lifecycle", "SELECT 1").removesuffix("\nSELECT 1") + f""",
{_SEEN},{_LABEL},
ann AS (SELECT deal_id, arg_min(greatest(event_at, known_at), (event_at, seq)) AS announced_at FROM seen WHERE event_type = 'announcement' GROUP BY 1),
prints AS (SELECT *, max(observed_at) OVER (PARTITION BY deal_id) AS print_at FROM observations WHERE target_price IS NOT NULL AND observed_at <= TIMESTAMP '{T}' AND known_at <= TIMESTAMP '{T}'),
own AS (SELECT t.deal_id, t.seq, t.observed_at, any_value(t.target_price) AS target_price, arg_max(o.offer_price, (o.observed_at, o.known_at, o.seq)) AS offer_price
  FROM prints t LEFT JOIN observations o ON o.deal_id = t.deal_id AND o.offer_price IS NOT NULL AND o.observed_at <= t.observed_at AND o.known_at <= t.observed_at WHERE t.known_at <= t.print_at GROUP BY 1, 2, 3),
sp AS (SELECT *, (offer_price - target_price) / nullif(target_price, 0) AS spread FROM own),
de AS (SELECT *, spread - last_value(spread IGNORE NULLS) OVER (PARTITION BY deal_id ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM sp),
vo AS (SELECT *, CASE WHEN count(delta) OVER r >= 3 THEN stddev_samp(delta) OVER r END AS vol FROM de WINDOW r AS (PARTITION BY deal_id ORDER BY observed_at, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ft AS (SELECT deal_id, count(*) AS n_prints, count(delta) AS n_delta, arg_max(struct_pack(s := spread, d := delta, v := vol), (observed_at, seq)) AS x FROM vo GROUP BY 1),
al AS (SELECT u.deal_id, coalesce(print_at, announced_at) AS feature_at, coalesce(n_prints, 0) AS n_prints, coalesce(n_delta, 0) AS n_delta, x.s AS spread, x.d AS delta, x.v AS delta_vol, label, resolved_at
  FROM (SELECT DISTINCT deal_id FROM lifecycle) u LEFT JOIN (SELECT DISTINCT deal_id, print_at FROM prints) USING (deal_id) LEFT JOIN ann USING (deal_id) LEFT JOIN ft USING (deal_id) LEFT JOIN lab USING (deal_id)),
rs AS (SELECT *, CASE WHEN feature_at IS NULL THEN 'no_known_announcement' WHEN feature_at > TIMESTAMP '{T}' THEN 'feature_after_cutoff' WHEN n_prints < 3 THEN 'insufficient_price_history' WHEN label IS NULL THEN 'censored'
  WHEN feature_at >= resolved_at THEN 'feature_not_before_resolution' END AS why FROM al),
panel AS (SELECT * EXCLUDE (why), CASE WHEN why IS NULL THEN 'eligible' WHEN why = 'censored' THEN 'censored' ELSE 'excluded' END AS disposition, nullif(why, 'censored') AS reason FROM rs)
"""


@query(_PANEL + "SELECT deal_id, feature_at, n_prints, n_delta, round(spread, 6) AS spread, round(delta, 6) AS delta, round(delta_vol, 5) AS delta_vol, label, disposition, reason FROM panel")
def spread_stress_panel(spark: SparkSession, d: str) -> DataFrame:
    panel = pit.spread_panel(c.observations(spark, d), c.lifecycle(spark, d), at())
    return panel.withColumns({x: F.round(x, n) for x, n in (("spread", 6), ("delta", 6), ("delta_vol", 5))})


@query(_PANEL + """SELECT n, n_pos, n_neg, n_censored, n_thin, n_collision, CASE WHEN n_collision > 0 THEN 'FEATURE_TIME_RESOLUTION_TIMESTAMP_COLLISION' WHEN least(n_pos, n_neg) < 2 THEN 'CLASS_BALANCE_BELOW_MIN_CLASS_N' END AS block_reason, n_collision = 0 AND least(n_pos, n_neg) >= 2 AS valid
FROM (SELECT count(*) FILTER (disposition = 'eligible') AS n, count(*) FILTER (disposition = 'eligible' AND label = 1) AS n_pos, count(*) FILTER (disposition = 'eligible' AND label = 0) AS n_neg, count(*) FILTER (disposition = 'censored') AS n_censored,
  count(*) FILTER (reason = 'insufficient_price_history') AS n_thin, count(*) FILTER (reason = 'feature_not_before_resolution') AS n_collision FROM panel)""")
def panel_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return pit.panel_diagnostic(pit.spread_panel(c.observations(spark, d), c.lifecycle(spark, d), at()))


@query(
    with_views(
        "lifecycle",
        f"""SELECT deal_id, cutoff, has_second AND NOT has_end AS second_request_open, false AS under_regulatory_challenge, n_events FROM (
  SELECT deal_id, cutoff, bool_or(event_type = 'second_request') AS has_second, bool_or(event_type IN ('hsr_clearance', 'termination', 'closing')) AS has_end, count(*) AS n_events
  FROM lifecycle JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in CUTOFFS)}]) AS cutoff) ON event_at <= cutoff AND known_at <= cutoff GROUP BY 1, 2)""",
    )
)
def event_set_features(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.deals import event_features

    return event_features(c.lifecycle(spark, d), cutoffs(spark))
