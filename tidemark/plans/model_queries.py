"""Simulation, model and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import MIN_CLASS_N, MIN_SAMPLE_N
from tidemark.functions import extract
from tidemark.operators import deals as deal_ops
from tidemark.operators import features, model, simulation
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query

FEATURES = ("pct_spread", "annualized_spread", "premium_to_unaffected", "log_deal_value", "is_sponsor", "is_all_cash")


@query()
def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    """Risk report of the open book over the reference's 100,000 paths; a simulation has no SQL, its statistics are tested."""
    book = c.positions(spark, d).withColumn("upside_notional", F.col("downside_notional") * 0.25)
    return simulation.risk_report(simulation.simulate(book, paths=100_000))


@query(with_views("positions", """SELECT level, round(mean_pnl, 6) AS mean_pnl, round(std_pnl, 4) AS std_pnl, round(greatest(0.0::DOUBLE, -q), 6) AS value_at_risk, round(greatest(0.0::DOUBLE, -(SELECT avg(pnl) FROM p WHERE pnl <= q)), 6) AS expected_shortfall FROM (
  SELECT unnest([0.95::DOUBLE, 0.99::DOUBLE]) AS level, unnest([quantile_cont(pnl, 0.05), quantile_cont(pnl, 0.01)]) AS q, avg(pnl) AS mean_pnl, stddev_samp(pnl) AS std_pnl FROM p)""").replace("WITH ", "WITH ", 1).replace("\nSELECT level", ",\np AS (SELECT (0.2::DOUBLE - p_break) * downside_notional AS pnl FROM positions)\nSELECT level"))
def var_es(spark: SparkSession, d: str) -> DataFrame:
    pnl = c.positions(spark, d).selectExpr("(0.2D - p_break) * downside_notional as pnl")
    rows = simulation.risk_report(pnl)
    return rows.select("level", *[F.round(x, n).alias(x) for x, n in (("mean_pnl", 6), ("std_pnl", 4), ("value_at_risk", 6), ("expected_shortfall", 6))])


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    deals = c.deals(spark, d).where("status <> 'pending' and resolution_date is not null")
    x = deal_ops.features(deals, F.col("announce_date"))
    return deals.select("deal_id", "announce_date", "resolution_date", (F.col("status") == "broken").cast("double").alias("label")).join(x, "deal_id").select("deal_id", "announce_date", "resolution_date", "label", *FEATURES)


_WINDOWS = ("1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01")


@query()
def logit_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample scores of a logit refitted at each cut-off, of the spread alone, and of the share of breaks."""
    return model.walk_forward(_model_rows(spark, d), FEATURES, _WINDOWS, spread=FEATURES[0]).select("deal_id", "train_cutoff", "label", "p_model", "p_spread", "p_constant")


_EARLY = ("1995-02-01", *_WINDOWS, "2001-01-01", "2030-01-01", "2031-01-01")


@query(with_views("deals", f"""SELECT w.w AS "window", w.a AS train_cutoff, w.b AS test_end, n_train, train_pos, n_test, test_pos, train_pos / nullif(n_train, 0) AS train_prevalence, test_pos / nullif(n_test, 0) AS test_prevalence, CASE WHEN n_test = 0 THEN 'no_test_rows' WHEN n_train < {MIN_SAMPLE_N} OR least(train_pos, n_train - train_pos) < {MIN_CLASS_N} THEN 'insufficient_data' ELSE 'fitted' END AS status,
  CASE WHEN n_test > 0 THEN CASE WHEN n_train < {MIN_SAMPLE_N} THEN 'too_few_rows' WHEN least(train_pos, n_train - train_pos) < {MIN_CLASS_N} THEN 'too_few_of_a_class' END END AS reason
FROM (SELECT w, count(*) FILTER (resolution_date <= w.a) AS n_train, count(*) FILTER (resolution_date <= w.a AND status = 'broken') AS train_pos, count(*) FILTER (announce_date > w.a AND announce_date <= w.b) AS n_test, count(*) FILTER (announce_date > w.a AND announce_date <= w.b AND status = 'broken') AS test_pos
  FROM deals, (SELECT unnest([{", ".join(f"{{'w': {i}, 'a': DATE '{a}', 'b': DATE '{b}'}}" for i, (a, b) in enumerate(zip(_EARLY, _EARLY[1:])))}]) AS w) WHERE status <> 'pending' AND resolution_date IS NOT NULL GROUP BY w)"""))
def walk_forward_status(spark: SparkSession, d: str) -> DataFrame:
    """Windows before there is enough to fit, windows with and without deals."""
    deals = c.deals(spark, d).where("status <> 'pending' and resolution_date is not null").select("announce_date", "resolution_date", (F.col("status") == "broken").cast("double").alias("label"))
    return model.walk_forward_status(deals, _EARLY)


_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(f"""WITH t AS (SELECT sha256({" || chr(31) || ".join(f"'{x}=' || coalesce(CAST({x} AS VARCHAR), '__NULL__')" for x in _COLS)}) AS digest FROM orders),
s AS (SELECT count(*) AS n_rows, {", ".join(f"CAST(sum(('0x' || substr(digest, {1 + 15 * i}, 15))::BIGINT) AS VARCHAR) AS s{i}" for i in range(4))} FROM t)
SELECT n_rows, sha256(n_rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM s""")
def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return model.fingerprint(c.table(spark, d, "orders"), _COLS)


_PRED = "SELECT user_id AS deal_id, CAST(ts AS DATE) AS as_of, CAST(CAST(ts AS DATE) + CAST(event_id % 9 - 7 AS INTEGER) AS DATE) AS training_cutoff, 'run' || (event_id % 3) AS model_run_id, value / 1000.0::DOUBLE AS p_break FROM events"


@query(f"""WITH pred AS ({_PRED}), cuts AS (SELECT unnest([DATE '2024-01-08', DATE '2024-01-21']) AS cutoff),
a AS (SELECT deal_id, cutoff, as_of, count(DISTINCT model_run_id) AS runs, min((model_run_id, p_break)) AS x FROM pred JOIN cuts ON as_of <= cutoff WHERE training_cutoff <= as_of GROUP BY 1, 2, 3),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY deal_id, cutoff ORDER BY as_of DESC) = 1)
SELECT deal_id, cutoff, as_of, CASE WHEN runs = 1 THEN 'ok' ELSE 'ambiguous' END AS state, CASE WHEN runs = 1 THEN x[2] END AS p_break FROM l""")
def prediction_asof(spark: SparkSession, d: str) -> DataFrame:
    pred = c.table(spark, d, "events").selectExpr("user_id as deal_id", "to_date(ts) as as_of", "date_add(to_date(ts), int(event_id % 9 - 7)) as training_cutoff", "concat('run', event_id % 3) as model_run_id", "value / 1000.0D as p_break")
    cuts = spark.createDataFrame([("2024-01-08",), ("2024-01-21",)], "c string").select(F.col("c").cast("date").alias("cutoff"))
    return model.prediction_as_of(pred, cuts)


_VINT = """SELECT series_id, obs_date, CASE WHEN day(obs_date) % 7 <> 0 THEN close END AS value FROM (SELECT event_type AS series_id, CAST(ts AS DATE) AS obs_date,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS close FROM events GROUP BY 1, 2)"""


def _vintages(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("obs_date")).agg((c.cents("value") / 100.0 / F.count("*")).alias("close"))
    return e.select("series_id", "obs_date", F.when(F.dayofmonth("obs_date") % 7 != 0, F.col("close")).alias("value"))


@query(f"""WITH v AS ({_VINT}), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS k FROM v WHERE value IS NOT NULL),
t AS (SELECT series_id, max(value) FILTER (k = 1) AS v1, max(value) FILTER (k = 2) AS v2, max(obs_date) FILTER (k = 1) AS obs_date FROM r WHERE k <= 2 GROUP BY 1)
SELECT series_id, obs_date, unnest(['level', 'simple_return', 'change']) AS feature, unnest([v1, v1 / nullif(v2, 0) - 1, v1 - v2]) AS value FROM t""")
def research_features(spark: SparkSession, d: str) -> DataFrame:
    return features.series_features(_vintages(spark, d))


@query(f"WITH v AS ({_VINT}) SELECT a.obs_date, b.value - a.value AS spread FROM v a JOIN v b USING (obs_date) WHERE a.series_id = 'view' AND b.series_id = 'purchase' AND a.value IS NOT NULL AND b.value IS NOT NULL ORDER BY 1 DESC LIMIT 1")
def common_day_spread(spark: SparkSession, d: str) -> DataFrame:
    return features.common_spread(_vintages(spark, d), "view", "purchase")


@query("""SELECT field, observed_at, CASE WHEN epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(observed_at) <= 3 * 86400000000 THEN value END AS value FROM (
  SELECT CAST(user_id AS VARCHAR) AS field, arg_max(ts, (ts, event_id)) AS observed_at, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'purchase' GROUP BY 1)""")
def market_context_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").where("event_type = 'purchase'").selectExpr("cast(user_id as string) as field", "ts as at", "event_id as seq", "value")
    return features.snapshot(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).withColumnRenamed("at", "observed_at")


@query("""SELECT field, observed_at, source, arg_min(value, (known_at, seq)) AS value, min(known_at) AS known_at FROM (
  SELECT CAST(user_id AS VARCHAR) AS field, CAST(ts AS DATE) AS observed_at, event_type AS source, event_id AS seq, value, ts + INTERVAL 1 DAY * CAST(event_id % 5 AS INTEGER) AS known_at FROM events) GROUP BY 1, 2, 3""")
def market_context_fill(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").selectExpr("cast(user_id as string) as field", "to_date(ts) as at", "event_type as source", "event_id as seq", "value", "ts + make_dt_interval(int(event_id % 5)) as known_at")
    return features.first_knowable(e).withColumnRenamed("at", "observed_at")


_TERMS = r"""SELECT l_orderkey * 10 + l_linenumber AS filing_id, 'Each share converts into $' || l_quantity::INTEGER || '.50 in cash per share' || CASE WHEN l_linenumber % 2 = 0 THEN ' and 0.' || (l_partkey % 90 + 10) || ' shares of Acquirer common stock for each share held.' ELSE '. Earlier, $' || (l_quantity::INTEGER - 1) || '.50 in cash per share was offered.' END
  || CASE WHEN l_suppkey % 10 = 0 THEN ' A contingent value right attaches.' ELSE '' END AS body FROM lineitem"""


@query(rf"""WITH f AS ({_TERMS}), m AS (SELECT filing_id, list_transform(regexp_extract_all(body, '{extract.CASH_PATTERNS[0]}', 1), lambda x: x::DOUBLE) AS c, list_transform(regexp_extract_all(body, '{extract.RATIO_PATTERNS[1]}', 1), lambda x: x::DOUBLE) AS r,
  regexp_matches(body, '{extract.MECHANICS}') AS unsupported FROM f)
SELECT filing_id, CASE WHEN unsupported THEN NULL WHEN len(r) > 0 THEN 'mixed' ELSE 'cash' END AS consideration_type, CASE WHEN NOT unsupported THEN list_max(c) END AS offer_price, CASE WHEN NOT unsupported THEN list_min(r) END AS exchange_ratio, CASE WHEN unsupported THEN 'unsupported_mechanics' END AS reason FROM m""")
def term_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Terms of two kinds, some with mechanics that can't be represented."""
    body = c.table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as filing_id",
        "concat('Each share converts into $', int(l_quantity), '.50 in cash per share', if(l_linenumber % 2 = 0, concat(' and 0.', l_partkey % 90 + 10, ' shares of Acquirer common stock for each share held.'), concat('. Earlier, $', int(l_quantity) - 1, '.50 in cash per share was offered.')), if(l_suppkey % 10 = 0, ' A contingent value right attaches.', '')) as body",
    )
    found = body.select("filing_id", extract.deal_terms(F.col("body")).alias("f")).select("filing_id", extract.decided_terms(F.col("f")).alias("t"))
    return found.select("filing_id", "t.consideration_type", "t.offer_price", "t.exchange_ratio", "t.reason")


@query("""WITH a AS (SELECT p_size AS k, p_retailprice AS x, CAST(p_size * 2 + p_retailprice % 7 AS DOUBLE) AS y FROM part)
SELECT round(covar_samp(x, x), 4) AS var_x, round(covar_samp(x, y), 4) AS cov_xy, round(covar_samp(y, y), 4) AS var_y FROM a""")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    a = c.table(spark, d, "part").selectExpr("p_retailprice as x", "cast(p_size * 2 + p_retailprice % 7 as double) as y")
    return a.agg(*[F.round(F.covar_samp(p, q), 4).alias(n) for p, q, n in (("x", "x", "var_x"), ("x", "y", "cov_xy"), ("y", "y", "var_y"))])
