"""Evidence, canonical, price and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SNAPSHOT_POLICIES
from tidemark.functions import dates, text
from tidemark.operators import canonical, evidence, prices
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.pit_queries import many_cutoffs, many_cutoffs_sql
from tidemark.plans.registry import query

CUT = ("2026-04-01 00:00:00", "2026-10-01 00:00:00", "2027-03-01 00:00:00")


def cutoffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in CUT], "c string").select(F.col("c").cast("timestamp_ntz").alias("cutoff"))


_CUT = "cuts AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{x}'" for x in CUT) + "]) AS cutoff)"


def _status(known: str) -> str:
    return f"""known AS ({known}),
rev AS (SELECT event_id, cutoff, revises AS evidence_id, bool_or(revision_kind = 'retraction') AS retracted FROM known WHERE revises IS NOT NULL GROUP BY ALL),
marked AS (SELECT k.*, coalesce(r.retracted, false) AS retracted, r.evidence_id IS NULL AND coalesce(k.revision_kind, '') <> 'retraction' AS in_effect FROM known k LEFT JOIN rev r ON r.event_id = k.event_id AND r.cutoff = k.cutoff AND r.evidence_id = k.evidence_id),
flags AS (SELECT *, source_type NOT IN ('ai_brief', 'social_post', 'other') AS tk, in_effect AND source_type NOT IN ('ai_brief', 'social_post', 'other') AND retrieved AS tr FROM marked),
agg AS (SELECT event_id, cutoff, count(*) AS n_records, count(*) FILTER (tr AND stance = 'supports') AS support, count(*) FILTER (tr AND stance = 'contradicts') AS against,
  count(*) FILTER (tr AND stance = 'supports' AND source_type = 'primary_official' AND claim_type = 'occurred') AS primary_for, count(*) FILTER (tr AND stance = 'contradicts' AND source_type = 'primary_official') AS primary_against,
  count(DISTINCT publisher) FILTER (tr AND stance = 'supports' AND source_type = 'reputable_secondary' AND claim_type = 'occurred') AS publishers,
  count(*) FILTER (tr AND stance = 'supports' AND claim_type IN ('attributed_statement', 'scheduled', 'occurred')) AS attributable, count(*) FILTER (retracted AND tk) AS withdrawn,
  max(valid_at) FILTER (tr AND stance = 'supports' AND claim_type = 'occurred') AS valid_at FROM flags GROUP BY 1, 2),
states AS (SELECT event_id, cutoff, n_records, publishers, valid_at, CASE WHEN withdrawn > 0 AND support = 0 THEN 'RETRACTED' WHEN primary_against > 0 OR (against > 0 AND primary_for = 0) THEN 'DISPUTED'
  WHEN primary_for > 0 THEN 'VERIFIED_PRIMARY' WHEN publishers >= 2 THEN 'CORROBORATED_SECONDARY' WHEN attributable > 0 THEN 'ATTRIBUTED_CLAIM' ELSE 'UNCONFIRMED' END AS status FROM agg)"""


_AT_CUTS = _CUT + ",\n" + _status("SELECT e.*, cutoff FROM evidence e JOIN cuts ON known_at <= cutoff")
_AT_POINTS = _status("SELECT e.*, cutoff FROM evidence e JOIN (SELECT DISTINCT event_id, known_at AS cutoff FROM evidence WHERE known_at IS NOT NULL) p ON p.event_id = e.event_id AND e.known_at <= cutoff") + """,
hist AS (SELECT event_id, cutoff AS as_of_utc, status FROM (SELECT *, lag(status) OVER (PARTITION BY event_id ORDER BY cutoff) AS before FROM states) WHERE before IS NULL OR before <> status)"""


def _sql(views: str, more: str, body: str) -> str:
    return with_views(views, "SELECT 1").removesuffix("\nSELECT 1") + f",\n{more}\n{body}"


@query(_sql("evidence", _AT_CUTS, "SELECT event_id, cutoff, n_records, publishers, valid_at, status FROM states"))
def evidence_status_asof(spark: SparkSession, d: str) -> DataFrame:
    return evidence.status(evidence.effective(c.evidence(spark, d), cutoffs(spark)))


@query(_sql("evidence", _status(f"SELECT e.*, cutoff FROM evidence e JOIN {many_cutoffs_sql(6)} ON known_at <= cutoff"), "SELECT event_id, cutoff, status FROM states"))
def evidence_status_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Statuses at the cut-offs that lie six hours apart."""
    return evidence.status_at(c.evidence(spark, d), many_cutoffs(spark, 6))


@query(_sql("evidence", _AT_POINTS, "SELECT event_id, as_of_utc, status FROM hist"))
def status_history(spark: SparkSession, d: str) -> DataFrame:
    return evidence.status_history(c.evidence(spark, d))


_SINCE = f"""since AS (SELECT event_id, min(as_of_utc) FILTER (status IN ('VERIFIED_PRIMARY', 'CORROBORATED_SECONDARY') AND (bad IS NULL OR as_of_utc > bad)) AS admissible_since
  FROM (SELECT *, max(as_of_utc) FILTER (status NOT IN ('VERIFIED_PRIMARY', 'CORROBORATED_SECONDARY')) OVER (PARTITION BY event_id) AS bad FROM hist WHERE as_of_utc <= TIMESTAMP '{CUT[2]}') GROUP BY 1)"""


@query(_sql("evidence", _AT_POINTS + ",\n" + _SINCE, "SELECT event_id, admissible_since FROM since WHERE admissible_since IS NOT NULL"))
def admissible_since(spark: SparkSession, d: str) -> DataFrame:
    return evidence.admissible_since(evidence.status_history(c.evidence(spark, d)), F.lit(CUT[2]).cast("timestamp_ntz"))


@query(
    _sql("evidence", _AT_POINTS + ",\n" + _SINCE, f"""SELECT s.event_id, s.cutoff, s.status, s.valid_at, admissible_since, CASE WHEN s.status NOT IN ('VERIFIED_PRIMARY', 'CORROBORATED_SECONDARY') THEN 'status_' || s.status WHEN s.valid_at IS NULL THEN 'missing_valid_time'
  WHEN s.valid_at > s.cutoff THEN 'valid_time_after_prediction_time' WHEN admissible_since IS NULL OR admissible_since > s.cutoff THEN 'known_at_after_prediction_time' ELSE 'admitted' END AS decision
FROM (SELECT event_id, TIMESTAMP '{CUT[2]}' AS cutoff, status, valid_at FROM states QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY (cutoff <= TIMESTAMP '{CUT[2]}') DESC, cutoff DESC) = 1) s LEFT JOIN since USING (event_id)""")
)
def research_candidates(spark: SparkSession, d: str) -> DataFrame:
    records, at = c.evidence(spark, d), F.lit(CUT[2]).cast("timestamp_ntz")
    one = spark.range(1).select(at.alias("cutoff"))
    since = evidence.admissible_since(evidence.status_history(records), at)
    return evidence.candidates(evidence.status(evidence.effective(records, one)), since)


@query(with_views("evidence", "SELECT evidence_id, first_value(evidence_id) OVER w AS accepted_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM evidence WINDOW w AS (PARTITION BY event_id, publisher, stance, claim_type ORDER BY evidence_id)"))
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    return evidence.first_of_each(c.evidence(spark, d), ["event_id", "publisher", "stance", "claim_type"], "evidence_id").select("evidence_id", "accepted_id", "outcome")


_REVISED = "SELECT event_id AS evidence_id, CASE WHEN event_id % 41 <> 0 THEN event_id - 1 END AS revises FROM events"


@query(f"""WITH RECURSIVE r AS ({_REVISED}), chain AS (
  SELECT evidence_id, evidence_id AS root, 0 AS steps FROM r WHERE revises IS NULL UNION ALL SELECT r.evidence_id, chain.root, chain.steps + 1 FROM r JOIN chain ON r.revises = chain.evidence_id)
SELECT evidence_id, root, CAST(steps AS INTEGER) AS steps FROM chain""")
def revision_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to 40 revisions."""
    return evidence.revision_chain(c.table(spark, d, "events").selectExpr("event_id as evidence_id", "if(event_id % 41 <> 0, event_id - 1, null) as revises"))


@query(with_views("deals", """SELECT link_id, k.deal_id, event_date, CASE WHEN announce_date IS NULL THEN 'unknown_deal' WHEN event_date < announce_date THEN 'before_announcement' WHEN event_date > coalesce(CAST(resolution_date + 30 AS DATE), DATE '9999-12-31') THEN 'after_resolution' ELSE 'valid' END AS decision
FROM (SELECT l_orderkey * 10 + l_linenumber AS link_id, CASE WHEN l_linenumber = 5 THEN -l_orderkey ELSE l_orderkey END AS deal_id, CAST(l_shipdate AS DATE) AS event_date FROM lineitem) k LEFT JOIN deals d ON d.deal_id = k.deal_id"""))
def exposure_window(spark: SparkSession, d: str) -> DataFrame:
    links = c.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as link_id", "if(l_linenumber = 5, -l_orderkey, l_orderkey) as deal_id", "to_date(l_shipdate) as event_date")
    return evidence.exposure_windows(links, c.deals(spark, d))


_STAGED = """staged AS (SELECT event_id AS evidence_id, user_id AS deal_id, CASE event_type WHEN 'signup' THEN 'announcement' WHEN 'view' THEN 'proposal_submitted' WHEN 'click' THEN 'talks_reported' WHEN 'error' THEN 'termination' ELSE 'closing' END AS event_type,
  CAST(ts AS DATE) AS valid_at, CAST(ts + INTERVAL 1 DAY * CAST(event_id % 5 AS INTEGER) AS DATE) AS known_at, 'src' || (event_id % 3) AS source,
  CASE event_id % 5 WHEN 0 THEN 'sec_metadata_confirmed' WHEN 1 THEN 'press_multi' WHEN 2 THEN 'press_single' WHEN 3 THEN 'unverified_staging' ELSE 'reported_only' END AS level,
  upper(substr(sha1(user_id || '|' || CASE event_type WHEN 'signup' THEN 'announcement' WHEN 'view' THEN 'proposal_submitted' WHEN 'click' THEN 'talks_reported' WHEN 'error' THEN 'termination' ELSE 'closing' END || '|' || strftime(ts, '%Y-%m-%d')), 1, 12)) AS event_id2 FROM events),
ranked AS (SELECT *, (CASE level WHEN 'sec_metadata_confirmed' THEN -4 WHEN 'press_multi' THEN -3 WHEN 'press_single' THEN -2 WHEN 'unverified_staging' THEN -1 ELSE 0 END, known_at, evidence_id) AS o FROM staged),
merged AS (SELECT event_id2 AS event_id, min(deal_id) AS deal_id, min(event_type) AS event_type, min(valid_at) AS valid_at, count(DISTINCT evidence_id) AS n_evidence, arg_min(level, o) AS level, arg_min(evidence_id, o) AS primary_id, arg_min(known_at, o) AS known_at,
  array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM ranked GROUP BY 1)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "events").selectExpr(
        "event_id as evidence_id", "user_id as deal_id", "case event_type when 'signup' then 'announcement' when 'view' then 'proposal_submitted' when 'click' then 'talks_reported' when 'error' then 'termination' else 'closing' end as event_type",
        "to_date(ts) as valid_at", "to_date(ts + make_dt_interval(int(event_id % 5))) as known_at", "concat('src', event_id % 3) as source",
        "case event_id % 5 when 0 then 'sec_metadata_confirmed' when 1 then 'press_multi' when 2 then 'press_single' when 3 then 'unverified_staging' else 'reported_only' end as level",
    )
    return canonical.event_ids(rows)


@query("WITH " + _STAGED + "\nSELECT event_id, deal_id, event_type, valid_at, n_evidence, level, primary_id, known_at, sources FROM merged")
def canonical_event_merge(spark: SparkSession, d: str) -> DataFrame:
    return canonical.merge_events(_staged(spark, d))


@query("WITH " + _STAGED + """
SELECT deal_id, outcome_candidate, CASE WHEN outcome_candidate LIKE 'Y%' THEN rid END AS resolution_event_id FROM (
  SELECT u.deal_id, CASE WHEN c AND b THEN 'conflict' WHEN c THEN 'Y0_closed' WHEN b THEN 'Y1_broken' ELSE 'censored' END AS outcome_candidate, rid FROM (SELECT DISTINCT deal_id FROM merged) u LEFT JOIN (
    SELECT deal_id, bool_or(g AND event_type = 'closing') AS c, bool_or(g AND event_type IN ('termination', 'withdrawal')) AS b, arg_min(event_id, (valid_at, event_type, event_id)) FILTER (g AND event_type IN ('closing', 'termination', 'withdrawal')) AS rid
    FROM (SELECT *, level IN ('sec_metadata_confirmed', 'press_multi') AS g FROM merged WHERE valid_at <= DATE '2024-01-04' AND known_at <= DATE '2024-01-04') GROUP BY 1) USING (deal_id))""")
def outcome_asof(spark: SparkSession, d: str) -> DataFrame:
    return canonical.outcome_as_of(canonical.merge_events(_staged(spark, d)), F.lit("2024-01-04").cast("date"))


@query("SELECT coalesce(a.k, b.k) AS deal_id, CASE WHEN a.k IS NULL THEN 'staged_only' ELSE 'reviewed_only' END AS side FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def staging_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    staged = c.table(spark, d, "orders").selectExpr("o_custkey + if(o_orderkey % 50 = 0, 1000000, 0) as deal_id").distinct()
    return canonical.reconcile_ids(c.table(spark, d, "customer").select(F.col("c_custkey").alias("deal_id")), staged, "deal_id")


@query("SELECT coalesce(a.k, b.k) AS deal_id, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k")
def common_universe(spark: SparkSession, d: str) -> DataFrame:
    o = c.table(spark, d, "orders").select(F.col("o_custkey").alias("deal_id"), "o_orderstatus")
    return canonical.common_universe(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "deal_id")


_AGREE = "CASE WHEN close_b IS NULL THEN 'A_ONLY' WHEN close_a IS NULL THEN 'B_ONLY' WHEN close_a = close_b THEN 'EXACT' WHEN abs(close_a - close_b) <= 0.01::DOUBLE OR abs(close_a - close_b) / greatest(abs(close_a), abs(close_b), 1e-12) <= 0.0001::DOUBLE THEN 'TOLERABLE' ELSE 'CONFLICT' END"
_SIDES = "sides AS (SELECT coalesce(a.deal_id, b.deal_id) AS deal_id, coalesce(a.session_date, b.session_date) AS session_date, a.close AS close_a, b.close AS close_b FROM (SELECT * FROM provider_prints WHERE provider = 'a') a FULL JOIN (SELECT * FROM provider_prints WHERE provider = 'b') b ON a.deal_id = b.deal_id AND a.session_date = b.session_date)"


@query(_sql("provider_prints", _SIDES, f"SELECT deal_id, session_date, close_a, close_b, {_AGREE} AS agreement FROM sides"))
def reconcile_series(spark: SparkSession, d: str) -> DataFrame:
    return prices.reconcile(c.provider_prints(spark, d))


@query(_sql("provider_prints", _SIDES, f"SELECT deal_id, count(*) AS sessions, {', '.join(f'''count(*) FILTER (g = '{k}') AS {k.lower()}''' for k in ('EXACT', 'TOLERABLE', 'CONFLICT', 'A_ONLY', 'B_ONLY'))} FROM (SELECT *, {_AGREE} AS g FROM sides) GROUP BY 1"))
def reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    return prices.reconcile_totals(prices.reconcile(c.provider_prints(spark, d)))


_ADMIT = """
pr AS (SELECT *, openfigi_status = 'MATCHED' AS pa, tiingo_identity_verified AS pb, coalesce(identity_basis = 'reviewed_sec_mapping', false) AS pc,
  CASE WHEN openfigi_status IN ('AMBIGUOUS', 'NAME_MISMATCH') THEN 'OPENFIGI_' || openfigi_status WHEN tiingo_status = 'IDENTITY_AMBIGUOUS' THEN 'TIINGO_IDENTITY_AMBIGUOUS' END AS veto FROM coverage_rows),
st AS (SELECT *, tiingo_n = 0 AND yahoo_n > 0 AND NOT yahoo_identity_verified AND NOT pa AND NOT pb AS reused, veto IS NOT NULL AND NOT pc AS vetoed FROM pr),
ad AS (SELECT *, CASE WHEN infrastructure_failed THEN NULL WHEN vetoed THEN 'DEFERRED_IDENTITY' WHEN material_conflicts > 0 THEN 'DEFERRED_PRICE_CONFLICT' WHEN tiingo_n = 0 AND yahoo_n = 0 THEN 'NO_PRICE_HISTORY'
    WHEN reused OR NOT (pa OR pb OR pc) THEN 'DEFERRED_IDENTITY' WHEN combined_n >= 3 THEN 'CANONICALLY_ADMITTED' ELSE 'INSUFFICIENT_CANONICAL_PRINTS' END AS status FROM st),
rs AS (SELECT *, CASE WHEN infrastructure_failed THEN 'UNRESOLVED_INFRASTRUCTURE' WHEN status <> 'DEFERRED_IDENTITY' THEN NULL WHEN vetoed THEN veto WHEN reused THEN 'YAHOO_TICKER_REUSE_UNVALIDATED' ELSE 'DEFER_IDENTITY_UNCONFIRMED' END AS reason,
  CASE WHEN tiingo_n >= 3 AND yahoo_n >= 3 THEN 'MULTI_PROVIDER_CONFIRMED' WHEN tiingo_n >= 3 THEN 'TIINGO_COVERED' WHEN yahoo_n >= 3 AND tiingo_n = 0 THEN 'YAHOO_ONLY' WHEN tiingo_n = 0 AND yahoo_n = 0 THEN 'NO_PUBLIC_PRICE_HISTORY' ELSE 'OTHER' END AS mix FROM ad),
gc AS (SELECT *, CASE WHEN status = 'CANONICALLY_ADMITTED' THEN mix WHEN reason = 'YAHOO_TICKER_REUSE_UNVALIDATED' THEN reason WHEN coalesce(status, '') = 'DEFERRED_PRICE_CONFLICT' OR material_conflicts > 0 THEN 'DEFER_PRICE_CONFLICT'
  WHEN status = 'NO_PRICE_HISTORY' THEN CASE WHEN tiingo_status = 'SYMBOL_NOT_FOUND' THEN 'TIINGO_NO_SYMBOL' WHEN tiingo_status IN ('NO_HISTORY', 'ok') THEN 'TIINGO_NO_HISTORY' WHEN tiingo_status = 'TRANSIENT_FAILURE' THEN 'PROVIDER_TRANSIENT_FAILURE' ELSE 'NO_PUBLIC_PRICE_HISTORY' END
  WHEN openfigi_status = 'AMBIGUOUS' THEN 'SECURITY_IDENTITY_AMBIGUOUS' WHEN openfigi_status = 'NAME_MISMATCH' THEN 'SECURITY_IDENTITY_NAME_MISMATCH' WHEN tiingo_status = 'IDENTITY_AMBIGUOUS' THEN 'SECURITY_IDENTITY_AMBIGUOUS'
  WHEN (tiingo_n > 0 OR yahoo_n > 0) AND NOT (pa OR pb OR pc) THEN 'DEFER_IDENTITY_UNCONFIRMED' WHEN openfigi_status = 'NO_MATCH' THEN 'OPENFIGI_NO_MATCH' ELSE mix END AS gap_class FROM rs)"""


@query(_sql("coverage_rows", _ADMIT.strip(), "SELECT deal_id, status, reason, gap_class, CAST(pa::INT + pb::INT + pc::INT AS INTEGER) AS n_proofs FROM gc"))
def admission_status(spark: SparkSession, d: str) -> DataFrame:
    return prices.gap_class(prices.admission(c.coverage_rows(spark, d))).select("deal_id", "status", "reason", "gap_class", F.size("proofs").alias("n_proofs"))


@query(_sql("coverage_rows", _ADMIT.strip(), "SELECT gap_class, count(*) AS n_deals, count(*) FILTER (status = 'CANONICALLY_ADMITTED') AS admitted FROM gc GROUP BY 1"))
def overlap_population_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = prices.gap_class(prices.admission(c.coverage_rows(spark, d)))
    return rows.groupBy("gap_class").agg(F.count("*").alias("n_deals"), F.count_if(F.col("status") == "CANONICALLY_ADMITTED").alias("admitted"))


@query("""WITH a AS (SELECT l_orderkey AS deal_id, l_linenumber AS place, 'p' || l_linenumber AS provider, CASE WHEN l_quantity > 35 THEN 'ok' WHEN l_quantity < 6 THEN 'IDENTITY_AMBIGUOUS' ELSE 'NO_HISTORY' END AS status, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem),
g AS (SELECT deal_id, min(place) FILTER (status = 'IDENTITY_AMBIGUOUS') AS stop, min(place) FILTER (status = 'ok') AS ok, string_agg(provider || ':' || status, ',' ORDER BY place, provider, status) AS trace FROM a GROUP BY 1)
SELECT deal_id, CAST(CASE WHEN ok IS NOT NULL AND (stop IS NULL OR ok < stop) THEN ok END AS INTEGER) AS chosen_place, CASE WHEN ok IS NOT NULL AND (stop IS NULL OR ok < stop) THEN 'OK' WHEN stop IS NOT NULL THEN 'IDENTITY_AMBIGUOUS' ELSE 'NO_HISTORY' END AS result, trace FROM g""")
def provider_fallback(spark: SparkSession, d: str) -> DataFrame:
    a = c.table(spark, d, "lineitem").selectExpr("l_orderkey as deal_id", "l_linenumber as place", "concat('p', l_linenumber) as provider", "case when l_quantity > 35 then 'ok' when l_quantity < 6 then 'IDENTITY_AMBIGUOUS' else 'NO_HISTORY' end as status")
    return prices.fallback_choice(a)


_SNAPS = """sess AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS ordinal FROM calendar WHERE is_trading),
passed AS (SELECT c.obs_date, count(s.ordinal) OVER (ORDER BY c.obs_date) AS passed FROM calendar c LEFT JOIN sess s ON s.obs_date = c.obs_date),
pol(policy, in_days, after) AS (VALUES """ + ", ".join(f"('{n}', {str(k == 'days').lower()}, {x})" for n, (k, offsets) in SNAPSHOT_POLICIES.items() for x in offsets) + """),
snaps AS (SELECT deal_id, policy, after, announce_date, s.obs_date AS feature_date, resolution_date IS NULL OR s.obs_date < resolution_date AS pending
  FROM deals d CROSS JOIN pol JOIN passed f ON f.obs_date = CASE WHEN in_days THEN CAST(announce_date + (after - 1) AS DATE) ELSE announce_date END JOIN sess s ON s.ordinal = f.passed + CASE WHEN in_days THEN 1 ELSE after END)"""


@query(_sql("deals calendar", _SNAPS, "SELECT deal_id, policy, after, announce_date, feature_date, pending FROM snaps"))
def feature_session_policy(spark: SparkSession, d: str) -> DataFrame:
    return prices.snapshot_rows(c.deals(spark, d), c.calendar(spark, d))


@query(_sql("deals calendar", _SNAPS, "SELECT deal_id, s.policy, after, round(1.0::DOUBLE / (n * count(*) OVER (PARTITION BY s.policy, deal_id)), 12) AS weight FROM snaps s JOIN (SELECT policy, count(DISTINCT deal_id) AS n FROM snaps GROUP BY 1) t ON t.policy = s.policy"))
def deal_equal_weight(spark: SparkSession, d: str) -> DataFrame:
    rows = prices.snapshot_weights(c.deals(spark, d), c.calendar(spark, d))
    return rows.select("deal_id", "policy", "after", F.round("weight", 12).alias("weight"))


@query(_sql("deals calendar", _SNAPS, "SELECT policy, CASE WHEN announce_date < DATE '1998-06-30' THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, count(DISTINCT deal_id) AS n_deals FROM snaps GROUP BY 1, 2"))
def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    rows = prices.grouped_split(prices.snapshot_rows(c.deals(spark, d), c.calendar(spark, d)), F.lit("1998-06-30").cast("date"))
    return rows.groupBy("policy", "split").agg(F.count("*").alias("n_rows"), F.count_distinct("deal_id").alias("n_deals"))


_PIT = """SELECT event_id, CASE WHEN ts_text IS NULL THEN 'MISSING' WHEN length(ts_text) = 10 OR substr(ts_text, 12, 8) = '00:00:00' THEN 'DATE_ONLY' ELSE 'INTRADAY' END AS time_precision
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text FROM events)"""


def _precision(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").selectExpr("event_id", "case event_id % 3 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") end as ts_text")
    return e.select("event_id", dates.time_precision(F.col("ts_text")).alias("time_precision"))


@query(_PIT)
def pit_flags(spark: SparkSession, d: str) -> DataFrame:
    return _precision(spark, d)


@query(f"SELECT time_precision, count(*) AS n FROM ({_PIT}) GROUP BY 1")
def pit_precision_summary(spark: SparkSession, d: str) -> DataFrame:
    return _precision(spark, d).groupBy("time_precision").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/?utm_source=x&b=2&a=1#top' WHEN page_id % 3 = 1 THEN upper(substr(url, 1, 12)) || substr(url, 13) || '///' ELSE url END AS u FROM pages),
q AS (SELECT page_id, regexp_replace(u, '#.*$', '') AS u FROM p),
h AS (SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params FROM q)
SELECT page_id, host, scheme || '://' || host || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM h""")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    p = c.table(spark, d, "pages").selectExpr("page_id", "case page_id % 3 when 0 then concat(url, '/?utm_source=x&b=2&a=1#top') when 1 then concat(upper(substr(url, 1, 12)), substr(url, 13), '///') else url end as u")
    return p.select("page_id", text.url_host(F.col("u")).alias("host"), text.canonical_url(F.col("u")).alias("canonical_url"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "pages").select("page_id", text.html_strip(F.col("html")).alias("body"))


_TOK = "list_distinct(list_filter(string_split_regex(trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda w: w <> '' AND w NOT IN ({1})))"


def _tokens(expr: str) -> str:
    from tidemark.config import NAME_FILLER

    return _TOK.format(expr, ", ".join(f"'{w}'" for w in NAME_FILLER))


@query(f"""WITH n AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ', Inc.' WHEN 1 THEN 'The ' || split_part(p_name, ' ', 1) || ' Corp' WHEN 2 THEN p_name || ' & Sons' ELSE p_brand END AS b FROM part),
t AS (SELECT p_partkey, {_tokens('a')} AS x, {_tokens('b')} AS y FROM n)
SELECT p_partkey, len(x) > 0 AND len(y) > 0 AND (len(list_filter(x, lambda w: NOT list_contains(y, w))) = 0 OR len(list_filter(y, lambda w: NOT list_contains(x, w))) = 0) AS agree FROM t""")
def identity_name_match(spark: SparkSession, d: str) -> DataFrame:
    p = c.table(spark, d, "part").selectExpr("p_partkey", "p_name as a", "case p_partkey % 4 when 0 then concat(upper(p_name), ', Inc.') when 1 then concat('The ', split_part(p_name, ' ', 1), ' Corp') when 2 then concat(p_name, ' & Sons') else p_brand end as b")
    return p.select("p_partkey", text.names_agree(F.col("a"), F.col("b")).alias("agree"))
