"""Identity, register, validation and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit as a
from tidemark.operators import coverage, evaluation, securities
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query
from tidemark.plans.research_queries import _tokens

_DIMS = ("status", "deal_type", "consideration_type", "sector", "geography")


@query(with_views("deals", " UNION ALL ".join(f"SELECT '{x}' AS dimension, coalesce({x}, '?') AS value, count(*) AS n, count(*) FILTER (acquirer_price IS NOT NULL) AS n_covered, round(count(*) FILTER (acquirer_price IS NOT NULL) / count(*)::DOUBLE, 9) AS rate FROM deals GROUP BY 2" for x in _DIMS)))
def coverage_bias_audit(spark: SparkSession, d: str) -> DataFrame:
    return a.bias_audit(c.deals(spark, d), _DIMS, F.col("acquirer_price").isNotNull()).withColumn("rate", F.round("rate", 9))


_CLAIMS = ("occurred", "attributed_statement", "prediction", "scheduled")


@query(with_views("evidence", f"SELECT event_id, claim_type, (SELECT count(*) FROM evidence e WHERE e.event_id = g.event_id AND e.claim_type = g.claim_type) AS n FROM (SELECT event_id, unnest([{', '.join(repr(x) for x in _CLAIMS)}]) AS claim_type FROM (SELECT DISTINCT event_id FROM evidence)) g"))
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.counts_over_vocabulary(c.evidence(spark, d), "event_id", _CLAIMS, "claim_type")


@query(with_views("observations lifecycle", """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_prints, count(*) FILTER (n >= 3) AS deals_with_enough, count(*) AS deals_with_any FROM (
  SELECT o.deal_id, count(*) AS n FROM observations o JOIN (SELECT deal_id, min(event_at) FILTER (event_type IN ('closing', 'termination')) AS resolved_at FROM lifecycle GROUP BY 1) r USING (deal_id)
  WHERE target_price IS NOT NULL AND (resolved_at IS NULL OR observed_at < resolved_at) GROUP BY 1)"""))
def pre_resolution_print_stats(spark: SparkSession, d: str) -> DataFrame:
    ends = c.lifecycle(spark, d).groupBy("deal_id").agg(F.min(F.when(F.col("event_type").isin("closing", "termination"), F.col("event_at"))).alias("resolved_at"))
    return a.prints_before_resolution(c.observations(spark, d).where("target_price is not null"), ends)


_NAMES = """asked AS (SELECT o_orderkey AS deal_id, 'T' || (o_custkey % 200) AS ticker, CAST(o_orderdate AS DATE) AS as_of, 'Issuer ' || (o_custkey % 3) || ' Inc' AS asked_name FROM orders),
history AS (SELECT 'T' || (p_partkey % 200) AS ticker, p_partkey AS security, CASE WHEN p_partkey % 5 <> 0 THEN CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE) END AS valid_from,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 + p_size * 4 AS INTEGER) AS DATE) END AS valid_to, 'ISSUER ' || (p_partkey % 4) || ' Holdings' AS issuer_name FROM part)"""


@query(f"""WITH {_NAMES},
h AS (SELECT deal_id, count(DISTINCT security) AS n, min(security) AS security, bool_or(ok) AS name_agrees FROM (
  SELECT *, len(x) > 0 AND len(y) > 0 AND (len(list_filter(x, lambda w: NOT list_contains(y, w))) = 0 OR len(list_filter(y, lambda w: NOT list_contains(x, w))) = 0) AS ok FROM (
    SELECT deal_id, security, {_tokens('asked_name')} AS x, {_tokens('issuer_name')} AS y FROM asked JOIN history USING (ticker) WHERE as_of BETWEEN coalesce(valid_from, DATE '0001-01-01') AND coalesce(valid_to, DATE '9999-12-31'))) GROUP BY 1),
s AS (SELECT deal_id, security, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN NOT name_agrees THEN 'NAME_MISMATCH' ELSE 'MATCHED' END AS status FROM asked LEFT JOIN h USING (deal_id))
SELECT deal_id, status, CASE WHEN status = 'MATCHED' THEN security END AS security FROM s""")
def identifier_candidates(spark: SparkSession, d: str) -> DataFrame:
    asked = c.table(spark, d, "orders").selectExpr("o_orderkey as deal_id", "concat('T', o_custkey % 200) as ticker", "to_date(o_orderdate) as as_of", "concat('Issuer ', o_custkey % 3, ' Inc') as asked_name")
    history = c.table(spark, d, "part").selectExpr(
        "concat('T', p_partkey % 200) as ticker", "p_partkey as security", "if(p_partkey % 5 <> 0, date_add(date'1995-01-01', int(p_partkey % 1500)), null) as valid_from",
        "if(p_partkey % 7 <> 0, date_add(date'1995-01-01', int(p_partkey % 1500 + p_size * 4)), null) as valid_to", "concat('ISSUER ', p_partkey % 4, ' Holdings') as issuer_name",
    )
    return a.identifier_candidates(asked, history)


_HISTORY = """history AS (SELECT p_partkey // 2 AS permno, p_partkey // 4 AS permco, CASE WHEN p_partkey % 11 <> 0 THEN 'T' || (p_partkey // 3) END AS ticker, p_name || ' ' || p_brand || ', ' || p_size || ' Corp.' AS comnam,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(DATE '1993-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE) END AS namedt, CASE WHEN p_partkey % 7 <> 0 THEN CAST(DATE '1994-01-01' + CAST(p_partkey % 1500 + p_size * 30 AS INTEGER) AS DATE) END AS nameendt FROM part),
asked AS (SELECT o_orderkey AS deal_id, CASE WHEN o_orderkey % 3 <> 0 THEN 't' || ((p_partkey + o_orderkey % 2) // 3) END AS ticker, CAST(o_orderdate AS DATE) AS as_of,
  CASE o_orderkey % 5 WHEN 0 THEN p_name || ' ' || p_brand || ' (' || p_size || ') Corp' WHEN 1 THEN p_size || ' ' || p_name WHEN 2 THEN p_name WHEN 3 THEN p_brand || ' ' || p_size || ' ' || p_name END AS target_name FROM orders LEFT JOIN part ON o_custkey = p_partkey)"""
_PLAIN = lambda x: f"trim(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"""WITH {_HISTORY},
h AS (SELECT *, {_PLAIN('comnam')} AS name, coalesce(namedt, DATE '0001-01-01') AS s, coalesce(nameendt, DATE '9999-12-31') AS e FROM history), a AS (SELECT deal_id, upper(coalesce(ticker, '')) AS ticker, {_PLAIN('target_name')} AS want, as_of FROM asked),
w AS (SELECT want, {_tokens('want')} AS x FROM (SELECT DISTINCT want FROM a)), n AS (SELECT name, {_tokens('name')} AS y FROM (SELECT DISTINCT name FROM h)),
by_words AS (SELECT want, name FROM w JOIN n ON len(x) > 0 AND len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0),
hits AS (SELECT deal_id, CASE WHEN want <> '' AND contains(name, want) THEN 0 ELSE 1 END AS kind, as_of BETWEEN s AND e AS dated, permno, permco, namedt, nameendt FROM a JOIN h ON a.ticker <> '' AND a.ticker = h.ticker
  UNION ALL SELECT deal_id, 2, as_of BETWEEN s AND e, permno, permco, namedt, nameendt FROM a JOIN h ON want <> '' AND want = name
  UNION ALL SELECT deal_id, 3, as_of BETWEEN s AND e, permno, permco, namedt, nameendt FROM a JOIN by_words USING (want) JOIN h USING (name)),
pool AS (SELECT h.* FROM hits h JOIN (SELECT deal_id, bool_or(dated) AS any_dated FROM hits GROUP BY 1) USING (deal_id) WHERE dated OR NOT any_dated),
step AS (SELECT deal_id, min(kind) AS kind FROM pool GROUP BY 1),
g AS (SELECT deal_id, kind, bool_or(dated) AS dated, min(permno) AS lo, max(permno) AS hi, arg_min(permco, (coalesce(namedt, DATE '0001-01-01'), coalesce(nameendt, DATE '0001-01-01'), permco)) AS permco, min(coalesce(namedt, DATE '0001-01-01')) AS d FROM pool JOIN step USING (deal_id, kind) GROUP BY 1, 2)
SELECT deal_id, CASE WHEN lo IS NULL THEN 'CRSP_NO_SECURITY_MATCH' WHEN lo = hi THEN 'MATCHED' ELSE 'DEFER_CRSP_IDENTITY_AMBIGUOUS' END AS status,
  CASE WHEN lo IS NULL THEN 'CRSP_NO_SECURITY_MATCH' WHEN lo <> hi THEN 'DEFER_CRSP_IDENTITY_AMBIGUOUS' WHEN kind = 0 THEN 'ticker+name+asof' WHEN kind = 1 AND dated THEN 'ticker+asof' WHEN kind = 1 THEN 'ticker_only' WHEN kind = 2 THEN 'exact_name+asof' ELSE 'name_words+asof' END AS mapping_method,
  CASE WHEN lo = hi THEN lo END AS permno, CASE WHEN lo = hi THEN permco END AS permco, CASE WHEN lo = hi THEN nullif(d, DATE '0001-01-01') END AS effective_start,
  CASE WHEN lo IS NULL THEN NULL WHEN lo = hi AND kind = 0 THEN 'high' WHEN lo = hi AND (kind = 2 OR kind = 1 AND dated) THEN 'medium' ELSE 'low' END AS confidence
FROM a LEFT JOIN g USING (deal_id)""")
def security_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Securities out of a whole name history, for deals with a ticker, a name, both or neither."""
    part, orders = c.table(spark, d, "part"), c.table(spark, d, "orders")
    history = part.selectExpr(
        "p_partkey div 2 as permno", "p_partkey div 4 as permco", "if(p_partkey % 11 <> 0, concat('T', p_partkey div 3), null) as ticker", "concat(p_name, ' ', p_brand, ', ', p_size, ' Corp.') as comnam", "cast(null as string) as ncusip", "cast(null as int) as exchcd",
        "if(p_partkey % 5 <> 0, date_add(date'1993-01-01', int(p_partkey % 1500)), null) as namedt", "if(p_partkey % 7 <> 0, date_add(date'1994-01-01', int(p_partkey % 1500 + p_size * 30)), null) as nameendt",
    )
    name = "case o_orderkey % 5 when 0 then concat(p_name, ' ', p_brand, ' (', p_size, ') Corp') when 1 then concat(p_size, ' ', p_name) when 2 then p_name when 3 then concat(p_brand, ' ', p_size, ' ', p_name) end"
    asked = orders.join(part, F.col("o_custkey") == F.col("p_partkey"), "left").selectExpr("o_orderkey as deal_id", "if(o_orderkey % 3 <> 0, concat('t', (p_partkey + o_orderkey % 2) div 3), null) as ticker", f"{name} as target_name", "to_date(o_orderdate) as as_of")
    return securities.resolve(asked, history, by_words=True).drop("effective_end")


@query("""SELECT c_custkey AS deal_id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'R' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'M' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'ABC' END) AS ticker,
  CASE WHEN c_custkey % 5 = 0 THEN 'reviewed_sec_mapping' WHEN c_custkey % 3 = 0 THEN 'sec_company_tickers' WHEN c_custkey % 2 = 0 THEN 'id_convention' ELSE 'unresolved' END AS identity_basis FROM customer""")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    k = c.table(spark, d, "customer").selectExpr("c_custkey as deal_id", "if(c_custkey % 2 = 0, 'ABC-2026', 'no code') as name")
    return a.identity_ladder(k, k.where("deal_id % 5 = 0").selectExpr("deal_id", "concat('R', deal_id) as ticker"), k.where("deal_id % 3 = 0").selectExpr("deal_id", "concat('M', deal_id) as ticker"))


_LINE = "SELECT l_orderkey AS deal_id, CAST(o_orderdate AS DATE) AS announce_date, CAST(l_shipdate AS DATE) AS event_date, l_linenumber AS seq, CASE WHEN l_partkey % 3 = 0 THEN 'break' ELSE 'close' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""WITH t AS ({_LINE}), g AS (SELECT deal_id, arg_max(kind, (event_date, seq, kind)) AS last, bool_or(kind = 'close') AS c, bool_or(kind = 'break') AS b, max(event_date) AS event_date FROM t WHERE event_date >= announce_date AND event_date <= announce_date + INTERVAL 60 MONTH GROUP BY 1),
o AS (SELECT *, CASE WHEN c AND b AND last = 'break' THEN 'deferred_contradictory' WHEN last = 'close' THEN 'closed' ELSE 'broken' END AS resolution FROM g)
SELECT deal_id, resolution, CASE WHEN resolution <> 'deferred_contradictory' THEN event_date END AS resolution_date FROM o""")
def resolution_pick(spark: SparkSession, d: str) -> DataFrame:
    o = c.table(spark, d, "orders").selectExpr("o_orderkey as l_orderkey", "to_date(o_orderdate) as announce_date")
    kind = "if(l_partkey % 3 = 0, 'break', 'close')"
    t = c.table(spark, d, "lineitem").join(o, "l_orderkey").selectExpr("l_orderkey as deal_id", "announce_date", "to_date(l_shipdate) as event_date", f"struct(l_linenumber, {kind}) as seq", f"{kind} as kind")
    return a.pick_resolution(t)


@query("""WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'DEAL' WHEN 'P' THEN 'PROP' ELSE 'UNVR' END AS kind, 'Target ' || (o_custkey % 90) AS target, c_name AS acquirer, CASE WHEN o_orderkey % 3 = 0 THEN 'agreement' ELSE 'report' END AS row_type, CAST(o_orderdate AS DATE) AS event_date FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT kind, target, acquirer, count(*) AS n_rows, min(event_date) FILTER (row_type = 'agreement') AS agreed, min(event_date) AS first FROM r GROUP BY 1, 2, 3)
SELECT kind, target, acquirer, n_rows, kind || '-' || upper(substr(regexp_replace(target, '[^A-Za-z0-9]', '', 'g'), 1, 6)) || '-' || upper(substr(regexp_replace(acquirer, '[^A-Za-z0-9]', '', 'g'), 1, 6)) || '-' || year(coalesce(agreed, first)) AS canonical_deal_id, agreed IS NULL AS year_assumed FROM g""")
def register_grouping(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "orders").join(c.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return a.register_groups(rows.selectExpr("case o_orderstatus when 'F' then 'DEAL' when 'P' then 'PROP' else 'UNVR' end as kind", "concat('Target ', o_custkey % 90) as target", "c_name as acquirer", "if(o_orderkey % 3 = 0, 'agreement', 'report') as row_type", "to_date(o_orderdate) as event_date"))


@query(with_views("evidence", """SELECT evidence_id, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ';') AS errors, len(list_filter(e, lambda x: x IS NOT NULL)) = 0 AS valid FROM (SELECT evidence_id, [CASE WHEN known_at IS NULL THEN 'known_at_missing' END, CASE WHEN known_at < valid_at THEN 'known_before_valid' END,
  CASE WHEN source_type IN ('ai_brief', 'social_post') AND claim_type = 'occurred' THEN 'untrusted_occurred' END, CASE WHEN revises IS NOT NULL AND revision_kind IS NULL THEN 'revision_without_kind' END, CASE WHEN source_type = 'primary_official' AND NOT retrieved THEN 'unretrieved_primary' END] AS e FROM evidence)"""))
def evidence_validation(spark: SparkSession, d: str) -> DataFrame:
    return a.evidence_errors(c.evidence(spark, d))


@query(with_views("evidence", """SELECT evidence_id, array_to_string(list_filter([CASE WHEN NOT retrieved THEN 'retrieve the source' END, CASE WHEN source_type IN ('ai_brief', 'social_post') THEN 'find a primary or reputable secondary source' END,
  CASE WHEN claim_type <> 'occurred' THEN 'confirm that the event occurred' END, CASE WHEN known_at IS NULL THEN 'establish when it was known' END], lambda x: x IS NOT NULL), '; ') AS needs FROM evidence"""))
def verification_needs(spark: SparkSession, d: str) -> DataFrame:
    return a.verification_needs(c.evidence(spark, d))


@query(with_views("coverage_rows", "SELECT deal_id, CASE WHEN tiingo_status = 'TRANSIENT_FAILURE' THEN 'retry_after_reset' WHEN infrastructure_failed THEN 'refetch' WHEN identity_basis IS NULL AND tiingo_status = 'IDENTITY_AMBIGUOUS' THEN 'refetch' ELSE 'reuse' END AS action FROM coverage_rows"))
def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    return a.retry_plan(c.coverage_rows(spark, d))


_CACHED = """s_suppkey AS deal_id, CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 5 = 4 THEN NULL ELSE s_suppkey % 3 END AS tiingo_n, CASE WHEN s_suppkey % 7 < 3 THEN 0 ELSE s_suppkey % 4 END AS yahoo_n,
CASE WHEN s_suppkey % 6 = 3 THEN 'TRANSIENT_FAILURE' WHEN s_suppkey % 6 = 4 THEN 'PROVIDER_ERROR' WHEN s_suppkey % 6 = 5 THEN NULL ELSE 'AVAILABLE' END AS tiingo_status, CASE WHEN s_suppkey % 11 = 2 THEN 'TRANSIENT_FAILURE' ELSE 'NO_HISTORY' END AS yahoo_status,
CASE WHEN s_suppkey % 2 = 0 THEN 2 WHEN s_suppkey % 3 = 0 THEN 1 END AS row_schema_version, s_suppkey % 4 AS overlap_sessions, CASE WHEN s_suppkey % 9 <> 4 THEN s_suppkey % 4 END AS exact_matches, CASE WHEN s_suppkey % 8 <> 5 THEN 0 END AS tolerable_matches,
CASE WHEN s_suppkey % 13 = 3 THEN 1 WHEN s_suppkey % 10 <> 7 THEN 0 END AS material_conflicts, 'ADMITTED' AS canonical_status, CASE WHEN s_suppkey % 19 <> 1 THEN 'A' END AS identity_proofs, 'rule' AS reconcile_rule, s_suppkey % 3 = 0 AS tiingo_identity_verified"""
_PRINTS = """event_id, CASE WHEN event_id % 23 <> 0 THEN user_id END AS deal_id, CASE WHEN event_id % 17 = 3 THEN -value WHEN event_id % 19 <> 4 THEN value + 1 END AS target_price, CASE WHEN event_id % 29 <> 6 THEN date_trunc('HOUR', ts) END AS observed_at,
CASE WHEN event_id % 31 = 7 THEN '' ELSE event_type END AS source_name, event_type AS source_identifier, CASE WHEN event_id % 13 <> 5 THEN ts END AS known_at"""


@query(f"""WITH r AS (SELECT {_CACHED} FROM supplier),
f AS (SELECT *, coalesce(tiingo_n, 0) <= 0 AND coalesce(yahoo_n, 0) <= 0 AND (coalesce(tiingo_status, '') IN ('TRANSIENT_FAILURE', 'PROVIDER_ERROR', 'CREDENTIALS_REQUIRED') OR yahoo_status IN ('TRANSIENT_FAILURE', 'PROVIDER_ERROR', 'CREDENTIALS_REQUIRED')) AS infra FROM r),
k AS (SELECT *, infra OR coalesce(tiingo_status, '') = 'TRANSIENT_FAILURE' AS failed, coalesce(row_schema_version = 2 AND NOT infra AND coalesce(tiingo_status, '') <> 'TRANSIENT_FAILURE' AND yahoo_status <> 'TRANSIENT_FAILURE' AND identity_proofs IS NOT NULL AND exact_matches + tolerable_matches + material_conflicts = overlap_sessions, false) AS ok,
  (exact_matches IS NULL OR tolerable_matches IS NULL) AS unclassified FROM f),
z AS (SELECT *, unclassified AND overlap_sessions = 0 AND NOT ok AND NOT failed AS zeroed FROM k),
m AS (SELECT *, CASE WHEN zeroed THEN 0 ELSE exact_matches END AS e, CASE WHEN zeroed THEN 0 ELSE tolerable_matches END AS t, CASE WHEN zeroed THEN coalesce(material_conflicts, 0) ELSE material_conflicts END AS c FROM z),
d AS (SELECT *, CASE WHEN ok THEN 'reuse' WHEN failed THEN 'infrastructure' WHEN unclassified AND overlap_sessions <> 0 THEN 'unclassified_overlap' WHEN c IS NULL THEN 'missing_material_conflicts' WHEN identity_proofs IS NULL THEN 'missing_identity_proofs'
  WHEN e + t + c <> overlap_sessions THEN 'overlap_mismatch' WHEN yahoo_status = 'TRANSIENT_FAILURE' THEN 'not_reusable' ELSE 'migrated' END AS cache FROM m)
SELECT deal_id, cache, e AS exact_matches, t AS tolerable_matches, c AS material_conflicts, CASE WHEN cache = 'migrated' THEN 2 ELSE row_schema_version END AS row_schema_version,
  CASE WHEN cache <> 'migrated' THEN NULL WHEN zeroed THEN 'zero_overlap_classifications_are_identically_zero' ELSE 'stamped_row_schema_version_from_complete_fields' END AS row_migration,
  CASE WHEN coalesce(tiingo_status, '') <> 'TRANSIENT_FAILURE' THEN 'accept' WHEN deal_id % 5 >= 3 THEN 'unresolved' WHEN deal_id % 2 = 0 THEN 'hourly_wait' ELSE 'bounded_retry' END AS next FROM d""")
def cache_migration(spark: SparkSession, d: str) -> DataFrame:
    """Cached coverage rows of several ages: reused, brought to the present schema, or fetched again; and what follows a failure."""
    rows = coverage.cached_rows(c.table(spark, d, "supplier").selectExpr(f"inline(array(struct({_CACHED})))"))
    after = coverage.retry_decision(F.col("tiingo_status"), F.col("deal_id") % 2 == 0, F.col("deal_id") % 5)
    return rows.select("deal_id", "cache", "exact_matches", "tolerable_matches", "material_conflicts", "row_schema_version", "row_migration", after.alias("next"))


@query(f"""WITH p AS (SELECT {_PRINTS} FROM events), k AS (SELECT c_custkey AS deal_id FROM customer WHERE c_custkey % 7 <> 2),
q AS (SELECT *, array_to_string(list_filter([CASE WHEN deal_id IS NULL THEN 'missing deal_id' END, CASE WHEN target_price IS NULL OR target_price <= 0 THEN 'target_price must be a positive float' END, CASE WHEN observed_at IS NULL THEN 'missing observation_timestamp' END,
  CASE WHEN source_name = '' THEN 'missing source' END, CASE WHEN known_at IS NULL THEN 'known_at missing (never inferred for historical prints)' END], lambda x: x IS NOT NULL), '; ') AS own FROM p),
o AS (SELECT *, CASE WHEN own = '' AND deal_id NOT IN (SELECT deal_id FROM k) THEN 'orphan deal_id ' || deal_id ELSE own END AS problems FROM q),
s AS (SELECT DISTINCT deal_id, observed_at, source_name FROM p WHERE event_id % 10 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY deal_id, observed_at, source_name, problems = '' ORDER BY event_id) AS n, EXISTS (SELECT 1 FROM s WHERE s.deal_id = o.deal_id AND s.observed_at = o.observed_at AND s.source_name = o.source_name) AS had FROM o)
SELECT event_id, problems, CASE WHEN problems <> '' THEN 'quarantined' WHEN n = 1 AND NOT had THEN 'accepted' ELSE 'duplicate' END AS outcome FROM g""")
def print_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Target prints taken in: quarantined, orphans, duplicates of the store or the batch, or accepted."""
    prints = c.table(spark, d, "events").selectExpr(f"inline(array(struct({_PRINTS})))")
    deals = c.table(spark, d, "customer").where("c_custkey % 7 <> 2").selectExpr("c_custkey as deal_id")
    return coverage.ingested_prints(prints, deals, prints.where("event_id % 10 = 0"), "event_id").select("event_id", "problems", "outcome")


_BOTH = "both_ AS (SELECT geography, label, p_break AS pa, CASE WHEN deal_id % 4 <> 0 THEN least(1.0::DOUBLE, p_break * 0.5::DOUBLE + (deal_id % 10) / 20.0::DOUBLE) END AS pb FROM resolved), b AS (SELECT * FROM both_ WHERE pa IS NOT NULL AND pb IS NOT NULL)"


def _metric(p: str) -> str:
    return f"""m{p} AS (SELECT geography, max(n_pos) + max(n_neg) AS n, sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (max(n_pos) * max(n_neg)) AS roc_auc, sum(pos * (tp / (tp + fp)::DOUBLE)) / max(n_pos) AS average_precision FROM (
  SELECT *, sum(pos) OVER dn AS tp, sum(neg) OVER dn AS fp, sum(pos) OVER ev AS n_pos, sum(neg) OVER ev AS n_neg FROM (SELECT geography, p{p} AS p, sum(label) AS pos, sum(1 - label) AS neg FROM b GROUP BY 1, 2)
  WINDOW dn AS (PARTITION BY geography ORDER BY p DESC), ev AS (PARTITION BY geography)) GROUP BY 1), q{p} AS (SELECT geography, avg((p{p} - label) * (p{p} - label)) AS brier FROM b GROUP BY 1)"""


@query(with_views("resolved", "SELECT 1").removesuffix("\nSELECT 1") + f",\n{_BOTH},\n{_metric('a')},\n{_metric('b')}\n" + """SELECT ma.geography, CAST(ma.n AS BIGINT) AS n, round(mb.roc_auc - ma.roc_auc, 9) AS delta_roc_auc, round(mb.average_precision - ma.average_precision, 9) AS delta_average_precision, round(qb.brier - qa.brier, 9) AS delta_brier
FROM ma JOIN mb USING (geography) JOIN qa USING (geography) JOIN qb USING (geography)""")
def gated_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = c.resolved(spark, d).selectExpr("geography", "label", "p_break as pa", "if(deal_id % 4 <> 0, least(1.0D, p_break * 0.5D + (deal_id % 10) / 20.0D), null) as pb")
    deltas = ("delta_roc_auc", "delta_average_precision", "delta_brier")
    return a.compare_models(rows, "pa", "pb", ["geography"]).select("geography", "n", *[F.round(x, 9).alias(x) for x in deltas])


_WINDOWS = (("1997-06-30", "1998-06-30"), ("1998-06-30", "1999-06-30"), ("1999-06-30", "2000-06-30"))


@query(with_views("resolved deals", f"""SELECT cutoff, window_end, count(*) FILTER (resolution_date <= cutoff) AS n_train, count(*) FILTER (resolution_date <= cutoff AND label = 1) AS n_train_broken, count(*) FILTER (announce_date > cutoff AND announce_date <= window_end) AS n_test
FROM (SELECT *, CASE status WHEN 'broken' THEN 1 ELSE 0 END AS label FROM deals WHERE resolution_date IS NOT NULL) r JOIN (VALUES {", ".join(f"(DATE '{x}', DATE '{y}')" for x, y in _WINDOWS)}) w(cutoff, window_end) ON announce_date <= window_end GROUP BY 1, 2"""))
def walkforward_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = c.deals(spark, d).where("resolution_date is not null").withColumn("label", (F.col("status") == "broken").cast("int"))
    cuts = spark.createDataFrame(list(_WINDOWS), "a string, b string").select(F.col("a").cast("date").alias("cutoff"), F.col("b").cast("date").alias("window_end"))
    return a.plan_windows(rows, cuts)


@query(with_views("resolved", "SELECT deal_id FROM resolved WHERE deal_id NOT IN (SELECT c_custkey FROM customer)"))
def cohort_violations(spark: SparkSession, d: str) -> DataFrame:
    return a.outside_cohort(c.resolved(spark, d), c.table(spark, d, "customer").select(F.col("c_custkey").alias("deal_id")), "deal_id").select("deal_id")


@query(with_views("prices calendar", "SELECT p.series_id, p.obs_date, isodow(p.obs_date) < 6 AND coalesce(c.is_trading, true) AS valid FROM prices p LEFT JOIN calendar c USING (obs_date)"))
def session_validity(spark: SparkSession, d: str) -> DataFrame:
    return a.session_valid(c.prices(spark, d), c.calendar(spark, d)).select("series_id", "obs_date", "valid")


@query("SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') < 16 AS eligible FROM events")
def announcement_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "events").select("event_id", a.announcement_eligible(F.col("ts").cast("timestamp")).alias("eligible"))


@query(f"""WITH k AS (SELECT l_orderkey AS deal_id, 'F' || l_partkey AS figi, CASE l_suppkey % 4 WHEN 0 THEN 'Warrant' WHEN 1 THEN 'ADR' ELSE 'Common Stock' END AS security_type, 'Name ' || (l_orderkey % 5) || ' Corp' AS asked_name, 'NAME ' || (l_partkey % 5) AS name FROM lineitem),
t AS (SELECT *, {_tokens('asked_name')} AS x, {_tokens('name')} AS y, security_type <> 'Warrant' AS ok FROM k),
g AS (SELECT deal_id, count(*) FILTER (ok) AS n, count(DISTINCT figi) FILTER (ok AND agrees) AS named, min(figi) FILTER (ok AND agrees) AS figi FROM (SELECT *, len(x) > 0 AND len(y) > 0 AND (len(list_filter(x, lambda w: NOT list_contains(y, w))) = 0 OR len(list_filter(y, lambda w: NOT list_contains(x, w))) = 0) AS agrees FROM t) GROUP BY 1),
s AS (SELECT *, CASE WHEN n = 0 THEN 'NO_MATCH' WHEN named = 0 THEN 'NAME_MISMATCH' WHEN named > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM g)
SELECT deal_id, status, CASE WHEN status = 'MATCHED' THEN figi END AS figi FROM s""")
def figi_mapping_status(spark: SparkSession, d: str) -> DataFrame:
    k = c.table(spark, d, "lineitem").selectExpr("l_orderkey as deal_id", "concat('F', l_partkey) as figi", "case l_suppkey % 4 when 0 then 'Warrant' when 1 then 'ADR' else 'Common Stock' end as security_type", "concat('Name ', l_orderkey % 5, ' Corp') as asked_name", "concat('NAME ', l_partkey % 5) as name")
    return a.figi_status(k)


@query("SELECT event_id, upper(substr(sha1(coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(event_type, '') || '|' || coalesce(CASE WHEN event_id % 5 <> 0 THEN 'a' END, '')), 1, 16)) AS event_key FROM events")
def event_keys(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "events").select("event_id", a.event_key(F.col("user_id"), F.col("event_type"), F.when(F.col("event_id") % 5 != 0, "a")).alias("event_key"))


@query(with_views("resolved", """SELECT count(*) FILTER (p_break >= t AND label = 1) AS tp, count(*) FILTER (p_break >= t AND label = 0) AS fp, count(*) FILTER (p_break < t AND label = 1) AS fn, count(*) FILTER (p_break < t AND label = 0) AS tn FROM resolved, (
  SELECT arg_min(t, (cost, t)) AS t FROM (SELECT t, (SELECT count(*) FILTER (label = 0 AND p_break >= t) + 15 * count(*) FILTER (label = 1 AND p_break < t) FROM resolved WHERE announce_date < DATE '1997-01-01') AS cost
    FROM (SELECT DISTINCT p_break AS t FROM resolved WHERE announce_date < DATE '1997-01-01' UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE))) WHERE announce_date >= DATE '1997-01-01'"""))
def frozen_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest threshold of the training rows, applied unchanged to later ones."""
    rows = c.resolved(spark, d).withColumn("all", F.lit(1))
    early, later = rows.where("announce_date < date'1997-01-01'"), rows.where("announce_date >= date'1997-01-01'")
    t = evaluation.optimal_threshold(early, ["all"]).select("threshold")
    hit, yes = F.col("p_break") >= F.col("threshold"), F.col("label") == 1
    return later.crossJoin(F.broadcast(t)).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
