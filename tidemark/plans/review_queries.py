"""Filing review, stamps, codes, calibration and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, finance, text
from tidemark.operators import isotonic
from tidemark.operators import review as r
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query
from tidemark.sources import readers

_FORM = "case l_partkey % 7 when 0 then '8-K' when 1 then '8-K/A' when 2 then '425' when 3 then '25-NSE' when 4 then 'RW' when 5 then 'S-4' else '10-Q' end"
_ITEM = "case l_suppkey % 5 when 0 then '1.01' when 1 then '2.01, 9.01' when 2 then '1.02' when 3 then '8.01,9.01' end"
_ACCESSION = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
_FILINGS = f"filings AS (SELECT l_orderkey AS deal_id, {_ACCESSION} AS accession, {_FORM} AS form, {_ITEM} AS items, CAST(l_shipdate AS DATE) AS filed FROM lineitem)"


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "lineitem").selectExpr("l_orderkey as deal_id", f"{_ACCESSION} as accession", f"{_FORM} as form", f"{_ITEM} as items", "to_date(l_shipdate) as filed")


def _rule(event: str, forms: tuple, items: tuple, others: tuple) -> str:
    some = " OR ".join(f"items LIKE '%{x}%'" for x in items)
    return f"SELECT accession, '{event}' AS event FROM filings WHERE (form IN {forms} AND ({some}))" + (f" OR form IN ({', '.join(repr(x) for x in others)})" if others else "")


@query(f"WITH {_FILINGS}\n" + " UNION ALL ".join(_rule(*x) for x in readers.EVENT_RULES))
def filing_event_match(spark: SparkSession, d: str) -> DataFrame:
    return readers.filing_events(_filings(spark, d).withColumn("items", r.item_list(F.col("items")))).select("accession", "event")


@query(f"""WITH {_FILINGS}
SELECT deal_id, accession, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY CASE WHEN form IN ('8-K', '8-K/A') AND items LIKE '%1.01%' THEN 0 WHEN form IN ('8-K', '8-K/A') THEN 1 WHEN form = 'S-4' THEN 2 ELSE 3 END, filed, accession) AS INTEGER) AS place FROM filings""")
def filing_preference(spark: SparkSession, d: str) -> DataFrame:
    return r.preferred_filings(_filings(spark, d)).select("deal_id", "accession", "place")


@query(with_views("deals", "SELECT 1").removesuffix("\nSELECT 1") + f",\n{_FILINGS}\nSELECT accession, filed >= announce_date - 365 AND filed <= greatest(announce_date, coalesce(resolution_date, announce_date)) AS contemporaneous FROM filings JOIN deals USING (deal_id)")
def contemporaneous_filings(spark: SparkSession, d: str) -> DataFrame:
    rows = _filings(spark, d).join(c.deals(spark, d).select("deal_id", "announce_date", "resolution_date"), "deal_id")
    return rows.select("accession", r.contemporaneous(F.col("filed"), F.col("announce_date"), F.col("resolution_date")).alias("contemporaneous"))


_LISTED = "case when p_partkey % 4 <> 0 then date'1995-01-01' + cast(p_partkey % 900 as integer) end as first_day, case when p_partkey % 3 <> 0 then date'1995-01-01' + cast(p_partkey % 900 + p_size * 30 as integer) end as last_day"


@query(f"SELECT o_orderkey AS deal_id, p_partkey AS security, coalesce(first_day <= day, false) AND coalesce(last_day >= day, true) AS covers FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders) JOIN (SELECT p_partkey, {_LISTED} FROM part) ON p_partkey = o_custkey")
def listing_window(spark: SparkSession, d: str) -> DataFrame:
    listed = c.table(spark, d, "part").selectExpr("p_partkey", _LISTED.split(", case")[0], "case" + _LISTED.split(", case")[1])
    asked = c.table(spark, d, "orders").selectExpr("o_orderkey as deal_id", "o_custkey as p_partkey", "to_date(o_orderdate) as day")
    return asked.join(listed, "p_partkey").select("deal_id", F.col("p_partkey").alias("security"), r.listing_covers(F.col("first_day"), F.col("last_day"), F.col("day")).alias("covers"))


_FLAG = "case event_id % 6 when 0 then '' when 1 then ' ' when 2 then 'T' when 3 then 'A' when 4 then 'x' end"


@query(f"SELECT event_id, coalesce({_FLAG}, '') IN ('', ' ', 'T') AS accepted FROM events")
def price_flag_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return c.table(spark, d, "events").select("event_id", r.traded_close(F.expr(_FLAG)).alias("accepted"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 23:59:59.999999' AND ts <= TIMESTAMP '2024-01-12 23:59:59.999999'")
def feature_window(spark: SparkSession, d: str) -> DataFrame:
    start, end = (dates.as_of(F.lit(x)) for x in ("2024-01-05", "2024-01-12"))
    return c.table(spark, d, "events").where(r.in_window(F.col("ts").cast("timestamp_ntz"), start, end)).select("event_id")


_REGISTRY = (("example.net", "Network registry"), ("example.org", "Public registry"), ("blog.ththan.example.net", "Ththan press office"), ("example", "never a host's end"))


@query(f"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, url, arg_max(authority, length(domain)) AS authority FROM h LEFT JOIN (VALUES {", ".join(str(x).replace('"', "'").replace("host's", "host''s") for x in _REGISTRY)}) g(domain, authority) ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1, 2""")
def primary_authority(spark: SparkSession, d: str) -> DataFrame:
    return r.authorities(c.table(spark, d, "pages"), spark.createDataFrame(list(_REGISTRY), "domain string, authority string"))


@query(r"SELECT page_id, url || '?x=1&api_key=***&y=2' AS url FROM pages")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    secret = F.concat(F.col("url"), F.lit("?x=1&api_key=k"), F.col("page_id").cast("string"), F.lit("&y=2"))
    return c.table(spark, d, "pages").select("page_id", text.redacted(secret).alias("url"))


def _token(x: str) -> str:
    words = f"list_filter(string_split(upper(regexp_replace({x}, '[^A-Za-z0-9 ]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({text.TOKEN_FILLER}, w))"
    return f"CASE WHEN len({words}) = 0 THEN 'UNK' WHEN length({words}[1]) >= 3 THEN substr({words}[1], 1, 6) ELSE substr(array_to_string({words}, ''), 1, 6) END"


@query(f"""SELECT p_partkey, 'DEAL-' || {_token('t')} || '-' || {_token('a')} || '-2026' AS deal_code FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name || ', Inc.' WHEN 1 THEN 'Co & Corp.' WHEN 2 THEN 'A B ' || p_name ELSE p_name END AS t, p_brand || ' Holdings' AS a FROM part)""")
def deal_codes(spark: SparkSession, d: str) -> DataFrame:
    target = F.expr("case p_partkey % 4 when 0 then concat('The ', p_name, ', Inc.') when 1 then 'Co & Corp.' when 2 then concat('A B ', p_name) else p_name end")
    return c.table(spark, d, "part").select("p_partkey", text.deal_code(target, F.concat("p_brand", F.lit(" Holdings")), F.lit("2026")).alias("deal_code"))


_STAMP_LENGTH = "case event_id % 5 when 0 then 4 when 1 then 7 when 2 then 10 when 3 then 16 else 19 end"


@query(f"""WITH s AS (SELECT event_id, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, {_STAMP_LENGTH}) AS value, event_id % 5 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'minute' ELSE 'second' END AS precision,
  CASE k WHEN 0 THEN CAST(value || '-01-01' AS TIMESTAMP) WHEN 1 THEN CAST(value || '-01' AS TIMESTAMP) ELSE CAST(value AS TIMESTAMP) END AS earliest,
  CASE k WHEN 0 THEN CAST(value || '-12-31 23:59:59' AS TIMESTAMP) WHEN 1 THEN CAST(last_day(CAST(value || '-01' AS DATE)) AS TIMESTAMP) + INTERVAL 86399 SECOND WHEN 2 THEN CAST(value || ' 23:59:59' AS TIMESTAMP) WHEN 3 THEN CAST(value || ':59' AS TIMESTAMP) ELSE CAST(value AS TIMESTAMP) END AS latest FROM s""")
def partial_stamps(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr(f"substr(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 1, {_STAMP_LENGTH})")
    rows = c.table(spark, d, "events").select("event_id", dates.stamp(value).alias("s"))
    return rows.select("event_id", "s.precision", "s.earliest", "s.latest")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'second' WHEN 1 THEN 'second' WHEN 2 THEN 'day' WHEN 3 THEN 'refused' END AS precision,
  CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('day', ts) + INTERVAL 86399999999 MICROSECOND END AS latest_utc FROM events""")
def time_points(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("""case event_id % 5 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 1 then date_format(ts, "yyyy-MM-dd HH:mm:ss'+02:00'") when 2 then date_format(ts, 'yyyy-MM-dd') when 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") else 'n/d' end""")
    return c.table(spark, d, "events").select("event_id", dates.time_point(value).alias("t")).select("event_id", "t.precision", "t.latest_utc")


@query(with_views("deals", """SELECT deal_id, round(ln(q / (1 - q)), 8) AS logit, CASE WHEN deal_value > 0 THEN round(ln(deal_value), 8) END AS log_value
FROM (SELECT *, least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, p_break)) AS q FROM deals WHERE p_break IS NOT NULL)"""))
def score_transforms(spark: SparkSession, d: str) -> DataFrame:
    rows = c.deals(spark, d).where("p_break is not null")
    return rows.select("deal_id", F.round(finance.logit(F.col("p_break")), 8).alias("logit"), F.round(finance.log_value(F.col("deal_value")), 8).alias("log_value"))


@query()
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of deals announced from 1998, calibrated on those that had been resolved by then; the fit has no SQL."""
    rows = c.deals(spark, d).withColumn("label", F.when(F.col("status") == "broken", 1).when(F.col("status") == "closed", 0))
    sample = rows.where("resolution_date < date'1998-01-01'")
    return r.calibrated(sample, rows.where("announce_date >= date'1998-01-01'")).select("deal_id", "p_break", "p_calibrated", "method")


_DUE = """p AS (SELECT s, sum(label) AS y, count(*) AS n FROM (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, (o_orderkey * 7919 % 2406 < date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::INT AS label FROM orders) GROUP BY s),
c AS (SELECT s, y, n, row_number() OVER (ORDER BY s) AS k, sum(y) OVER (ORDER BY s) AS cy, sum(n) OVER (ORDER BY s) AS cn FROM p)"""


@query(f"""WITH {_DUE},
pairs AS (SELECT a.k AS a, b.k AS b, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM c a JOIN c b ON b.k >= a.k),
low AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS mean FROM pairs),
fit AS (SELECT b AS k, max(mean) AS fit FROM low GROUP BY b)
SELECT s::DOUBLE AS s, n, fit FROM fit JOIN c USING (k)""")
def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    """The rate of a flag that rises with the day of an order, fitted over all orders; the SQL takes the greatest least mean of all stretches of days."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    rows = c.table(spark, d, "orders").select(day.alias("s"), (F.col("o_orderkey") * 7919 % 2406 < day).cast("int").alias("label"))
    days = rows.groupBy("s").agg(F.count("*").alias("n"))
    return isotonic.predicted(isotonic.fitted(rows, "s", "label"), days, "s", "fit")


_CHARTS = (("claim_type", "year"), ("source_type",), ("publisher", "stance"))


@query(with_views("evidence", "SELECT 1").removesuffix("\nSELECT 1") + ",\ne AS (SELECT *, year(valid_at) AS year FROM evidence)\n" + " UNION ALL ".join(
    f"SELECT '{' x '.join(x)}' AS chart, {' || chr(32) || chr(124) || chr(32) || '.join(f'CAST({k} AS VARCHAR)' for k in x)} AS bucket, count(*) AS n FROM e GROUP BY {', '.join(x)}" for x in _CHARTS))
def report_charts(spark: SparkSession, d: str) -> DataFrame:
    return r.report_charts(c.evidence(spark, d).withColumn("year", F.year("valid_at")), _CHARTS)


@query(with_views("evidence", "SELECT 1").removesuffix("\nSELECT 1") + """,
r AS (SELECT evidence_id, event_id, stance, publisher, revises, source_type || '/' || publisher || '/' || (evidence_id % 50) AS source_url, 'statement ' || (evidence_id % 700) AS statement FROM evidence),
m AS (SELECT a.*, count(*) OVER (PARTITION BY a.evidence_id) AS n_id, count(*) OVER (PARTITION BY a.event_id, source_url, a.stance, a.revises) AS n_key,
  min(a.event_id) OVER (PARTITION BY statement) <> max(a.event_id) OVER (PARTITION BY statement) AS two, t.event_id AS te, t.publisher AS tp FROM r a LEFT JOIN evidence t ON t.evidence_id = a.revises)
SELECT evidence_id, violations FROM (SELECT evidence_id, array_to_string(list_filter([CASE WHEN n_id > 1 THEN 'duplicate_id' END, CASE WHEN n_key > 1 THEN 'duplicate_evidence' END, CASE WHEN two THEN 'statement_in_two_clusters' END,
  CASE WHEN revises IS NOT NULL AND te IS NULL THEN 'unknown_revision_target' END, CASE WHEN te <> event_id THEN 'revision_of_other_cluster' END, CASE WHEN tp <> publisher THEN 'revision_of_other_publisher' END], lambda x: x IS NOT NULL), ';') AS violations FROM m) WHERE violations <> ''""")
def ledger_rules(spark: SparkSession, d: str) -> DataFrame:
    records = c.evidence(spark, d).selectExpr(
        "evidence_id", "event_id", "stance", "publisher", "revises", "concat(source_type, '/', publisher, '/', evidence_id % 50) as source_url", "concat('statement ', evidence_id % 700) as statement"
    )
    return r.ledger_violations(records)
