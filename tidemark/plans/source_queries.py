"""Readers and sinks over texts that are built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import HOLIDAYS_2026
from tidemark.functions import dates, text
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query
from tidemark.sources import formulas, readers, sinks


@query(with_views("prices", "SELECT series_id, obs_date, CASE WHEN day(obs_date) % 7 <> 0 THEN CAST(round(close * 100) AS BIGINT) / 100.0::DOUBLE END AS value FROM prices"))
def series_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Observations out of JSON payloads, one a series and month."""
    cents = F.round(F.col("close") * 100).cast("long")
    value = F.when(F.dayofmonth("obs_date") % 7 == 0, ".").otherwise(F.concat(F.expr("cast(cast(round(close * 100) as bigint) div 100 as string)"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
    rows = c.prices(spark, d).select("series_id", F.trunc("obs_date", "month").alias("month"), F.struct(F.col("obs_date").cast("string").alias("date"), value.alias("value"), F.lit("2026-01-01").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end")).alias("o"))
    payloads = rows.groupBy("series_id", "month").agg(F.to_json(F.struct(F.collect_list("o").alias("observations"))).alias("payload")).drop("month")
    return readers.observations_of(payloads).select("series_id", "obs_date", "value")


@query(f"""SELECT n_name AS series_id, v AS vintage, '{readers.SERIES_URL}?series_id=' || n_name || '&file_type=json&observation_start=' || CASE WHEN n_nationkey % 3 = 2 THEN '2026-06-01' ELSE '2026-04-20' END
  || CASE WHEN n_nationkey % 2 = 0 THEN '&observation_end=2026-07-01' ELSE '' END || CASE WHEN v = 'first_release' THEN '{readers.FIRST_RELEASE}' ELSE '' END AS url FROM (SELECT *, CASE WHEN n_nationkey % 4 = 0 THEN 'first_release' ELSE 'current' END AS v FROM nation)""")
def series_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "nation").selectExpr("n_name as series_id", "case n_nationkey % 3 when 1 then '2020-01-01' when 2 then '2026-06-01' end as start", "if(n_nationkey % 2 = 0, '2026-07-01', null) as end", "if(n_nationkey % 4 = 0, 'first_release', 'current') as vintage")
    return readers.series_requests(rows)


@query("""SELECT n_name AS series_id, DATE '2026-05-01' AS obs_date, CASE WHEN raw NOT IN ('.', '') THEN raw END AS value FROM nation LEFT JOIN (
  SELECT 'NATION_' || user_id AS s, arg_max(CASE event_id % 4 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE CAST(event_id AS VARCHAR) END, event_id) AS raw FROM events GROUP BY 1) ON s = n_name WHERE n_nationkey % 5 <> 0""")
def single_day_pull(spark: SparkSession, d: str) -> DataFrame:
    series = c.table(spark, d, "nation").selectExpr("n_name as series_id", "n_nationkey % 5 <> 0 as active")
    answers = c.table(spark, d, "events").selectExpr("concat('NATION_', user_id) as series_id", "case event_id % 4 when 0 then '.' when 1 then '' else cast(event_id as string) end as value", "event_id as seq")
    return readers.day_pull(series, F.lit("2026-05-01").cast("date"), answers)


_FORM = "CASE o_orderkey % 4 WHEN 0 THEN '8-K' WHEN 1 THEN '425' WHEN 2 THEN '15-12B' ELSE '8-K/A' END"
_ITEMS = "CASE o_orderkey % 3 WHEN 0 THEN '1.01, 9.01' WHEN 1 THEN '2.01' ELSE '' END"


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS cik, 'A' || o_orderkey AS accession, {_FORM} AS form, CAST(o_orderdate AS DATE) AS filing_date, replace({_ITEMS}, ', ', '|') AS items FROM orders")
def filings_reader(spark: SparkSession, d: str) -> DataFrame:
    """Recent filings and pages of older ones, as parallel arrays in JSON."""
    one = F.struct(F.concat(F.lit("A"), "o_orderkey").alias("accessionNumber"), F.expr(_FORM).alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.expr(_ITEMS).alias("items"))
    rows = c.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cik"), (F.col("o_orderstatus") == "F").alias("recent"), one.alias("f")).groupBy("cik", "recent").agg(F.collect_list("f").alias("f"))
    arrays = [F.col(f"f.{x}").alias(x) for x in ("accessionNumber", "form", "filingDate", "items")]
    payload = F.when(F.col("recent"), F.to_json(F.struct("cik", F.struct(F.struct(*arrays).alias("recent")).alias("filings")))).otherwise(F.to_json(F.struct("cik", *arrays)))
    return readers.filings_of(rows.select(payload.alias("payload"))).withColumn("items", F.array_join("items", "|"))


@query("SELECT 'U' || user_id AS symbol, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS session_date, value AS close FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND value > 0")
def chart_reader(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "events").selectExpr("concat('U', user_id) as symbol", "struct(unix_seconds(cast(ts as timestamp)) as t, case when event_id % 5 = 0 then null when event_id % 7 = 0 then -value else value end as v) as p").groupBy("symbol").agg(F.collect_list("p").alias("p"))
    return readers.chart_of(rows.select(F.to_json(F.struct("symbol", F.col("p.t").alias("timestamp"), F.col("p.v").alias("close")), {"ignoreNullFields": "false"}).alias("payload")))


_PRINTS = "SELECT deal_id, provider AS source, session_date, floor(close * 4) / 4.0::DOUBLE AS price, session_date + INTERVAL 16 HOUR AS known_at FROM provider_prints"


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return c.provider_prints(spark, d).selectExpr("deal_id", "provider as source", "session_date", "floor(close * 4) / 4.0D as price", "cast(session_date as timestamp_ntz) + interval 16 hours as known_at")


@query(with_views("provider_prints", f"SELECT deal_id, source, session_date, price, known_at FROM ({_PRINTS})"))
def price_manifest_reader(spark: SparkSession, d: str) -> DataFrame:
    """Written as a manifest and read back."""
    lines = sinks.manifest_lines(_prints(spark, d)).select(F.to_json(F.struct("deal_id", "source", "prints")).alias("payload"))
    return readers.price_manifest_of(lines).drop("line")


@query(with_views("provider_prints", f"""SELECT deal_id, source, count(*) AS n, sha256('[' || string_agg('{{"session_date":"' || strftime(session_date, '%Y-%m-%d') || '","price":' || CAST(price AS VARCHAR) || ',"known_at":"' || strftime(known_at, '%Y-%m-%dT%H:%M:%S.%f') || '"}}', ',' ORDER BY session_date, price) || ']') AS sha256
FROM ({_PRINTS}) GROUP BY 1, 2"""))
def price_manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest_lines(_prints(spark, d)).select("deal_id", "source", F.size("prints").cast("long").alias("n"), "sha256")


_REST = '","statement":"s","reporting_entity":"e","source_url":"u","first_observed_at":"2026-01-01","claim_type":"occurred","source_kind":"k","brief_date":"2026-01-02","publisher":"'
_FEED = f"""CASE doc_id % 5 WHEN 0 THEN '{{"category":"c' || doc_id || '{_REST}p"}}' WHEN 1 THEN '{{"category":"c' || doc_id || '{_REST} "}}' WHEN 2 THEN '{{oops' WHEN 3 THEN ' ' ELSE '{{"publisher":"p","category":"x"}}' END"""


@query(f"""SELECT doc_id, sha256(line) AS line_sha256, CASE WHEN k < 2 THEN 'c' || doc_id WHEN k = 4 THEN 'x' END AS category, CASE k WHEN 1 THEN 'missing:publisher' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'empty_line'
  WHEN 4 THEN 'missing:statement,reporting_entity,source_url,first_observed_at,claim_type,source_kind,brief_date' END AS reason FROM (SELECT doc_id, doc_id % 5 AS k, {_FEED} AS line FROM documents)""")
def brief_feed(spark: SparkSession, d: str) -> DataFrame:
    lines = c.table(spark, d, "documents").select("doc_id", F.expr(_FEED).alias("line"))
    return readers.brief_feed_of(lines).select("doc_id", "line_sha256", "category", "reason")


_BRIEF = """'{"url":"https://b.example/' || doc_id || '","published_at":"2026-0' || (doc_id % 9 + 1) || '-01T10:00:00","items":[{"statement":"s' || doc_id || '","claim_type":"rumor"},{"statement":"t","claim_type":"occurred"}]}'"""


@query("""SELECT 'https://b.example/' || doc_id || '#item-' || i AS source_url, 'ai_brief' AS source_type, false AS retrieved, CASE i WHEN 0 THEN 's' || doc_id ELSE 't' END AS statement, CASE i WHEN 0 THEN 'rumor' ELSE 'occurred' END AS claim_type,
  CAST('2026-0' || (doc_id % 9 + 1) || '-01 10:00:00' AS TIMESTAMP) AS known_at FROM documents, (SELECT unnest([0, 1]) AS i)""")
def brief_items(spark: SparkSession, d: str) -> DataFrame:
    return readers.brief_items_of(c.table(spark, d, "documents").select(F.expr(_BRIEF).alias("payload")))


_STORED = """'{"evidence_id":"' || CASE WHEN doc_id % 3 = 0 THEN 'X' ELSE upper(substr(sha1('e' || doc_id || '|u|supports|s|p|'), 1, 16)) END || '","event_id":"e' || doc_id || '","source_url":"u","stance":"supports","statement":"s","publisher":"p"}'"""


@query("SELECT 'e' || doc_id AS event_id, CASE WHEN doc_id % 3 = 0 THEN 'id_is_not_the_hash_of_its_content' END AS reason FROM documents")
def evidence_reader(spark: SparkSession, d: str) -> DataFrame:
    return readers.evidence_ledger_of(c.table(spark, d, "documents").select(F.expr(_STORED).alias("line"))).select("event_id", "reason")


@query("""SELECT s_suppkey, s_name || ', "Ltd"' AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier""")
def register_reader(spark: SparkSession, d: str) -> DataFrame:
    lines = c.table(spark, d, "supplier").selectExpr("s_suppkey", "concat('\"', s_name, ', \"\"Ltd\"\"\",', if(s_suppkey % 2 = 0, cast(s_nationkey as string), ' ')) as line")
    return readers.csv_rows_of(lines, ("name", "nation"))


@query("""WITH h AS (SELECT event_id % 3 AS query_no, 'A' || (event_id // 2) AS accession, user_id AS cik, CAST(ts AS DATE) AS filed, event_id % 7 = 0 AS other FROM events WHERE event_id % 7 <> 0),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY accession ORDER BY query_no, cik) = 1),
f AS (SELECT * FROM o WHERE accession NOT IN (SELECT 'A' || (p_partkey * 3) FROM part) AND cik NOT IN (SELECT p_partkey * 10 FROM part))
SELECT accession, cik, filed, row_number() OVER (ORDER BY filed, accession) AS rank FROM f""")
def candidate_queue(spark: SparkSession, d: str) -> DataFrame:
    hits = c.table(spark, d, "events").selectExpr("event_id % 3 as query_no", "concat('A', event_id div 2) as accession", "user_id as cik", "to_date(ts) as filed", "if(event_id % 7 = 0, array('8.01'), array('1.01', '9.01')) as items")
    known = c.table(spark, d, "part").selectExpr("concat('A', p_partkey * 3) as accession", "p_partkey * 10 as cik")
    return readers.candidate_queue(hits, known).select("accession", "cik", "filed", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT user_id AS deal_id, CAST(ts AS DATE) AS session_date, event_id AS line, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -value - 1 ELSE value + 1 END AS price, trim(coalesce(CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'T' WHEN 2 THEN ' ' WHEN 4 THEN '' END, '')) AS flag FROM events),
m AS (SELECT *, CASE WHEN price IS NULL THEN 'missing_price' WHEN price <= 0 THEN 'non_positive_price' WHEN flag NOT IN ('', 'T') THEN 'unusable_flag' END AS reason FROM r)
SELECT line, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY deal_id, session_date, reason IS NULL ORDER BY line) > 1 THEN 'duplicate_date' ELSE reason END AS reason FROM m""")
def provider_daily_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "events").selectExpr("user_id as deal_id", "to_date(ts) as session_date", "event_id as line", "case when event_id % 7 = 0 then null when event_id % 11 = 0 then -value - 1 else value + 1 end as price", "case event_id % 5 when 0 then 'A' when 1 then 'T' when 2 then ' ' when 4 then '' end as flag")
    got = readers.daily_rows(rows)
    return got.accepted.select("line", F.lit(None).cast("string").alias("reason")).unionByName(got.rejected.select("line", "reason"))


_EOD = """k AS (SELECT user_id AS deal_id, user_id % 8 AS k FROM events GROUP BY 1),
s AS (SELECT deal_id, CASE k WHEN 0 THEN 'SYMBOL_NOT_FOUND' WHEN 1 THEN 'TRANSIENT_FAILURE' WHEN 2 THEN 'IDENTITY_AMBIGUOUS' WHEN 3 THEN 'IDENTITY_AMBIGUOUS' WHEN 4 THEN 'NO_HISTORY' WHEN 5 THEN 'CREDENTIALS_REQUIRED' END AS status, CASE k WHEN 2 THEN 'issuer_name_disagrees' WHEN 3 THEN 'listing_does_not_cover_announcement' END AS problems, k FROM k),
cl AS (SELECT user_id AS deal_id, 'SYM' || user_id AS symbol, CAST(ts AS DATE) AS session_date, value AS close, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS adjusted_close, CAST(ts AS DATE) + INTERVAL 16 HOUR AS known_at FROM events
  WHERE user_id % 8 > 5 AND value > 0 AND event_id % 9 <> 0 AND isodow(ts) < 6 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')"""


def _eod(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00.000Z")).alias("date"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("close"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 2).otherwise(-1.0).alias("adjClose"))
    rows = c.table(spark, d, "events").groupBy(F.col("user_id").alias("deal_id")).agg(F.collect_list(one).alias("rows")).withColumn("k", F.col("deal_id") % 8)
    answers = rows.selectExpr(
        "deal_id", "concat('sym', deal_id) as symbol", "'Widget Makers Inc' as target_name", "date'2024-01-05' as announce_date", "date'2024-01-05' as start", "date'2024-01-25' as end", "k <> 5 as has_token", "case k when 0 then 404 when 1 then 429 else 200 end as meta_code",
        """concat('{"name":"', if(k = 2, 'Other Corp', 'WIDGET MAKERS'), '","startDate":"', if(k = 3, '2024-02-01', '2020-01-01'), '","endDate":null}') as meta""", "200 as prices_code", "if(k = 4, '[]', to_json(rows)) as prices",
    )
    sessions = sinks.calendar_rows(spark, "2024-01-01", "2024-12-31", {"2030-01-01": "none"})
    return readers.eod_history(answers, sessions)


@query(f"WITH {_EOD} SELECT deal_id, coalesce(status, CASE WHEN EXISTS (SELECT 1 FROM cl WHERE cl.deal_id = s.deal_id) THEN 'AVAILABLE' ELSE 'NO_HISTORY' END) AS status, coalesce(problems, '') AS problems FROM s")
def eod_status(spark: SparkSession, d: str) -> DataFrame:
    return _eod(spark, d)[0]


@query(f"WITH {_EOD} SELECT deal_id, symbol, session_date, close, adjusted_close, known_at FROM cl")
def eod_closes(spark: SparkSession, d: str) -> DataFrame:
    return _eod(spark, d)[1]


@query("""WITH s AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN 'wrds' WHEN 2 THEN 'flat_file' WHEN 3 THEN 'none' WHEN 4 THEN 'tape' END AS m, n_nationkey % 2 = 0 AS u, n_nationkey % 3 = 0 AS f FROM nation),
c AS (SELECT *, coalesce(m, CASE WHEN u THEN 'wrds' WHEN f THEN 'flat_file' ELSE 'none' END) AS mode FROM s), r AS (SELECT *, (mode = 'wrds' AND u) OR (mode = 'flat_file' AND f) AS available FROM c)
SELECT n_nationkey, mode, available, CASE WHEN available THEN NULL WHEN mode = 'none' THEN 'not_configured' WHEN mode = 'wrds' THEN 'no_user' WHEN mode = 'flat_file' THEN 'no_folder' ELSE 'unknown_mode' END AS reason FROM r""")
def provider_posture(spark: SparkSession, d: str) -> DataFrame:
    s = c.table(spark, d, "nation").selectExpr("n_nationkey", "case n_nationkey % 5 when 1 then ' WRDS' when 2 then 'flat_file' when 3 then 'none' when 4 then 'tape' end as m", "if(n_nationkey % 2 = 0, 'someone', ' ') as u", "if(n_nationkey % 3 = 0, '/data', null) as f")
    return s.select("n_nationkey", readers.access_posture(F.col("m"), F.col("u"), F.col("f"), F.col("f").isNotNull()).alias("p")).select("n_nationkey", "p.*")


_RAW = "CASE event_id % 6 WHEN 0 THEN '.' WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE CAST(event_id AS VARCHAR(20)) || '.25' END"


@query(f"SELECT event_id, event_type AS series_id, CAST(ts AS DATE) AS obs_date, CASE WHEN event_id % 6 > 2 THEN event_id + 0.25::DOUBLE END AS value, event_id % 6 <= 2 AS is_missing FROM events")
def silver_load(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts as typed rows; the tokens for missing values become null."""
    raw = c.table(spark, d, "events").select("event_id", F.col("event_type").alias("series_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr(_RAW).alias("raw"))
    value = text.missing_to_null(F.col("raw"))
    return raw.select("event_id", "series_id", F.to_date("day").alias("obs_date"), value.alias("value"), value.isNull().alias("is_missing"))


@query("""SELECT event_id, CASE WHEN k = 0 THEN CAST(ts AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE date_trunc('second', ts) END AS cutoff, CASE WHEN k = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN k = 1 THEN date_trunc('second', ts) END AS stored_at,
  CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) WHEN event_id % 4 = 1 THEN ts - INTERVAL 1 DAY ELSE ts END AS known_at, CASE WHEN event_id % 4 = 0 THEN 'explicit' WHEN event_id % 4 = 1 THEN 'source_timestamp' ELSE 'ingestion' END AS basis FROM (SELECT *, event_id % 3 AS k FROM events)""")
def time_conversions(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").selectExpr("event_id", "ts", "case event_id % 3 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") else date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end as t", "if(event_id % 4 = 0, date_trunc('second', ts), null) as own", "if(event_id % 4 = 1, ts - interval 1 day, null) as source")
    known, basis = dates.known_at(F.col("own").cast("timestamp_ntz"), F.col("source"), F.col("ts"))
    return e.select("event_id", dates.as_of(F.col("t")).alias("cutoff"), dates.stored(F.col("t")).alias("stored_at"), known.alias("known_at"), basis.alias("basis"))


_KEY = "user_id AS deal_id, CAST(ts AS DATE) AS session_date, event_type AS source, event_id"


@query(f"WITH a AS (SELECT {_KEY} FROM events WHERE event_id % 2 = 0), b AS (SELECT {_KEY} FROM events WHERE event_id % 2 = 1) SELECT event_id FROM b WHERE (deal_id, session_date, source) IN (SELECT (deal_id, session_date, source) FROM a) OR (deal_id, session_date, source) IN (SELECT (deal_id, session_date, source) FROM b GROUP BY deal_id, session_date, source HAVING count(*) > 1)")
def append_clashes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the odd half that the even half's store refuses."""
    rows = c.table(spark, d, "events").selectExpr("user_id as deal_id", "to_date(ts) as session_date", "event_type as source", "event_id")
    return sinks.clashes(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["deal_id", "session_date", "source"]).select("event_id")


@query("""SELECT event_id, nullif(array_to_string(list_filter([CASE WHEN v IS NULL THEN 'missing' END, CASE WHEN v <= 0 THEN 'not_positive' END, CASE WHEN isodow(ts) > 5 THEN 'not_a_session' END], lambda x: x IS NOT NULL), ';'), '') AS reason
FROM (SELECT event_id, ts, CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 9 = 0 THEN -value ELSE value + 1 END AS v FROM events)""")
def price_quarantine(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "events").selectExpr("event_id", "ts", "case when event_id % 8 = 0 then null when event_id % 9 = 0 then -value else value + 1 end as v")
    got = sinks.validated(rows, {"missing": F.col("v").isNull(), "not_positive": F.col("v") <= 0, "not_a_session": F.weekday("ts") >= 5})
    return got.accepted.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(got.rejected.select("event_id", "reason"))


@query("SELECT event_id, event_type AS ruleset, CASE WHEN event_type IN ('view', 'click') THEN 'new' ELSE 'old' END AS run FROM events WHERE event_type NOT IN ('view', 'click') OR event_id % 2 = 0")
def ruleset_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "events").selectExpr("event_id", "event_type as ruleset")
    new = rows.where("ruleset in ('view', 'click') and event_id % 2 = 0").withColumn("run", F.lit("new"))
    return sinks.replaced_rulesets(rows.withColumn("run", F.lit("old")), new)


_SEEDS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in sinks.SEED_DEALS)


@query(f"SELECT deal_id, acquirer, CAST(announce_date AS DATE) AS announce_date, status, CAST(p_break AS DOUBLE) AS p_break FROM (VALUES {_SEEDS}) t({', '.join(x.split()[0] for x in sinks.SEED_COLUMNS.split(', '))}) UNION ALL SELECT 'D' || n_nationkey, n_name, DATE '2026-01-01', 'pending', 0.5::DOUBLE FROM nation")
def seed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The seeds over a ledger that has an older row of one of them."""
    old = c.table(spark, d, "nation").selectExpr("concat('D', n_nationkey) as deal_id", "date'2026-01-01' as announce_date", "n_name as acquirer", "n_name as target", "cast(null as string) as sponsor", "1.0D as value_usd_mm", "'x' as sector", "'y' as geography", "'z' as deal_type", "cast(null as date) as resolution_date", "'pending' as status", "0.5D as p_break")
    stale = old.limit(1).withColumn("deal_id", F.lit("EA-PIF-2026"))
    return sinks.seeded(old.unionByName(stale), spark).select("deal_id", "acquirer", "announce_date", "status", "p_break")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 0 AS is_derived, CAST(NULL AS DOUBLE) AS offer_price FROM nation")
def schema_migration(spark: SparkSession, d: str) -> DataFrame:
    old = c.table(spark, d, "nation").withColumn("stub", F.lit(None).cast("string"))
    return sinks.migrated(old, "n_nationkey int, n_name string, n_regionkey bigint, is_derived int, offer_price double", {"is_derived": 0})


_TEXT = "CASE p_partkey % 3 WHEN 0 THEN p_name || ', \"big\"' WHEN 1 THEN p_name ELSE NULL END"


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) || ',' || CASE p_partkey % 3 WHEN 0 THEN '\"' || p_name || ', \"\"big\"\"\"' WHEN 1 THEN p_name ELSE '' END || ',' || p_brand AS line FROM part")
def canonical_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "part").select("p_partkey", F.expr(_TEXT).alias("note"), "p_brand")
    return rows.select("p_partkey", sinks.csv_line(["p_partkey", "note", "p_brand"]).alias("line"))


@query(f"""WITH h(day, name) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in HOLIDAYS_2026.items())}), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2026-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY)) AS DATE) AS obs_date),
r AS (SELECT obs_date, CASE WHEN isodow(obs_date) > 5 THEN 'weekend' ELSE name END AS reason FROM d LEFT JOIN h ON CAST(day AS DATE) = obs_date), s AS (SELECT DISTINCT CAST(o_orderdate + INTERVAL 25 YEAR AS DATE) AS obs_date FROM orders)
SELECT obs_date, reason IS NULL AS is_trading, reason FROM r UNION ALL SELECT obs_date, true, NULL FROM s WHERE year(obs_date) <> 2026""")
def calendar_2026(spark: SparkSession, d: str) -> DataFrame:
    """A stored calendar of the days with orders, 25 years on, whose year 2026 an upsert replaces."""
    days = c.table(spark, d, "orders").select(F.to_date(F.add_months("o_orderdate", 300)).alias("obs_date")).distinct()
    store = days.select("obs_date", F.lit(True).alias("is_trading"), F.lit(None).cast("string").alias("reason"))
    return sinks.upserted_calendar(store, sinks.calendar_rows(spark, "2026-01-01", "2026-12-31", HOLIDAYS_2026))


@query("""SELECT event_id, k IN (0, 1) AS has_cfius, CASE k WHEN 1 THEN 'false' END AS cfius, CASE k WHEN 1 THEN 'cfius,hsr' WHEN 0 THEN 'cfius' WHEN 2 THEN '' ELSE '' END AS unknown, '{"a":' || event_id || CASE WHEN k = 0 THEN '' ELSE ',"b":"' || event_type || '"' END || '}' AS encoded FROM (SELECT *, event_id % 4 AS k FROM events)""")
def json_attributes(spark: SparkSession, d: str) -> DataFrame:
    """A key is there whatever its value; keys that nobody knows are named; keys are written in order."""
    e = c.table(spark, d, "events").selectExpr("event_id", "event_type", "event_id % 4 as n", """case event_id % 4 when 0 then '{"cfius": null}' when 1 then '{"hsr": true, "cfius": false}' when 2 then '{}' else props end as j""")
    there, value = readers.attribute(F.col("j"), "cfius")
    encoded = readers.sorted_json({"b": F.when(F.col("n") != 0, F.col("event_type")), "a": F.col("event_id")})
    return e.select("event_id", there.alias("has_cfius"), value.alias("cfius"), readers.unknown_fields(F.col("j"), ("k",)).alias("unknown"), encoded.alias("encoded"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN -(event_id + 0.5::DOUBLE) WHEN 2 THEN 1000.0::DOUBLE END AS value FROM events")
def exact_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = c.table(spark, d, "events").selectExpr("event_id", "case event_id % 7 when 0 then cast(event_id as string) when 1 then concat('-', event_id, '.5') when 2 then '1e3' when 3 then ' 5' when 4 then 'NaN' when 5 then '1,000' end as t")
    return e.select("event_id", readers.exact_number(F.col("t")).alias("value"))


@query("SELECT 'D' || doc_id AS deal_id, 'T' || doc_id AS target, 'A' AS acquirer, '2026-01-01' AS announcement_timestamp, CASE WHEN doc_id % 2 = 0 THEN '2026-05-01' END AS resolution_timestamp, CASE WHEN doc_id % 2 = 0 THEN 'closed' END AS resolution_type FROM documents")
def deal_universe(spark: SparkSession, d: str) -> DataFrame:
    one = F.expr("""struct(concat('D', doc_id) as deal_id, concat('T', doc_id) as target, 'A' as acquirer, '2026-01-01' as announcement_timestamp, if(doc_id % 2 = 0, '2026-05-01', null) as resolution_timestamp, if(doc_id % 2 = 0, 'closed', null) as resolution_type)""")
    files = c.table(spark, d, "documents").groupBy((F.col("doc_id") % 7).alias("file")).agg(F.to_json(F.struct(F.collect_list(one).alias("deals"))).alias("payload"))
    return readers.universe_of(files.select("payload"))


@query("SELECT doc_id, 'E' || doc_id AS event_id, CASE WHEN doc_id % 3 = 0 THEN 'score' ELSE '' END AS unknown_fields FROM documents WHERE doc_id % 4 <> 3")
def exposure_link_reader(spark: SparkSession, d: str) -> DataFrame:
    lines = c.table(spark, d, "documents").selectExpr("doc_id", """if(doc_id % 4 = 3, ' ', concat('{"event_id":"E', doc_id, '","deal_id":"D"', if(doc_id % 3 = 0, ',"score":1', ''), '}')) as line""")
    return readers.exposure_links_of(lines).select("doc_id", "event_id", "unknown_fields")


_LOG = """log AS (SELECT o_custkey AS k, 2 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey % 97 = 5 AS bad, CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice) END AS price FROM orders),
m AS (SELECT *, avg(price) OVER (PARTITION BY k ORDER BY r ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean, lag(price) OVER (PARTITION BY k ORDER BY r) AS before, CASE WHEN price IS NOT NULL THEN count(price) OVER (PARTITION BY k ORDER BY r) END AS nth FROM log)"""


@query(f"""WITH {_LOG}
SELECT 'w' || k AS file, r AS "row", 2 AS col, round(mean, 4) AS expected, CASE WHEN mean IS NULL THEN 'n/d' END AS expected_text, CASE WHEN bad THEN 'wrong' ELSE 'ok' END AS status FROM m
UNION ALL SELECT 'w' || k, r, 3, round(price / before - 1, 4), CASE WHEN price IS NULL OR before IS NULL THEN 'n/d' END, 'computed' FROM m
UNION ALL SELECT 'w' || k, r, 4, round(CASE WHEN price IS NULL THEN 0 ELSE abs(price - mean) * nth / 2 END, 4), NULL, 'computed' FROM m""")
def formula_gate(spark: SparkSession, d: str) -> DataFrame:
    """Logs with a moving mean (stored, some wrong), a change and a cell that reads another formula and a growing range (both not stored)."""
    w = Window.partitionBy("k").orderBy("o_orderkey")
    log = c.table(spark, d, "orders").withColumn("k", F.col("o_custkey")).withColumn("row", (F.row_number().over(w) + 2).cast("int")).withColumn("price", F.when(F.col("o_orderkey") % 6 != 0, F.round("o_totalprice")))
    mean = F.avg("price").over(w.rowsBetween(-4, 0))
    shown = F.when(F.col("o_orderkey") % 97 == 5, F.coalesce(mean, F.lit(0.0)) + 1).otherwise(mean)
    log = log.withColumn("shown", shown)
    first = F.greatest(F.col("row") - 4, F.lit(3))
    window = F.concat(F.lit("A"), first, F.lit(":$A"), F.col("row"))
    cell = lambda col, number, text, formula: F.struct(F.lit(col).alias("col"), text.alias("text"), number.alias("number"), formula.alias("formula"))
    none = F.lit(None)
    texts = lambda x: F.coalesce(x.cast("string"), F.lit("n/d"))
    cells = F.array(
        cell(1, F.col("price"), texts(F.col("price")), none.cast("string")),
        cell(2, F.col("shown"), texts(F.col("shown")), F.concat(F.lit("=IF(COUNT("), window, F.lit(")>0,AVERAGE("), window, F.lit('),"n/d")'))),
        cell(3, none.cast("double"), none.cast("string"), F.expr("""concat('IF(AND(ISNUMBER(A', row, '),ISNUMBER(A', row - 1, ')),A', row, '/A', row - 1, '-1,"n/d")')""")),
        cell(4, none.cast("double"), none.cast("string"), F.expr("concat('IF(ISNUMBER(A', row, '),E', row, '*COUNT(A3:A', row, ')*50%,0)')")),
        cell(5, none.cast("double"), none.cast("string"), F.concat(F.lit("IF(ISNUMBER(A"), F.col("row"), F.lit("),ABS(A"), F.col("row"), F.lit("-AVERAGE("), window, F.lit(")),0)"))),
    )
    sheets = log.select(F.concat(F.lit("w"), "k").alias("file"), F.lit("Log").alias("sheet"), "row", F.explode(cells).alias("c")).select("file", "sheet", "row", "c.*")
    return formulas.gate(sheets).where("col < 5").select("file", "row", "col", F.round("expected", 4).alias("expected"), "expected_text", "status")
