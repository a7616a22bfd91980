"""Registers, filings, candidates, identities and contracts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import extract, listing
from tidemark.operators import contracts, identity, intake
from tidemark.plans import carriers as c
from tidemark.plans.carriers import with_views
from tidemark.plans.registry import query

_X, _Y, _R = "(o_orderkey % 90 + 10)", "(o_orderkey % 90 + 11)", "(o_orderkey % 90 + 10)"


def _body(concat) -> str:
    """The text of an announcement by the order's key, in the SQL of either engine."""
    cash = lambda n: ("'$'", n, "'.50 per share in cash. '")
    return f"""CASE o_orderkey % 8 WHEN 0 THEN {concat("'T Inc to be acquired by Acme Holdings Inc for $'", _X, "'.50 per share in cash.'")}
  WHEN 1 THEN {concat(*cash(_X), *cash(_Y), "'The board approved '", *cash(_X))} WHEN 2 THEN {concat(*cash(_X), *cash(_Y))}
  WHEN 3 THEN {concat("'$'", _X, "'.50 per share in cash and 0.'", _R, "' shares of Acme common stock for each share. An exchange ratio of 0.'", _R, "' applies.'")}
  WHEN 4 THEN {concat("'Each share converts at an exchange ratio of 0.'", _R, "'.'")} WHEN 5 THEN {concat("'A contingent value right comes with '", *cash(_X))}
  WHEN 6 THEN '$1.50 per share in cash. $2.50 per share in cash. $3.50 per share in cash. $4.50 per share in cash. $5.50 per share in cash.' ELSE 'Nothing is said.' END"""


def _spark_concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


@query(f"""SELECT o_orderkey, CASE WHEN k IN (0, 1, 2) THEN 'cash' WHEN k = 3 THEN 'mixed' WHEN k = 4 THEN 'stock' END AS consideration_type, CASE WHEN k IN (0, 1, 3) THEN {_X} + 0.5::DOUBLE WHEN k = 2 THEN {_Y} + 0.5::DOUBLE END AS offer_price,
  CASE WHEN k IN (3, 4) THEN {_R} / 100.0::DOUBLE END AS exchange_ratio, CASE WHEN k = 0 THEN 'Acme Holdings Inc' END AS acquirer, CASE k WHEN 5 THEN 'unsupported_mechanics' WHEN 6 THEN 'too_many_cash_prices' WHEN 7 THEN 'not_mapped' END AS reason FROM (SELECT *, o_orderkey % 8 AS k FROM orders)""")
def deal_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms out of announcements that name prices once, several times, or not at all."""
    body = c.spread(c.table(spark, d, "orders").select("o_orderkey")).select("o_orderkey", F.expr(_body(_spark_concat)).alias("body"))
    return body.select("o_orderkey", extract.deal_terms(F.col("body")).alias("f")).select("o_orderkey", extract.decided_terms(F.col("f")).alias("t")).select("o_orderkey", "t.*")


#: Announcements in the middle of documents: prices, buyers of all kinds, parties and roles of agreements.
_NAMES = "['Acme Holdings Inc', 'General Mills, Inc.', 'an affiliate of Vector Capital', 'MaxLinear', 'Imerys SA', 'Foo & Bar Partners LP', 'Parent', 'funds advised by Apax Partners', 'Investor Group led by Permira', 'Lindsay Corp.']"
_SAYS = """['Target Inc is to be acquired by {n} for ${x} per share in cash.', 'It will be acquired by {n} (the buyer), in an all-cash transaction at ${x} per share.', '{n} (NYSE: ABC) has agreed to acquire Target Inc for ${x} in cash per share.', 'Under it {n} would acquire Target. Each share gets 0.{y} shares of {n} common stock for each share.',
  'The Agreement and Plan of Merger, dated today, by and among {n}, Merger Sub and the Company sets an exchange ratio of 0.{y}.', 'An affiliate of {n} pursuant to which holders get ${x} per share. Cash consideration of ${x} per share is due.', 'Parent "{n}" pays merger consideration of ${x} per share; holders may elect to receive stock.', '{n} ("Parent") and KKR said on Monday that ${x} per share is fair.', 'The pending acquisition of Target by {n}, is void. It ran at an exchange ratio of 0.{y} and ${x} per share in cash.', 'Nothing is said.']"""


def _announced_sql() -> str:
    """doc_id and a text: the document's, cut in two halves by an announcement; documents without text have only that."""
    put = "replace(replace(replace(says[(doc_id % 10) + 1], '{n}', names[(doc_id // 10 % 10) + 1]), '{x}', (doc_id % 90 + 10)::VARCHAR || '.25'), '{y}', (doc_id % 80 + 10)::VARCHAR)"
    return f"SELECT doc_id, coalesce(text[1:length(text) // 2], '') || '. ' || {put} || ' ' || coalesce(text[length(text) // 2 + 1:], '') AS t FROM (SELECT doc_id, text, {_NAMES} AS names, {_SAYS} AS says FROM documents)"


def _announced(spark: SparkSession, d: str) -> DataFrame:
    arrays = [F.from_json(F.lit(x.replace("'", "\x00").replace('"', '\\"').replace("\x00", '"')), "array<string>") for x in (_NAMES, _SAYS.replace("\n", ""))]
    docs = c.spread(c.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), arrays[0].alias("names"), arrays[1].alias("says"))
    put = "replace(replace(replace(says[int(doc_id % 10)], '{n}', names[int(doc_id div 10 % 10)]), '{x}', concat(doc_id % 90 + 10, '.25')), '{y}', string(doc_id % 80 + 10))"
    return docs.selectExpr("doc_id", f"concat(substring(text, 1, int(length(text) div 2)), '. ', {put}, ' ', substring(text, int(length(text) div 2) + 1)) as t")


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _tidy(x: str, around: str = " ,.;") -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), '{around}')"


def _clean_sql(x: str) -> str:
    """The cleaning of a buyer's name; '' if none is left."""
    name = _tidy(x)
    for pattern, put in extract.NAME_RESIDUE:
        name = _tidy(f"regexp_replace({name}, {_text(pattern)}, '{put}')" if put != " " else f"regexp_replace({name}, {_text(pattern)}, ' ', 'g')")
    roles = ", ".join(f"'{r}'" for r in extract.ROLES)
    return f"list_transform([{name}], lambda z: CASE WHEN length(z) BETWEEN 3 AND 80 AND lower(z) NOT IN ({roles}) THEN trim(regexp_replace(z, '(?i)\\s+AFFILIATE\\s*$', ''), ' ') ELSE '' END)[1]"


#: A word without which a pattern can't match; the other engine is slow where there is nothing to find.
_NEEDS = {
    **dict(zip(extract.TARGET_SIDE_CASH, ("acquired", "acquired", "affiliate", "$"))), **dict(zip(extract.ACQUIRER_PATTERNS, ("will acquire", "will be acquired", "acqui", "would acquire", "acquire"))), extract.ACQUIRED_BY: "acquired",
    **dict(zip(extract.CASH_PATTERNS, ("$", "$", "transaction", "acquire", "consideration", "consideration", "consideration", "$"))), **dict(zip(extract.RATIO_PATTERNS, ("ratio", "for each", "of a share"))),
    extract.ACQUIRES: "acquire", extract.AMONG: "among", extract.QUOTED_ROLE: "r", extract.ROLE_BEHIND: "(", extract.PENDING: "p",
}


def _first(t: str, pattern: str, group: int = 1) -> str:
    return f"CASE WHEN contains(lower({t}), '{_NEEDS[pattern]}') THEN regexp_extract({t}, {_text(pattern)}, {group}) ELSE '' END"


def _all(t: str, pattern: str) -> str:
    return f"CASE WHEN contains(lower({t}), '{_NEEDS[pattern]}') THEN regexp_extract_all({t}, {_text(pattern)}, 1) ELSE [] END"


def _terms_sql(texts: str) -> str:
    """The terms of ``texts`` (doc_id, t) by the patterns on another engine."""
    raw = ", ".join(f"[{_first('h', p, 1)}, {_first('h', p, 2)}]" for p in extract.TARGET_SIDE_CASH)
    sides = f"list_transform(sides, lambda s: {{'name': {_clean_sql('s[1]')}, 'price': TRY_CAST(s[2] AS DOUBLE)}})"
    numbers = lambda patterns: f"list_transform(flatten([{', '.join(_all('h', p) for p in patterns)}]), lambda v: v::DOUBLE)"
    named = ", ".join(_tidy(_first("h", p), " ,.") for p in extract.ACQUIRER_PATTERNS)
    most = lambda x, way: f"(SELECT v FROM (SELECT unnest({x}) AS v) GROUP BY v ORDER BY count(*) DESC, v {way} LIMIT 1)"
    return f"""WITH a AS ({texts}), l AS (SELECT doc_id, t[1:{extract.HEAD}] AS h FROM a), h AS MATERIALIZED (SELECT *, list_filter([{raw}], lambda s: s[1] <> '') AS sides, {_first('h', extract.ACQUIRED_BY)} AS bought FROM l),
    f AS (SELECT doc_id, list_filter({sides}, lambda s: s.name <> '' AND s.price BETWEEN 0.5 AND 5000)[1] AS direct, list_filter({numbers(extract.CASH_PATTERNS)}, lambda v: v BETWEEN 0.5 AND 5000) AS cash, list_filter({numbers(extract.RATIO_PATTERNS)}, lambda v: v > 0 AND v < 50) AS ratio,
      coalesce(list_filter([{named}], lambda n: length(n) BETWEEN 3 AND 80 AND NOT contains(lower(n), 'stockholder'))[1], nullif({_clean_sql('bought')}, '')) AS acquirer, regexp_matches(h, {_text(extract.MECHANICS)}) AS unsupported,
      regexp_matches(h, {_text(extract.CASH_WORDS)}) AS cash_words, regexp_matches(h, '(?i)\\bcash\\b') AS names_cash, regexp_matches(h, {_text(extract.STOCK_WORDS)}) AS stock FROM h),
    g AS (SELECT *, cash_words OR (len(cash) > 0 AND names_cash) AS says_cash, len(list_distinct(cash)) AS nc, len(list_distinct(ratio)) AS nr, {most('cash', 'DESC')} AS price, {most('ratio', 'ASC')} AS rate FROM f),
    r AS (SELECT *, CASE WHEN unsupported THEN 'unsupported_mechanics' WHEN direct IS NOT NULL THEN NULL WHEN nc > 0 AND nr > 0 AND says_cash AND stock THEN CASE WHEN nc > 3 OR nr > 3 THEN 'ambiguous_mixed_terms' END WHEN nc > 0 AND says_cash AND NOT stock THEN CASE WHEN nc > 4 THEN 'too_many_cash_prices' END
      WHEN nr > 0 AND NOT says_cash AND (stock OR nc = 0) THEN CASE WHEN nc > 0 THEN 'ambiguous_cash_and_ratio' WHEN nr > 3 THEN 'ambiguous_ratios' END ELSE 'not_mapped' END AS reason FROM g),
    k AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN direct IS NOT NULL THEN 'cash' WHEN nc > 0 AND nr > 0 AND says_cash AND stock THEN 'mixed' WHEN nc > 0 AND says_cash AND NOT stock THEN 'cash' ELSE 'stock' END END AS kind FROM r)
    SELECT doc_id, kind AS consideration_type, CASE WHEN direct IS NOT NULL AND kind IS NOT NULL THEN direct.price WHEN kind IN ('cash', 'mixed') THEN price END AS offer_price, CASE kind WHEN 'mixed' THEN rate WHEN 'stock' THEN list_min(ratio) END AS exchange_ratio,
      CASE WHEN NOT unsupported THEN CASE WHEN direct IS NOT NULL THEN direct.name ELSE acquirer END END AS acquirer, reason FROM k"""


@query(_terms_sql(_announced_sql()))
def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms out of whole documents, some of which go beyond the head that is looked at."""
    found = _announced(spark, d).select("doc_id", extract.deal_terms(F.col("t")).alias("f")).select("doc_id", extract.decided_terms(F.col("f")).alias("t"))
    return found.select("doc_id", "t.*")


def _buyers_sql(texts: str) -> str:
    firsts = ", ".join(_first("h", p) for p in (*extract.TARGET_SIDE_CASH, extract.ACQUIRED_BY, *extract.ACQUIRER_PATTERNS))
    shells = lambda xs: ", ".join(f"'{x}'" for x in xs)
    starts = " AND ".join(f"NOT starts_with(lower(trim(n)), '{x}')" for x in extract.SHELL_STARTS)
    acquires = f"list_filter({_all('h', extract.ACQUIRES)}, lambda n: lower(trim(n)) NOT IN ({shells(extract.SHELLS)}) AND {starts} AND NOT regexp_matches(n, {_text(extract.INTENT)}))"
    among = f"list_filter({_all('p', extract.AMONG)}, lambda n: lower(trim(n)) NOT IN ({shells(extract.AMONG_SHELLS)}))"
    every = f"flatten([[{firsts}], {acquires}, {among}, {_all('p', extract.QUOTED_ROLE)}, {_all('p', extract.ROLE_BEHIND)}, {_all('h', extract.PENDING)}])"
    return f"""WITH a AS ({texts}), h AS (SELECT doc_id, t[1:{extract.BUYER_HEAD}] AS h, t[1:{extract.PARTY_HEAD}] AS p FROM a), e AS MATERIALIZED (SELECT doc_id, {every} AS every FROM h), n AS (SELECT doc_id, unnest(every) AS raw, generate_subscripts(every, 1) AS i FROM e WHERE len(every) > 0),
    k AS (SELECT doc_id, i, {_clean_sql('raw')} AS name FROM n WHERE raw <> ''), o AS (SELECT doc_id, name, min(i) AS i FROM k WHERE name <> '' GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, name FROM o"""


@query(_buyers_sql(_announced_sql()))
def buyer_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All buyers that documents name, in order of preference."""
    found = _announced(spark, d).select("doc_id", extract.buyer_candidates(F.col("t")).alias("names"))
    return found.select("doc_id", F.posexplode("names").alias("place", "name")).withColumn("place", (F.col("place") + 1).cast("long"))


_T = "'T' || chr(CAST(65 + c_custkey % 26 AS INTEGER))"
_RAW = """case c_custkey % 5 when 0 then concat('<TICKER> ', t, ' <EXCHANGE>NYSE <p>body</p>') when 1 then concat('x <ix:nonNumeric name="dei:TradingSymbol" id="a">', t, '</ix:nonNumeric> y') when 2 then concat('<p>Title Trading Symbol</p> ', t, ' NYSE')
  when 3 then concat('<p>Buyer Corp (NYSE: BUY) acquires Widget Makers Inc (NASDAQ: ', t, ') today</p>') else '<p>nothing</p>' end"""


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    rows = c.spread(c.table(spark, d, "customer").select("c_custkey")).selectExpr("c_custkey", "concat('T', chr(65 + c_custkey % 26)) as t").select("c_custkey", F.expr(_RAW).alias("raw"))
    found = listing.filing_identity(F.col("raw"), F.lit("Widget Makers Inc"), F.col("c_custkey") % 5 != 3)
    return rows.select("c_custkey", found.alias("x")).select("c_custkey", "x.*")


_TICKERS = f"""SELECT c_custkey, CASE WHEN k < 4 THEN {_T} END AS historical_ticker, CASE k WHEN 0 THEN 'NYSE' WHEN 2 THEN 'NYSE' WHEN 3 THEN 'NYSE' END AS exchange,
  CASE k WHEN 0 THEN 'SEC_HEADER_TICKER' WHEN 1 THEN 'dei:TradingSymbol' WHEN 2 THEN '8-K_cover_trading_symbol' WHEN 3 THEN 'parenthetical_ticker_adjacent_to_target_name' END AS evidence_location FROM (SELECT *, c_custkey % 5 AS k FROM customer)"""


@query(_TICKERS)
def ticker_extraction(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("c_custkey", "historical_ticker", "exchange", "evidence_location")


@query(f"SELECT c_custkey, CASE WHEN historical_ticker IS NULL THEN 'NO_SUFFICIENT_EVIDENCE' ELSE 'RESOLVED_PROOF_C' END AS status, CASE WHEN c_custkey % 2 = 0 THEN historical_ticker END AS mapped, c_custkey % 3 = 0 AS form_can_prove FROM ({_TICKERS})")
def filing_review(spark: SparkSession, d: str) -> DataFrame:
    rows = _extracted(spark, d).withColumns({"sec_accession": F.when(F.col("c_custkey") % 2 == 0, "0000000001-26-000001"), "filed": F.lit("2026-01-02").cast("date"), "form": F.when(F.col("c_custkey") % 3 == 0, "8-K").otherwise("10-K")})
    return identity.filing_review(rows).select("c_custkey", "status", F.col("map_row.ticker").alias("mapped"), "form_can_prove")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 16 HOUR AS closes_at, CASE WHEN k = 0 THEN 'issuer_name_disagrees' ELSE '' END || CASE WHEN k = 0 AND s THEN ';' ELSE '' END || CASE WHEN s THEN 'listing_does_not_cover_announcement' ELSE '' END AS problems,
  CASE WHEN k = 0 THEN 'issuer_name_disagrees' ELSE '' END || CASE WHEN k = 0 AND f THEN ';' ELSE '' END || CASE WHEN f THEN 'first_trade_does_not_cover_announcement' ELSE '' END AS chart_problems
FROM (SELECT *, o_orderkey % 3 AS k, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS s, o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 AS f FROM orders)""")
def listing_checks(spark: SparkSession, d: str) -> DataFrame:
    """Start unknown, after the announcement, or the end before it; the chart's first trade unknown (0) or later."""
    o = c.table(spark, d, "orders").selectExpr("o_orderkey", "to_date(o_orderdate) as a", "if(o_orderkey % 3 = 0, 'Other Corp', 'THE WIDGET MAKERS') as long", "case when o_orderkey % 4 = 0 then null when o_orderkey % 5 = 0 then date_add(to_date(o_orderdate), 1) else date'1990-01-01' end as s", "if(o_orderkey % 7 = 0, date_sub(to_date(o_orderdate), 1), null) as e",
        "case when o_orderkey % 4 = 0 then 0L when o_orderkey % 6 = 0 then unix_seconds(timestamp'2030-01-01 00:00:00') else 1L end as first")
    name, target = listing.issuer_name(F.lit(""), F.col("long")), F.lit("Widget Makers Inc")
    return o.select("o_orderkey", listing.session_close(F.col("a")).alias("closes_at"), F.array_join(listing.listing_problems(name, target, F.col("s"), F.col("e"), F.col("a")), ";").alias("problems"), F.array_join(listing.chart_problems(name, target, F.col("first"), F.col("a")), ";").alias("chart_problems"))


_REGISTER = """case o_orderkey % 5 when 0 then 'Merger proposal' when 1 then 'Talks' else 'Merger' end as deal_type, case o_orderkey % 8 when 0 then 'announced' when 1 then 'closed' when 2 then 'terminated by both' when 3 then 'holder vote' when 4 then 'go-shop expired' when 5 then 'announced+closed' when 6 then 'who knows' else 'pending' end as window_event,
 case when o_orderkey % 11 = 0 then '' else '2026-05-20' end as window_event_date, case o_orderkey % 3 when 0 then 'reported_only' when 1 then 'sec_metadata_confirmed' else 'press' end as verification, case o_orderkey % 4 when 0 then 'closed' when 1 then 'planned for 2027' when 2 then 'likely closed' else 'pending' end as status,
 case when o_orderkey % 2 = 0 then 'https://a.example/1; https://b.example/2' else 'https://a.example/1' end as sources, case when o_orderkey % 13 = 0 then '' else '2026-04-20' end as announce_date, case when o_orderkey % 6 = 0 then '' else '2026-06-30' end as resolution_date,
 case when o_orderkey % 7 = 0 then 'A1' else '' end as sec_announce_accession, case when o_orderkey % 14 = 0 then '2026-04-18T10:00:00' else '2026-04-21T10:00:00' end as announce_known_at, case when o_orderkey % 9 = 0 then 'A2' else '' end as sec_resolution_accession, '2026-07-01T09:30:00' as resolution_accepted"""
_EVENTS = f"""r AS (SELECT o_orderkey AS deal_id, {_REGISTER} FROM orders),
k AS (SELECT *, CASE WHEN deal_type IN ('Merger proposal', 'Talks') THEN 'proposal' WHEN verification = 'reported_only' OR status LIKE 'planned%' THEN 'unverified' ELSE 'signed_definitive' END AS kind,
  CASE WHEN verification = 'reported_only' THEN verification WHEN deal_id % 2 = 0 THEN 'press_multi' ELSE 'press_single' END AS press, CASE WHEN announce_date <> '' THEN announce_date WHEN window_event LIKE 'announced%' AND window_event_date <> '' THEN window_event_date END AS opened,
  sec_announce_accession <> '' AS disclosed, CASE deal_id % 8 WHEN 1 THEN 'closing' WHEN 2 THEN 'termination' WHEN 3 THEN 'shareholder_vote' WHEN 4 THEN 'go_shop_expired' WHEN 5 THEN 'closing' WHEN 6 THEN 'unmapped' ELSE CASE WHEN resolution_date <> '' AND status = 'closed' THEN 'closing' END END AS event FROM r),
w AS (SELECT *, opened || 'T00:00:00' > announce_known_at AND disclosed AS capped, CASE WHEN event IN ('closing', 'termination') THEN nullif(resolution_date, '') ELSE nullif(window_event_date, '') END AS on_day, event IN ('closing', 'termination') AND sec_resolution_accession <> '' AS accepted FROM k),
e AS (SELECT deal_id, kind, CASE WHEN kind = 'proposal' THEN CASE deal_type WHEN 'Talks' THEN 'talks_reported' ELSE 'proposal_submitted' END WHEN kind = 'signed_definitive' THEN 'announcement' ELSE 'reported_announcement' END AS event_type, CASE WHEN capped THEN substr(announce_known_at, 1, 10) ELSE opened END AS valid_at,
    CASE WHEN disclosed THEN announce_known_at ELSE opened END AS known_at, CASE WHEN disclosed THEN 'sec_metadata_confirmed' ELSE press END AS level, CASE WHEN disclosed THEN 'sec_acceptance' ELSE 'event_date_assumed' END AS basis, CASE WHEN capped THEN 'valid_at capped at the disclosure' END AS note, NULL AS problem FROM w WHERE opened IS NOT NULL
  UNION ALL SELECT deal_id, kind, 'completion_indicated', '2026-07-01', resolution_accepted, 'sec_metadata_confirmed', 'sec_acceptance', 'metadata only, no closing label', NULL FROM w WHERE status = 'likely closed' AND sec_resolution_accession <> ''
  UNION ALL SELECT deal_id, kind, CASE WHEN event <> 'unmapped' AND on_day IS NOT NULL THEN event END, on_day, CASE WHEN accepted THEN resolution_accepted ELSE on_day END, CASE WHEN accepted THEN 'sec_metadata_confirmed' ELSE press END, CASE WHEN accepted THEN 'sec_acceptance' ELSE 'event_date_assumed' END, NULL,
    CASE WHEN event = 'unmapped' THEN 'unmapped_window_event' WHEN on_day IS NULL THEN 'event_without_a_date' END FROM w WHERE event IS NOT NULL)"""


def _register(spark: SparkSession, d: str) -> DataFrame:
    c.table(spark, d, "orders").createOrReplaceTempView("tidemark_register_orders")
    return spark.sql(f"SELECT o_orderkey AS deal_id, {_REGISTER} FROM tidemark_register_orders")


@query(f"WITH {_EVENTS} SELECT deal_id, kind, event_type, valid_at, known_at, level, basis, note, problem FROM e")
def register_events(spark: SparkSession, d: str) -> DataFrame:
    return intake.register_events(_register(spark, d))


@query(f"WITH {_EVENTS} SELECT 'deal_kind' AS what, kind AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'outcome', CASE deal_id % 3 WHEN 0 THEN 'Y0_closed' WHEN 1 THEN 'Y1_broken' ELSE 'censored' END, count(*) FROM k WHERE kind = 'signed_definitive' GROUP BY 2")
def build_stats(spark: SparkSession, d: str) -> DataFrame:
    events = intake.register_events(_register(spark, d))
    r = _register(spark, d)
    deals = r.select("deal_id", intake.deal_kind(F.col("deal_type"), F.col("window_event"), F.col("verification"), F.col("status")).alias("kind"))
    outcomes = r.selectExpr("deal_id", "case deal_id % 3 when 0 then 'Y0_closed' when 1 then 'Y1_broken' else 'censored' end as outcome_candidate")
    return intake.build_stats(deals, events, outcomes)


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'unknown_event_type' END, CASE WHEN event_id % 7 = 0 THEN 'unknown_level' END, CASE WHEN event_id % 11 = 0 THEN 'unknown_basis' END, CASE WHEN event_id % 3 = 0 THEN 'known_before_valid' END, CASE WHEN user_id % 4 = 0 THEN 'unknown_deal' END], lambda x: x IS NOT NULL), ';') AS errors FROM events""")
def event_contract(spark: SparkSession, d: str) -> DataFrame:
    """Valid and known times as partial dates: a month is known until its end."""
    e = c.table(spark, d, "events").selectExpr("event_id", "user_id as deal_id", "if(event_id % 5 = 0, 'party', 'closing') as event_type", "if(event_id % 7 = 0, 'rumour', 'press_multi') as level", "if(event_id % 11 = 0, 'guess', 'source_stated') as basis", "'2026-03-15' as valid_at", "if(event_id % 3 = 0, '2026-02', '2026-03') as known_at")
    return intake.event_errors(e, e.where("deal_id % 4 <> 0")).select("event_id", "errors")


@query("""WITH r AS (SELECT o_orderkey AS deal_id, o_custkey AS cik, o_orderkey % 3 = 0 AS confirmed, CASE WHEN o_orderkey % 4 = 0 THEN 'A' || o_custkey WHEN o_orderkey % 4 = 1 THEN 'X' || o_orderkey END AS a1, CASE WHEN o_orderkey % 5 = 0 THEN 'X' || o_custkey END AS a2, o_orderkey % 10 = 0 AS claims, o_orderkey % 6 <> 5 AS has_cik FROM orders)
SELECT deal_id, 'sec_announce_accession_not_found' AS problem, a1 AS cited FROM r WHERE has_cik AND a1 LIKE 'X%' UNION ALL SELECT deal_id, 'sec_resolution_accession_not_found', a2 FROM r WHERE has_cik AND a2 IS NOT NULL
UNION ALL SELECT deal_id, 'confirmed_without_accession', NULL FROM r WHERE confirmed AND a1 IS NULL AND a2 IS NULL UNION ALL SELECT deal_id, 'claims_that_content_was_read', NULL FROM r WHERE claims""")
def register_problems(spark: SparkSession, d: str) -> DataFrame:
    r = c.table(spark, d, "orders").selectExpr("o_orderkey as deal_id", "if(o_orderkey % 6 <> 5, o_custkey, null) as sec_cik", "if(o_orderkey % 3 = 0, 'sec_metadata_confirmed', 'press') as verification", "case o_orderkey % 4 when 0 then concat('A', o_custkey) when 1 then concat('X', o_orderkey) else '' end as sec_announce_accession", "if(o_orderkey % 5 = 0, concat('X', o_custkey), '') as sec_resolution_accession", "if(o_orderkey % 10 = 0, 'yes', 'no') as filing_content_verified")
    filings = c.table(spark, d, "customer").selectExpr("c_custkey as cik", "concat('A', c_custkey) as accession")
    return intake.register_problems(r, filings)


@query("""SELECT o_orderkey AS deal_id, CASE k WHEN 0 THEN 'announcement_not_found' WHEN 1 THEN 'not_an_announcement' WHEN 2 THEN 'terms_not_found' WHEN 3 THEN 'resolution_not_found' WHEN 4 THEN 'not_that_resolution' END AS reason, CASE WHEN k = 6 THEN NULL WHEN k = 3 THEN NULL ELSE '2026-02-0' || (o_custkey % 9 + 1) END AS resolved_at FROM (SELECT *, o_orderkey % 7 AS k FROM orders)""")
def manifest_deals(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed deals against what their filings show."""
    m = c.table(spark, d, "orders").selectExpr("o_orderkey as deal_id", "o_custkey as target_cik", "case o_orderkey % 7 when 0 then 'none' when 1 then 'R' else 'A' end as announcement_accession", "if(o_orderkey % 7 = 2, 'none', 'A') as terms_accession", "case o_orderkey % 7 when 3 then 'none' when 6 then null else 'R' end as resolution_accession", "case o_orderkey % 7 when 4 then 'terminated' when 6 then null else 'closed' end as resolution_type", "cast(null as string) as resolution_timestamp")
    k = c.table(spark, d, "customer").selectExpr("c_custkey as cik")
    filings = k.selectExpr("cik", "'A' as accession", "'2026-01-01' as accepted", "array('announcement') as events").unionByName(k.selectExpr("cik", "'R' as accession", "concat('2026-02-0', cik % 9 + 1) as accepted", "array('closed') as events"))
    return intake.manifest_deals(m, filings).select("deal_id", "reason", "resolved_at")


_LONG = "The boards of both companies have unanimously approved the transaction, which remains subject to customary conditions and to the approval of the holders of the target as well as of the competent authorities. "
_CAND = """q AS (SELECT c_custkey AS rank, c_custkey // 2 AS cik, c_custkey % 9 AS k FROM customer),
j AS (SELECT *, CASE WHEN cik % 13 = 0 THEN 'EXCLUDE:duplicate_target' WHEN k = 0 THEN 'DEFER:no_filing_metadata' WHEN k = 1 THEN 'EXCLUDE:not_an_announcement' WHEN k = 2 THEN 'DEFER:text_missing_or_short' WHEN k = 3 THEN 'EXCLUDE:unsupported_mechanics' WHEN k = 4 THEN 'DEFER:acquirer_several_parties' WHEN k = 5 THEN 'DEFER:no_resolution' WHEN k = 6 THEN 'DEFER:same_day_close' ELSE 'ADMIT:rules_pass' END AS r FROM q),
f AS (SELECT *, CASE WHEN r = 'ADMIT:rules_pass' AND rank > min(rank) FILTER (r = 'ADMIT:rules_pass') OVER (PARTITION BY cik) THEN 'EXCLUDE:duplicate_target' ELSE r END AS r2 FROM j),
l AS (SELECT *, count(*) FILTER (r2 = 'ADMIT:rules_pass') OVER (ORDER BY rank) - CASE WHEN r2 = 'ADMIT:rules_pass' THEN 1 ELSE 0 END AS before FROM f)"""


@query(f"WITH {_CAND} SELECT rank, cik AS target_cik, split_part(r2, ':', 1) AS decision, split_part(r2, ':', 2) AS reason, CASE WHEN r2 = 'ADMIT:rules_pass' THEN 'DEAL-WIDGET-ACME-2026' END AS deal_id, CASE WHEN r2 = 'ADMIT:rules_pass' THEN 12.5::DOUBLE END AS offer_price FROM l WHERE before < 20")
def candidate_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A queue worked off in the order of its ranks until twenty deals are admitted."""
    q = c.table(spark, d, "customer").selectExpr("c_custkey as rank", "c_custkey div 2 as target_cik", "'Widget Makers Inc' as target", "concat('A', c_custkey) as accession", "c_custkey % 9 as k")
    cash = lambda who: f"{_LONG}Widget Makers Inc is to be acquired by {who} for $12.50 per share in cash."
    texts = q.select("accession", F.when(F.col("k") == 2, "short").when(F.col("k") == 3, _LONG + "Holders may elect shares.").when(F.col("k") == 4, cash("Acme Holdings and Other Partners")).otherwise(cash("Acme Holdings Inc")).alias("text"))
    filings = q.where("k <> 0").select(F.col("target_cik").alias("cik"), "accession", F.lit("2026-03-01").cast("date").alias("filed"), F.array(F.when(F.col("k") == 1, "closed").otherwise("announcement")).alias("events"))
    ends = q.select(F.col("target_cik").alias("cik"), "accession", F.when(F.col("k") != 5, "closed").alias("resolution"), F.when(F.col("k") == 6, F.lit("2026-03-01")).otherwise(F.lit("2026-08-01")).cast("date").alias("resolution_date"))
    existing = q.where("target_cik % 13 = 0").select(F.col("target_cik").alias("cik"))
    got = intake.resolve_candidates(q.drop("k"), filings, texts, ends, existing, 20)
    return got.select("rank", "target_cik", "decision", "reason", "entry.deal_id", "entry.offer_price")


@query("""SELECT o_orderkey AS deal_id, 'TK' || o_orderkey AS historical_ticker, 'makers widget' AS target_tokens, CASE WHEN k THEN 'other' ELSE 'widget' END AS provider_tokens, NOT k AS names_agree, NOT l AS listing_covers, NOT k AND NOT l AS proof_b, o_orderkey % 5 = 0 AS proof_a FROM (SELECT *, o_orderkey % 3 = 0 AS k, o_orderkey % 4 = 0 AS l FROM orders)""")
def identity_evidence(spark: SparkSession, d: str) -> DataFrame:
    o = c.table(spark, d, "orders")
    deals = o.selectExpr("o_orderkey as deal_id", "concat('tk', o_orderkey) as ticker", "'Widget Makers Inc' as target_name", "to_date(o_orderdate) as announce_date", "if(o_orderkey % 5 = 0, 'MATCHED', 'NO_MATCH') as openfigi_status")
    listings = o.selectExpr("o_orderkey as deal_id", "if(o_orderkey % 3 = 0, 'Other Corp', 'The Widget Company') as provider_name", "if(o_orderkey % 4 = 0, null, date'1990-01-01') as listing_start", "cast(null as date) as listing_end")
    return identity.identity_evidence(deals, listings)


@query("""SELECT c_custkey, c_custkey % 4 = 0 OR c_custkey % 4 = 1 AS convention, c_custkey % 3 = 0 AS proves FROM customer""")
def ticker_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Tickers that follow a convention prove nothing; those that cite a filing of the deal's time do."""
    k = c.table(spark, d, "customer").selectExpr("c_custkey", "concat('DEAL-ABC-XYZ-', c_custkey) as deal_id", "if(c_custkey % 4 = 2, 'ZZZ', 'abc') as ticker", "case c_custkey % 4 when 0 then 'company_tickers.json' when 1 then 'heuristic' when 2 then '' else 'accession 1' end as source",
        "case c_custkey % 3 when 0 then '0000000001-26-000001' when 1 then 'none' else '0000000001-26-000001' end as sec_accession", "if(c_custkey % 3 = 2, date'2024-01-01', date'2026-02-01') as sec_filed_date", "date'2026-01-15' as announce_date", "date'2026-06-01' as resolution_date")
    return k.select("c_custkey", identity.is_convention(F.col("ticker"), F.col("source"), F.col("deal_id")).alias("convention"), identity.earns_proof(k).alias("proves"))


@query("SELECT c_custkey AS deal_id, row_number() OVER (ORDER BY c_custkey) AS place FROM customer WHERE c_nationkey % 3 = 0")
def review_order(spark: SparkSession, d: str) -> DataFrame:
    rows = c.table(spark, d, "customer").selectExpr("c_custkey as deal_id", "if(c_nationkey % 3 = 0, 'DEFERRED_IDENTITY', 'CANONICALLY_ADMITTED') as canonical_status")
    return identity.review_order(rows).select("deal_id", F.col("place").cast("long").alias("place"))


_LANES = ", ".join(f"CAST(coalesce(sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT), 0) AS VARCHAR) AS s{i}" for i in range(4))


def _digest(part: str, columns: list[str], rows: str) -> str:
    text = " || chr(31) || ".join(f"'{x}=' || coalesce(CAST({x} AS VARCHAR), '__NULL__')" for x in columns)
    return f"SELECT '{part}' AS part, n AS n_rows, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM (SELECT count(*) AS n, {_LANES} FROM (SELECT sha256({text}) AS d FROM ({rows})))"


_DEALS = "SELECT o_orderkey AS deal_id, 'T' || o_custkey AS target, CAST(o_orderdate AS DATE) AS announce_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 90 END AS resolution_date, o_orderstatus AS status FROM orders"
_PRINTED = "SELECT l_orderkey AS deal_id, CAST(l_shipdate AS DATE) AS session_date, CAST(l_quantity AS BIGINT) AS close, 'p' || l_linenumber AS provider FROM lineitem"


@query(" UNION ALL ".join((_digest("members", ["deal_id"], "SELECT DISTINCT deal_id FROM (" + _DEALS + ") WHERE status = 'F'"), _digest("canonical_corpus", ["deal_id", "target", "announce_date", "resolution_date", "status"], _DEALS), _digest("price_observations", ["deal_id", "session_date", "close", "provider"], f"SELECT * FROM ({_PRINTED}) WHERE deal_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))))
def frozen_cohort(spark: SparkSession, d: str) -> DataFrame:
    deals = c.table(spark, d, "orders").selectExpr("o_orderkey as deal_id", "concat('T', o_custkey) as target", "to_date(o_orderdate) as announce_date", "if(o_orderkey % 2 = 0, date_add(to_date(o_orderdate), 90), null) as resolution_date", "o_orderstatus as status")
    prints = c.table(spark, d, "lineitem").selectExpr("l_orderkey as deal_id", "to_date(l_shipdate) as session_date", "cast(l_quantity as bigint) as close", "concat('p', l_linenumber) as provider")
    return identity.frozen_cohort(deals, prints, deals.where("status = 'F'"))


@query(f"SELECT deal_id, count(*) AS n FROM ({_PRINTED}) p JOIN ({_DEALS}) d USING (deal_id) WHERE session_date BETWEEN announce_date - 5 AND coalesce(resolution_date, announce_date) + 5 GROUP BY 1")
def deal_window_prints(spark: SparkSession, d: str) -> DataFrame:
    deals = c.table(spark, d, "orders").selectExpr("o_orderkey as deal_id", "to_date(o_orderdate) as announce_date", "if(o_orderkey % 2 = 0, date_add(to_date(o_orderdate), 90), null) as resolution_date")
    prints = c.table(spark, d, "lineitem").selectExpr("l_orderkey as deal_id", "to_date(l_shipdate) as session_date")
    return identity.in_deal_window(prints, deals, 5).groupBy("deal_id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS deal_id, side, CASE WHEN c_custkey % 3 = 0 AND n > 0 THEN 'live' WHEN c_custkey % 4 = 0 THEN 'refetch_cache' ELSE 'missing' END AS source, CASE WHEN c_custkey % 3 = 0 AND n > 0 THEN n WHEN c_custkey % 4 = 0 THEN 7 ELSE 0 END AS n FROM (SELECT *, c_custkey % 5 AS n, unnest(['first', 'second']) AS side FROM customer)""")
def refetched_sides(spark: SparkSession, d: str) -> DataFrame:
    k = c.table(spark, d, "customer").selectExpr("c_custkey as deal_id", "explode(array('first', 'second')) as side", "if(c_custkey % 3 = 0, 'AVAILABLE', 'TRANSIENT_FAILURE') as status", "c_custkey % 5 as n")
    return identity.resolved_sides(k, k.where("deal_id % 4 = 0").selectExpr("deal_id", "side", "7L as n"))


@query(with_views("coverage_rows", """SELECT count(*) AS canonical_n, count(*) FILTER (s = 0) AS canonically_admitted, count(*) FILTER (s = 1) AS deferred_identity, count(*) FILTER (s = 2) AS deferred_price_conflict, count(*) FILTER (s = 3) AS no_price_history, count(*) FILTER (tiingo_n >= 3) AS first_covered, count(*) FILTER (yahoo_n >= 3) AS second_covered,
  any_value(t) AS total_prints, any_value(e) AS deals_with_enough, any_value(e) >= 20 AS price_data_ready FROM (SELECT *, deal_id % 4 AS s FROM coverage_rows), (SELECT CAST(sum(n) AS BIGINT) AS t, count(*) FILTER (n >= 3) AS e FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey))"""))
def admission_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = c.coverage_rows(spark, d).withColumn("status", F.expr("case deal_id % 4 when 0 then 'CANONICALLY_ADMITTED' when 1 then 'DEFERRED_IDENTITY' when 2 then 'DEFERRED_PRICE_CONFLICT' else 'NO_PRICE_HISTORY' end"))
    return identity.admission_meta(rows, c.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("deal_id")))


_RULES = (
    ("event_key_required", "doc_id % 17 = 0"), ("unknown_category", "doc_id % 19 = 0"), ("publisher_required", "doc_id % 23 = 0"), ("unknown_claim_type", "doc_id % 29 = 0"), ("unknown_claimed_status", "doc_id % 31 = 0"), ("revision_and_type_go_together", "doc_id % 13 = 0"),
    ("unknown_sector", "doc_id % 7 = 0"), ("unknown_geography", "doc_id % 9 = 0"), ("bad_source_url", "doc_id % 12 = 0"), ("relayed_item_is_untrusted", "doc_id % 10 = 0"), ("bad_lead_url", "doc_id % 15 = 0"),
)
_ERRS = "list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in _RULES) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH a AS (SELECT doc_id, {_ERRS} AS e FROM documents), b AS (SELECT doc_id, list_concat(e, list_filter([CASE WHEN len(e) = 0 AND doc_id % 4 = 1 THEN 'authority_not_registered' END, CASE WHEN doc_id % 11 = 0 THEN 'unreadable_known_at' END], lambda x: x IS NOT NULL)) AS e FROM a)
SELECT doc_id AS evidence_id, CASE WHEN len(e) = 0 AND doc_id % 16 = 3 THEN 'known_before_publication' ELSE array_to_string(e, ';') END AS errors, CASE WHEN doc_id % 2 = 1 AND doc_id % 11 <> 0 THEN 'explicit' WHEN doc_id % 16 < 11 THEN 'publication_timestamp' ELSE 'missing' END AS known_at_basis,
  'GEO-' || upper(substr(sha1(CASE WHEN doc_id % 19 = 0 THEN 'party' ELSE 'sanctions' END || '|' || CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'key ' || doc_id END), 1, 12)) AS cluster_id FROM b""")
def evidence_contract(spark: SparkSession, d: str) -> DataFrame:
    """Records that break one rule, several, or none."""
    r = c.table(spark, d, "documents").selectExpr(
        "doc_id as evidence_id", "if(doc_id % 17 = 0, ' ', concat(' Key ', doc_id)) as event_key", "if(doc_id % 19 = 0, 'party', 'sanctions') as category", "'s' as statement", "'e' as reporting_entity", "if(doc_id % 23 = 0, null, 'p') as publisher", "if(doc_id % 4 < 2, 'primary_official', 'reputable_secondary') as source_type",
        "if(doc_id % 29 = 0, 'dreamt', 'occurred') as claim_type", "'supports' as stance", "if(doc_id % 31 = 0, 'SURE', 'DISPUTED') as claimed_status", "if(doc_id % 13 = 0, 'r', null) as revises", "cast(null as string) as revision_kind", "if(doc_id % 7 = 0, array('banking', 'magic'), array('banking')) as sectors", "if(doc_id % 9 = 0, array('usa'), array('US', 'EU')) as geographies",
        "case when doc_id % 12 = 0 then 'ftp://x' when doc_id % 4 = 1 then 'https://news.example/a' else 'https://www.sec.gov/a' end as source_url", "if(doc_id % 10 = 0, 'adapter_feed', 'manual') as ingested_via", "true as retrieved", "if(doc_id % 15 = 0, array('nowhere'), null) as lead_urls",
        "if(doc_id % 16 < 11, if(doc_id % 8 = 3, '2026-02-02', '2026-01-02'), null) as publication_timestamp", "'2026-01-01' as event_valid_timestamp", "cast(null as string) as first_observed_timestamp", "case when doc_id % 11 = 0 then '2026-01-05T10:00:00' when doc_id % 2 = 1 then '2026-01-05' end as known_at",
    )
    return contracts.evidence_contract(r).drop("known_utc")


@query(with_views("deals", """SELECT link_id, 'E' || link_id % 4 AS event_id, k.deal_id, CASE WHEN on_day IS NULL THEN 'valid_time_unknown' WHEN on_day < announce_date THEN 'pre_announcement_context' WHEN on_day > resolution_date THEN 'after_resolution' ELSE 'during_deal_life' END AS deal_window,
  CASE WHEN link_id % 11 = 0 THEN 'unknown_channel' WHEN link_id % 13 = 0 THEN 'unknown_link_type' WHEN link_id % 17 = 0 THEN 'carries_an_effect' WHEN link_id % 19 = 0 THEN 'rationale_and_reviewer_required' WHEN announce_date IS NULL THEN 'unknown_deal' WHEN link_id % 4 = 3 THEN 'unknown_event' WHEN on_day > resolution_date THEN 'event_after_resolution'
    WHEN confirmed AND link_id % 4 = 1 THEN 'event_not_admissible' WHEN confirmed AND link_id % 5 = 0 THEN 'citation_not_of_this_event' WHEN confirmed AND link_id % 7 = 0 THEN 'citation_not_trusted' WHEN confirmed AND k.deal_id % 6 = 0 THEN 'citation_does_not_name_the_deal'
    WHEN NOT confirmed AND link_id % 5 = 0 THEN 'unknown_sector' WHEN NOT confirmed AND link_id % 7 = 0 THEN 'sector_not_of_this_event' ELSE 'valid' END AS decision
FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS link_id, CASE WHEN l_linenumber = 5 THEN -l_orderkey ELSE l_orderkey END AS deal_id, (l_orderkey * 10 + l_linenumber) % 2 = 0 AS confirmed,
  CASE (l_orderkey * 10 + l_linenumber) % 4 WHEN 0 THEN DATE '1997-01-01' WHEN 1 THEN DATE '1998-01-01' END AS on_day FROM lineitem) k LEFT JOIN deals d ON d.deal_id = k.deal_id"""))
def exposure_links(spark: SparkSession, d: str) -> DataFrame:
    """Links with every fault that a review refuses."""
    line = c.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as link_id", "if(l_linenumber = 5, -l_orderkey, l_orderkey) as deal_id").distinct()
    links = line.selectExpr(
        "link_id", "deal_id", "concat('E', link_id % 4) as event_id", "if(link_id % 11 = 0, 'luck', 'financing_risk') as channel", "case when link_id % 13 = 0 then 'GUESS' when link_id % 2 = 0 then 'CONFIRMED_DEAL_SPECIFIC' else 'SECTOR_HYPOTHESIS' end as link_type", "if(link_id % 17 = 0, '0.1', 'NOT_ESTIMATED') as effect",
        "if(link_id % 19 = 0, ' ', 'because') as rationale", "'r' as reviewer", "concat(if(link_id % 5 = 0, 'O', 'C'), link_id) as citation_id", "case when link_id % 5 = 0 then 'magic' when link_id % 7 = 0 then 'insurance' else 'banking' end as deal_sector",
    )
    states = spark.createDataFrame([("E0", "VERIFIED_PRIMARY", "1997-01-01"), ("E1", "UNCONFIRMED", "1998-01-01"), ("E2", "CORROBORATED_SECONDARY", None)], "event_id string, status string, valid_at string").withColumn("valid_at", F.col("valid_at").cast("timestamp_ntz"))
    cited = line.selectExpr("concat('C', link_id) as evidence_id", "concat('E', link_id % 4) as event_id", "if(link_id % 7 = 0, 'ai_brief', 'primary_official') as source_type", "true as retrieved", "if(deal_id % 6 = 0, array(-1L), array(deal_id)) as deal_ids")
    other = line.selectExpr("concat('O', link_id) as evidence_id", "'elsewhere' as event_id", "'primary_official' as source_type", "true as retrieved", "array(deal_id) as deal_ids")
    sectors = states.select("event_id", F.array(F.lit("banking")).alias("sectors"))
    return contracts.exposure_links(links, c.deals(spark, d), states, cited.unionByName(other), sectors)
