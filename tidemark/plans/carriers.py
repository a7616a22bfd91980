"""The inputs of the operators, taken from the driver's tables; each DataFrame beside the same view in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Closures of the carrier calendar.
CLOSED = ("1996-01-01", "1996-07-04", "1996-12-25", "1997-01-01", "1997-07-04", "1997-12-25", "1998-01-01", "1998-07-03", "1998-12-25")

SQL: dict[str, str] = {}


def with_views(names: str, body: str) -> str:
    """``body`` after the named views and what they need."""
    found: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in found:
            found.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in found) + "\n" + body


NEEDS = {
    "calendar": ("prices",),
    "market": ("prices", "calendar"),
    "spread_legs": ("market",),
    "deals": ("lines",),
    "resolved": ("deals",),
    "positions": ("deals",),
    "trades": ("deals",),
}


def spread(df: DataFrame) -> DataFrame:
    """A scan for costly work on its rows: a table of fewer splits than there are cores is dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> F.Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(F.round(F.col(c) * 100).cast("long"))


SQL["prices"] = """
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS close
  FROM orders GROUP BY 1, 2"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """series_id, obs_date, close: an average per priority and day, with gaps and weekend prints."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"), "o_totalprice")
    return o.groupBy("series_id", "obs_date").agg((cents("o_totalprice") / 100.0 / F.count("*")).alias("close"))


SQL["calendar"] = f"""
  SELECT obs_date, isodow(obs_date) < 6 AND obs_date NOT IN ({", ".join(f"DATE '{x}'" for x in CLOSED)}) AS is_trading
  FROM (SELECT CAST(unnest(generate_series(min(obs_date)::TIMESTAMP, max(obs_date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM prices)"""


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """obs_date, is_trading for every day of the orders."""
    o = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    days = o.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("obs_date"))
    open_ = (F.weekday("obs_date") < 5) & ~F.col("obs_date").isin(*[F.to_date(F.lit(x)) for x in CLOSED])
    return days.withColumn("is_trading", open_)


SQL["market"] = """
  SELECT s.series_id, c.obs_date, p.close
  FROM (SELECT DISTINCT series_id FROM prices) s CROSS JOIN (SELECT obs_date FROM calendar WHERE is_trading) c
  LEFT JOIN prices p ON p.series_id = s.series_id AND p.obs_date = c.obs_date"""


def market(spark: SparkSession, d: str) -> DataFrame:
    """series_id, obs_date, close on every session of every series; close is null where there was no print."""
    from tidemark.operators.market import calendar_anchored

    return calendar_anchored(prices(spark, d), calendar(spark, d))


SQL["spread_legs"] = """
  SELECT a.obs_date, a.close AS leg_a, b.close AS leg_b, b.close - a.close AS spread, b.close / nullif(a.close, 0) AS ratio
  FROM (SELECT * FROM market WHERE series_id = '1-URGENT') a JOIN (SELECT * FROM market WHERE series_id = '2-HIGH') b ON a.obs_date = b.obs_date"""


def spread_legs(spark: SparkSession, d: str) -> DataFrame:
    """Two series side by side on every session."""
    from tidemark.operators.market import two_legs

    return two_legs(market(spark, d), "1-URGENT", "2-HIGH")


SQL["lines"] = """
  SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax, max(CAST(l_shipdate AS DATE)) AS last_ship
  FROM lineitem GROUP BY 1"""
SQL["deals"] = """
  SELECT o_orderkey AS deal_id, CAST(o_orderdate AS DATE) AS announce_date,
    CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'broken' ELSE 'pending' END AS status,
    CASE WHEN o_orderstatus IN ('F', 'P') AND last_ship > CAST(o_orderdate AS DATE) THEN last_ship END AS resolution_date,
    disc / (20.0::DOUBLE * n) AS p_break, c_mktsegment AS sector, r_name AS geography, o_totalprice AS deal_value,
    o_totalprice / 1000.0::DOUBLE AS current_price,
    o_totalprice / 1000.0::DOUBLE * (1.0::DOUBLE + disc / 100.0::DOUBLE / n) AS offer_price,
    o_totalprice / 1000.0::DOUBLE * (1.0::DOUBLE - 3.0::DOUBLE * (tax / 100.0::DOUBLE / n)) AS unaffected_price,
    CAST(CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 180 AS INTEGER) AS DATE) AS expected_close_date,
    CASE o_orderkey % 4 WHEN 0 THEN 'LBO' WHEN 1 THEN 'strategic' WHEN 2 THEN 'take_private' END AS deal_type,
    CASE o_orderkey % 5 WHEN 0 THEN 'stock' WHEN 1 THEN 'mixed' WHEN 2 THEN NULL ELSE 'cash' END AS consideration_type,
    CASE WHEN o_orderkey % 5 < 2 THEN 0.5::DOUBLE + (o_orderkey % 3) * 0.25::DOUBLE END AS exchange_ratio,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 500.0::DOUBLE END AS acquirer_price,
    CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'S' || (o_custkey % 11) END AS sponsor,
    CASE o_orderkey % 6 WHEN 0 THEN 'antitrust' WHEN 1 THEN 'financing' WHEN 2 THEN 'regulatory' WHEN 3 THEN 'cfius' END AS break_vector
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN lines ON l_orderkey = o_orderkey"""


def deals(spark: SparkSession, d: str) -> DataFrame:
    """One deal per order: dates, status, prices, terms; prices are null for orders without lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), F.max(F.to_date("l_shipdate")).alias("last_ship")
    )
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    rows = table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    now = F.col("o_totalprice") / 1000.0
    pick = lambda n, **by: F.element_at(F.create_map(*[F.lit(x) for k, v in by.items() for x in (int(k[1:]), v)]), (key % n).cast("int"))
    return rows.select(
        key.alias("deal_id"),
        day.alias("announce_date"),
        F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "broken").otherwise("pending").alias("status"),
        F.when(F.col("o_orderstatus").isin("F", "P") & (F.col("last_ship") > day), F.col("last_ship")).alias("resolution_date"),
        (F.col("disc") / (20.0 * F.col("n"))).alias("p_break"),
        F.col("c_mktsegment").alias("sector"),
        F.col("r_name").alias("geography"),
        F.col("o_totalprice").alias("deal_value"),
        now.alias("current_price"),
        (now * (1.0 + F.col("disc") / 100.0 / F.col("n"))).alias("offer_price"),
        (now * (1.0 - 3.0 * (F.col("tax") / 100.0 / F.col("n")))).alias("unaffected_price"),
        F.date_add(day, (30 + key % 180).cast("int")).alias("expected_close_date"),
        pick(4, k0="LBO", k1="strategic", k2="take_private").alias("deal_type"),
        pick(5, k0="stock", k1="mixed", k3="cash", k4="cash").alias("consideration_type"),
        F.when(key % 5 < 2, 0.5 + (key % 3) * 0.25).alias("exchange_ratio"),
        F.when(key % 7 != 0, F.col("o_totalprice") / 500.0).alias("acquirer_price"),
        F.when((key % 4).isin(0, 2), F.concat(F.lit("S"), (F.col("o_custkey") % 11).cast("string"))).alias("sponsor"),
        pick(6, k0="antitrust", k1="financing", k2="regulatory", k3="cfius").alias("break_vector"),
    )


SQL["resolved"] = """
  SELECT *, CASE WHEN status = 'broken' THEN 1 ELSE 0 END AS label FROM deals
  WHERE status IN ('closed', 'broken') AND resolution_date <= DATE '1999-12-31' AND p_break IS NOT NULL"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.evaluation import resolved_deals

    return resolved_deals(deals(spark, d), "1999-12-31")


SQL["positions"] = """
  SELECT deal_id, deal_value AS capital, p_break, (current_price - unaffected_price) * 100.0::DOUBLE AS downside_notional, sector, sponsor, geography, break_vector
  FROM deals WHERE status = 'pending' AND p_break IS NOT NULL"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    return deals(spark, d).where("status = 'pending' and p_break is not null").selectExpr(
        "deal_id", "deal_value as capital", "p_break", "(current_price - unaffected_price) * 100.0D as downside_notional", "sector", "sponsor", "geography", "break_vector"
    )


SQL["trades"] = """
  SELECT deal_id, announce_date AS entry_date, current_price AS entry_price, offer_price,
    CASE WHEN deal_id % 9 <> 0 THEN unaffected_price END AS unaffected_price, expected_close_date, status, resolution_date,
    CASE WHEN deal_id % 8 = 0 THEN 500000.0::DOUBLE END AS capital, consideration_type,
    CASE WHEN status = 'broken' AND deal_id % 3 = 0 THEN current_price * 0.9::DOUBLE END AS break_exit_price,
    CASE WHEN status = 'broken' AND deal_id % 3 = 0 AND deal_id % 33 <> 0 THEN 'tape' END AS break_exit_source,
    CASE WHEN status = 'broken' AND deal_id % 3 = 0 THEN resolution_date END AS break_exit_date,
    p_break, CAST(announce_date + CAST(CASE WHEN deal_id % 21 = 0 THEN 1 ELSE -1 END AS INTEGER) AS DATE) AS p_break_as_of
  FROM deals WHERE current_price > 0 AND offer_price IS NOT NULL"""


def trades(spark: SparkSession, d: str) -> DataFrame:
    return deals(spark, d).where("current_price > 0 and offer_price is not null").selectExpr(
        "deal_id", "announce_date as entry_date", "current_price as entry_price", "offer_price",
        "if(deal_id % 9 <> 0, unaffected_price, null) as unaffected_price", "expected_close_date", "status", "resolution_date",
        "if(deal_id % 8 = 0, 500000.0D, null) as capital", "consideration_type",
        "if(status = 'broken' and deal_id % 3 = 0, current_price * 0.9D, null) as break_exit_price",
        "if(status = 'broken' and deal_id % 3 = 0 and deal_id % 33 <> 0, 'tape', null) as break_exit_source",
        "if(status = 'broken' and deal_id % 3 = 0, resolution_date, null) as break_exit_date",
        "p_break", "date_add(announce_date, if(deal_id % 21 = 0, 1, -1)) as p_break_as_of",
    )


SQL["observations"] = """
  SELECT user_id AS deal_id, event_id AS seq, ts AS observed_at, ts + INTERVAL 1 DAY * CAST(event_id % 5 AS INTEGER) AS known_at, event_type AS source,
    CASE WHEN event_type = 'view' THEN value END AS target_price, CASE WHEN event_type = 'purchase' THEN value END AS offer_price,
    CASE WHEN event_type = 'signup' THEN value END AS unaffected_price
  FROM events"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Sparse bitemporal rows: each states one price of a deal, knowable up to four days later."""
    return table(spark, d, "events").selectExpr(
        "user_id as deal_id", "event_id as seq", "ts as observed_at", "ts + make_dt_interval(int(event_id % 5)) as known_at", "event_type as source",
        "if(event_type = 'view', value, null) as target_price", "if(event_type = 'purchase', value, null) as offer_price", "if(event_type = 'signup', value, null) as unaffected_price",
    )


SQL["lifecycle"] = """
  SELECT user_id AS deal_id, event_id AS seq, ts AS event_at, ts + INTERVAL 1 DAY * CAST(event_id % 5 AS INTEGER) AS known_at,
    CASE event_type WHEN 'signup' THEN 'announcement' WHEN 'view' THEN 'second_request' WHEN 'click' THEN 'hsr_clearance' WHEN 'error' THEN 'termination' ELSE 'closing' END AS event_type
  FROM events"""


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Bitemporal lifecycle events of the same deals."""
    return table(spark, d, "events").selectExpr(
        "user_id as deal_id", "event_id as seq", "ts as event_at", "ts + make_dt_interval(int(event_id % 5)) as known_at",
        "case event_type when 'signup' then 'announcement' when 'view' then 'second_request' when 'click' then 'hsr_clearance' when 'error' then 'termination' else 'closing' end as event_type",
    )


SQL["evidence"] = """
  SELECT doc_id AS evidence_id, upper(substr(sha1(coalesce(source, '') || '|' || coalesce(lang, '')), 1, 12)) AS event_id, 'p' || (doc_id // 20 % 7) AS publisher,
    CASE WHEN doc_id // 20 % 11 = 0 THEN 'contradicts' ELSE 'supports' END AS stance,
    CASE doc_id // 20 % 4 WHEN 0 THEN 'occurred' WHEN 1 THEN 'attributed_statement' WHEN 2 THEN 'occurred' ELSE 'prediction' END AS claim_type,
    CASE doc_id // 20 % 5 WHEN 0 THEN 'ai_brief' WHEN 1 THEN 'reputable_secondary' WHEN 2 THEN 'reputable_secondary' WHEN 3 THEN 'primary_official' ELSE 'social_post' END AS source_type,
    doc_id // 20 % 3 <> 0 AS retrieved,
    CASE WHEN doc_id // 20 % 13 <> 5 THEN TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 DAY * CAST(doc_id % 400 AS INTEGER) END AS known_at,
    TIMESTAMP '2025-12-25 00:00:00' + INTERVAL 1 DAY * CAST(doc_id % 400 AS INTEGER) AS valid_at,
    CASE WHEN doc_id // 20 % 9 = 4 THEN doc_id - 20 END AS revises, CASE WHEN doc_id // 20 % 9 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'correction' ELSE 'retraction' END END AS revision_kind
  FROM documents"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence records about events; some revise an earlier one."""
    return table(spark, d, "documents").selectExpr(
        "doc_id as evidence_id", "upper(substr(sha1(concat(coalesce(source, ''), '|', coalesce(lang, ''))), 1, 12)) as event_id", "concat('p', doc_id div 20 % 7) as publisher",
        "if(doc_id div 20 % 11 = 0, 'contradicts', 'supports') as stance",
        "case doc_id div 20 % 4 when 0 then 'occurred' when 1 then 'attributed_statement' when 2 then 'occurred' else 'prediction' end as claim_type",
        "case doc_id div 20 % 5 when 0 then 'ai_brief' when 1 then 'reputable_secondary' when 2 then 'reputable_secondary' when 3 then 'primary_official' else 'social_post' end as source_type",
        "doc_id div 20 % 3 <> 0 as retrieved",
        "if(doc_id div 20 % 13 <> 5, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(int(doc_id % 400)), null) as known_at",
        "timestamp_ntz'2025-12-25 00:00:00' + make_dt_interval(int(doc_id % 400)) as valid_at",
        "if(doc_id div 20 % 9 = 4, doc_id - 20, null) as revises", "if(doc_id div 20 % 9 = 4, if(doc_id % 2 = 0, 'correction', 'retraction'), null) as revision_kind",
    )


SQL["provider_prints"] = """
  SELECT event_type AS deal_id, CAST(ts AS DATE) AS session_date, CASE WHEN event_id % 2 = 0 OR event_id % 31 = 7 THEN 'a' ELSE 'b' END AS provider,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS close
  FROM events GROUP BY 1, 2, 3"""


def provider_prints(spark: SparkSession, d: str) -> DataFrame:
    """Two providers' closes of the same sessions."""
    e = table(spark, d, "events").selectExpr("event_type as deal_id", "to_date(ts) as session_date", "if(event_id % 2 = 0 or event_id % 31 = 7, 'a', 'b') as provider", "value")
    return e.groupBy("deal_id", "session_date", "provider").agg((cents("value") / 100.0 / F.count("*")).alias("close"))


SQL["coverage_rows"] = """
  SELECT s_suppkey AS deal_id, s_suppkey % 5 AS tiingo_n, s_suppkey % 4 AS yahoo_n, (s_suppkey % 5) + (s_suppkey % 4) AS combined_n,
    CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END AS material_conflicts,
    CASE s_suppkey % 6 WHEN 0 THEN 'SYMBOL_NOT_FOUND' WHEN 1 THEN 'NO_HISTORY' WHEN 2 THEN 'IDENTITY_AMBIGUOUS' WHEN 3 THEN 'TRANSIENT_FAILURE' ELSE 'ok' END AS tiingo_status,
    CASE s_suppkey % 7 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'NAME_MISMATCH' ELSE 'MATCHED' END AS openfigi_status,
    CASE WHEN s_suppkey % 8 = 0 THEN 'reviewed_sec_mapping' END AS identity_basis, s_suppkey % 3 = 0 AS tiingo_identity_verified, s_suppkey % 2 = 0 AS yahoo_identity_verified,
    s_suppkey % 23 = 0 AS infrastructure_failed
  FROM supplier"""


def coverage_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey as deal_id", "s_suppkey % 5 as tiingo_n", "s_suppkey % 4 as yahoo_n", "(s_suppkey % 5) + (s_suppkey % 4) as combined_n", "if(s_suppkey % 17 = 0, 1, 0) as material_conflicts",
        "case s_suppkey % 6 when 0 then 'SYMBOL_NOT_FOUND' when 1 then 'NO_HISTORY' when 2 then 'IDENTITY_AMBIGUOUS' when 3 then 'TRANSIENT_FAILURE' else 'ok' end as tiingo_status",
        "case s_suppkey % 7 when 0 then 'NO_MATCH' when 1 then 'AMBIGUOUS' when 2 then 'NAME_MISMATCH' else 'MATCHED' end as openfigi_status",
        "if(s_suppkey % 8 = 0, 'reviewed_sec_mapping', null) as identity_basis", "s_suppkey % 3 = 0 as tiingo_identity_verified", "s_suppkey % 2 = 0 as yahoo_identity_verified",
        "s_suppkey % 23 = 0 as infrastructure_failed",
    )
