"""Readers of raw inputs: strict where a value must be a number, with rejects beside what is accepted.

Each reader of a path parses with a function of its own, ``..._of``, that takes texts from any DataFrame. Paths go to Spark's readers only, so they may be in any store that Spark reads.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import START_DATE
from tidemark.functions.text import missing_to_null, short_hash
from tidemark.operators.ordering import small


class Split(NamedTuple):
    """What a reader took, and what it refused with the reason."""

    accepted: DataFrame
    rejected: DataFrame


def split_on_reason(rows: DataFrame, reason: str = "reason") -> Split:
    return Split(rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull()))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def parsed(texts: DataFrame, kind: str, text: str = "payload") -> DataFrame:
    """``texts`` with the JSON of ``text`` as the struct ``j``, without the text."""
    return texts.withColumn("j", F.from_json(text, kind)).drop(text)


def observations_of(texts: DataFrame) -> DataFrame:
    """Payloads of observations: days with a value, null for the missing tokens; other text raises. Other columns stay."""
    kind = "observations array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>"
    own = [c for c in texts.columns if c != "payload"]
    rows = parsed(texts, kind).select(*own, F.explode("j.observations").alias("o")).select(*own, "o.*")
    value = missing_to_null(F.col("value"))
    bad = value.isNull() & F.col("value").isNotNull() & ~F.trim("value").isin(".", "")
    strict = F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), F.col("value"))).cast("double")).otherwise(value)
    return rows.select(*own, F.to_date("date").alias("obs_date"), strict.alias("value"), F.to_date("realtime_start").alias("realtime_start"), F.to_date("realtime_end").alias("realtime_end"))


def series_observations(spark: SparkSession, path: str) -> DataFrame:
    return observations_of(payloads(spark, path))


#: The public address of the series service, and the first day and vintage parameters of a pull.
SERIES_URL = "https://api.stlouisfed.org/fred/series/observations"
FIRST_RELEASE = "&realtime_start=1776-07-04&realtime_end=9999-12-31&output_type=4"


def series_requests(series: DataFrame) -> DataFrame:
    """The address of each pull (series_id, start, end, vintage), without a key; a start before the tracked window is moved to it.

    Nothing here goes to the network: whoever sends a request adds the key, and its errors are redacted (text.redacted).
    """
    start = F.greatest(F.coalesce("start", F.lit(START_DATE)), F.lit(START_DATE))
    more = F.when(F.col("vintage") == "first_release", FIRST_RELEASE).when(F.col("vintage") == "current", "")
    url = F.concat(F.lit(f"{SERIES_URL}?series_id="), "series_id", F.lit("&file_type=json&observation_start="), start, F.when(F.col("end").isNotNull(), F.concat(F.lit("&observation_end="), "end")).otherwise(""), more)
    return series.select("series_id", "vintage", F.when(more.isNull(), F.raise_error(F.lit("vintage must be current or first_release")).cast("string")).otherwise(url).alias("url"))


def day_pull(series: DataFrame, day: Column, answers: DataFrame) -> DataFrame:
    """One row per active series for a day: the last value that its answer has, null if there is none, it failed or says missing."""
    found = answers.groupBy("series_id").agg(F.max_by("value", "seq").alias("raw"))
    value = F.when(~F.trim("raw").isin(".", ""), F.col("raw"))
    return series.where("active").select("series_id").join(found, "series_id", "left").select("series_id", day.alias("obs_date"), value.alias("value"))


def filings_of(texts: DataFrame) -> DataFrame:
    """Submissions as parallel arrays -> one row per filing; pages of older filings have their arrays at the top and ``cik`` beside them."""
    arrays = "accessionNumber:array<string>,form:array<string>,filingDate:array<string>,items:array<string>"
    kind = f"cik string, filings struct<recent:struct<{arrays}>>, {arrays.replace(':', ' ')}"
    j = lambda c: F.coalesce(F.col(f"j.filings.recent.{c}"), F.col(f"j.{c}")).alias(c)
    recent = parsed(texts, kind).select("j.cik", *map(j, ("accessionNumber", "form", "filingDate", "items")))
    rows = recent.select("cik", F.explode(F.arrays_zip("accessionNumber", "form", "filingDate", "items")).alias("f"))
    return rows.select("cik", F.col("f.accessionNumber").alias("accession"), "f.form", F.to_date("f.filingDate").alias("filing_date"), F.transform(F.split("f.items", ","), lambda x: F.trim(x)).alias("items"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    return filings_of(payloads(spark, path))


#: Which filings show an event (event, forms that need an item, items, forms that suffice).
EVENT_RULES = (
    ("announcement", ("8-K", "8-K/A"), ("1.01",), ("425",)),
    ("closed", ("8-K", "8-K/A"), ("2.01",), ("25-NSE", "15-12B", "15-12G")),
    ("terminated", ("8-K", "8-K/A"), ("1.02",), ()),
    ("withdrawn", ("8-K", "8-K/A"), ("1.02", "8.01"), ("RW",)),
)


def filing_events(rows: DataFrame) -> DataFrame:
    """The events that each filing shows by form and items."""
    shown = [F.when((F.col("form").isin(*forms) & F.arrays_overlap("items", F.array(*map(F.lit, items)))) | F.col("form").isin(*alone), event) for event, forms, items, alone in EVENT_RULES]
    return rows.withColumn("event", F.explode(F.array_compact(F.array(*shown))))


def resolution(events: DataFrame) -> DataFrame:
    """closed or broken per filing; a filing that shows both a close and a termination decides nothing."""
    has = lambda *e: F.bool_or(F.col("event").isin(*e))
    close, end = has("closed"), has("terminated", "withdrawn")
    return events.groupBy("cik", "accession").agg(F.when(close & end, None).when(close, "closed").when(end, "broken").alias("resolution"))


def chart_of(texts: DataFrame) -> DataFrame:
    """Epoch and close arrays -> closes by New York date; null and non-positive closes are dropped."""
    rows = parsed(texts, "symbol string, timestamp array<long>, close array<double>").select("j.symbol", F.explode(F.arrays_zip(F.col("j.timestamp").alias("timestamp"), F.col("j.close").alias("close"))).alias("p"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("p.timestamp"), "America/New_York"))
    return rows.where("p.close > 0 and not isnan(p.close)").select("symbol", day.alias("session_date"), F.col("p.close").alias("close"))


def chart_series(spark: SparkSession, path: str) -> DataFrame:
    return chart_of(payloads(spark, path))


def eod_history(answers: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers of an end-of-day provider -> each deal's status, and the closes of those that are available.

    Answers: deal_id, symbol, target_name, announce_date, start, end, has_token, meta_code, meta, prices_code, prices (JSON).
    The listing's identity is checked before any price is looked at. Raw closes count; the adjusted one is kept beside
    them. Closes that are missing or not positive, outside the window or not on a session are left out.
    """
    from tidemark.functions.listing import listing_problems, session_close

    meta = F.from_json("meta", "ticker string, name string, startDate string, endDate string")
    found = F.coalesce(F.from_json("prices", "array<struct<date:string,close:double,adjClose:double>>"), F.array().cast("array<struct<date:string,close:double,adjClose:double>>"))
    rows = answers.withColumns({"m": meta, "found": found})
    problems = listing_problems(F.col("m.name"), F.col("target_name"), F.to_date(F.substring("m.startDate", 1, 10)), F.to_date(F.substring("m.endDate", 1, 10)), F.col("announce_date"))
    busy = lambda c: (F.col(c) == 429) | (F.col(c) >= 500)
    status = (
        F.when(~F.col("has_token"), "CREDENTIALS_REQUIRED")
        .when(F.col("symbol").isNull(), "IDENTITY_UNRESOLVED")
        .when(F.col("meta_code") == 404, "SYMBOL_NOT_FOUND")
        .when(busy("meta_code") | (F.col("meta_code") != 200), "TRANSIENT_FAILURE")
        .when(F.size(problems) > 0, "IDENTITY_AMBIGUOUS")
        .when(busy("prices_code") | (F.col("prices_code") != 200), "TRANSIENT_FAILURE")
        .when(F.size("found") == 0, "NO_HISTORY")
    )
    rows = rows.withColumns({"status": status, "problems": F.array_join(problems, ";")})
    open_ = rows.where("status is null").select("deal_id", "start", "end", F.upper(F.coalesce("m.ticker", "symbol")).alias("symbol"), F.explode("found").alias("p"))
    day = F.to_date(F.substring("p.date", 1, 10))
    closes = open_.select("deal_id", "symbol", day.alias("session_date"), F.col("p.close").alias("close"), F.when(F.col("p.adjClose") > 0, F.col("p.adjClose")).alias("adjusted_close"), "start", "end")
    closes = closes.where("close > 0 and not isnan(close) and session_date between start and end").join(small(calendar.where("is_trading").select(F.col("obs_date").alias("session_date"))), "session_date")
    closes = closes.select("deal_id", "symbol", "session_date", "close", "adjusted_close", session_close(F.col("session_date")).alias("known_at"))
    have = closes.select("deal_id", F.lit("AVAILABLE").alias("served")).distinct()
    return rows.join(have, "deal_id", "left").select("deal_id", F.coalesce("status", "served", F.lit("NO_HISTORY")).alias("status"), "problems"), closes


def access_posture(mode: Column, user: Column, folder: Column, folder_exists: Column) -> Column:
    """How a licensed provider can be reached: wrds, flat_file or none, whether that is available, and why not. Credentials are never made up."""
    asked = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    has_user, has_folder = F.trim(F.coalesce(user, F.lit(""))) != "", F.coalesce(folder_exists, F.lit(False)) & folder.isNotNull()
    chosen = F.when(~asked.isin("", "auto"), asked).when(has_user, "wrds").when(has_folder, "flat_file").otherwise("none")
    ready = ((chosen == "wrds") & has_user) | ((chosen == "flat_file") & has_folder)
    reason = F.when(ready, None).when(chosen == "none", "not_configured").when(chosen == "wrds", "no_user").when(chosen == "flat_file", "no_folder").otherwise("unknown_mode")
    return F.struct(chosen.alias("mode"), ready.alias("available"), reason.alias("reason"))


def daily_rows(rows: DataFrame) -> Split:
    """Provider rows (deal_id, session_date, price, flag): usable ones, first per day; the others with their reason.

    A row that is refused doesn't take its day: the first accepted one does.
    """
    from pyspark.sql.window import Window

    flag = F.trim(F.coalesce("flag", F.lit("")))
    reason = F.when(F.col("price").isNull() | F.isnan("price"), "missing_price").when(F.col("price") <= 0, "non_positive_price").when(~flag.isin("", "T"), "unusable_flag")
    marked = rows.withColumn("reason", reason)
    w = Window.partitionBy("deal_id", "session_date", F.col("reason").isNull()).orderBy("line")
    again = F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "duplicate_date").otherwise(F.col("reason"))
    return split_on_reason(marked.withColumn("reason", again))


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings, empty as null."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


FEED_REQUIRED = ("category", "statement", "reporting_entity", "publisher", "source_url", "first_observed_at", "claim_type", "source_kind", "brief_date")


def brief_feed_of(lines: DataFrame) -> DataFrame:
    """Lines (column ``line``) of a feed: each with its SHA-256, the required fields, and the first fault as ``reason``, if any."""
    fields = ", ".join(f"{f} string" for f in FEED_REQUIRED)
    own = [c for c in lines.columns if c != "line"]
    read = lines.withColumns({"line_sha256": F.sha2("line", 256), "r": F.from_json("line", fields + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})})
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(f"r.{f}"), F.lit("")) == "", F.lit(f)) for f in FEED_REQUIRED]))
    reason = F.when(F.trim("line") == "", "empty_line").when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "invalid_json").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    return read.select(*own, "line_sha256", *[F.col(f"r.{f}").alias(f) for f in FEED_REQUIRED], reason.alias("reason"))


def brief_feed(spark: SparkSession, path: str) -> Split:
    """A feed of JSON lines: what is accepted, and what is refused for the first fault."""
    return split_on_reason(brief_feed_of(spark.read.text(path).select(F.col("value").alias("line"))))


def candidate_queue(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Full-text search hits (query_no, accession, cik, filed, items) -> candidates: item 1.01, once each, not known yet, oldest first."""
    from tidemark.operators.ordering import numbered

    first = F.min_by(F.struct(*hits.columns), F.struct("query_no", "cik")).alias("r")
    once = hits.where(F.array_contains("items", "1.01")).groupBy("accession").agg(first).select("r.*")
    fresh = once.join(known.select("accession").distinct(), "accession", "left_anti").join(known.select("cik").distinct(), "cik", "left_anti")
    return numbered(fresh, [], ["filed", "accession"], "place").select(*hits.columns, (F.col("place") + 1).alias("rank"))


def price_manifest_of(texts: DataFrame) -> DataFrame:
    """Reviewed price manifests (deal_id, source, prints) -> one row per print."""
    kind = "deal_id string, source string, prints array<struct<session_date:string,price:double,known_at:string>>"
    rows = parsed(texts, kind).select("j.deal_id", "j.source", F.posexplode("j.prints").alias("line", "p"))
    return rows.select("deal_id", "source", "line", F.to_date("p.session_date").alias("session_date"), "p.price", F.try_to_timestamp("p.known_at").cast("timestamp_ntz").alias("known_at"))


def price_manifest(spark: SparkSession, path: str) -> DataFrame:
    return price_manifest_of(payloads(spark, path))


def brief_items_of(texts: DataFrame) -> DataFrame:
    """Items of generated briefs as untrusted records; each one's url points at its item."""
    kind = "url string, published_at string, items array<struct<statement:string,claim_type:string>>"
    rows = parsed(texts, kind).select("j.url", "j.published_at", F.posexplode("j.items").alias("i", "x"))
    url = F.concat("url", F.lit("#item-"), F.col("i").cast("string"))
    return rows.select(url.alias("source_url"), F.lit("ai_brief").alias("source_type"), F.lit(False).alias("retrieved"), "x.statement", "x.claim_type", F.try_to_timestamp("published_at").cast("timestamp_ntz").alias("known_at"))


def brief_items(spark: SparkSession, path: str) -> DataFrame:
    return brief_items_of(payloads(spark, path))


def deal_universe(spark: SparkSession, path: str) -> DataFrame:
    """The deals of a reviewed manifest file, read only."""
    return universe_of(payloads(spark, path))


def universe_of(texts: DataFrame) -> DataFrame:
    kind = "deals array<struct<deal_id:string,target:string,acquirer:string,announcement_timestamp:string,resolution_timestamp:string,resolution_type:string>>"
    return parsed(texts, kind).select(F.explode("j.deals").alias("d")).select("d.*")


LINK_FIELDS = ("event_id", "deal_id", "channel", "link_type", "rationale", "reviewer", "citation_evidence_id", "deal_sector", "effect_on_break_probability")


def exposure_links_of(lines: DataFrame) -> DataFrame:
    """Links from events to deals as JSON lines (column ``line``); fields that a link doesn't have are named in ``unknown_fields``."""
    own = [c for c in lines.columns if c != "line"]
    read = lines.where(F.trim("line") != "").withColumns({"j": F.from_json("line", ", ".join(f"{f} string" for f in LINK_FIELDS)), "unknown_fields": unknown_fields(F.col("line"), LINK_FIELDS)})
    return read.select(*own, *[F.col(f"j.{f}").alias(f) for f in LINK_FIELDS], "unknown_fields")


def unknown_fields(text: Column, known: tuple[str, ...]) -> Column:
    """Keys of a JSON object that aren't known, sorted and joined; null if the text is no object."""
    return F.array_join(F.array_sort(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, known)))), ",")


def exact_number(text: Column) -> Column:
    """A number that is written out as one, else null: no blanks, no signs but one minus, no words like NaN."""
    return F.when(F.regexp_like(text, F.lit(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")), text.try_cast("double"))


def attribute(text: Column, key: str) -> tuple[Column, Column]:
    """Whether a JSON object has a key, and its value as text; a key with null or false is there all the same."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False)), F.get_json_object(text, f"$.{key}")


def sorted_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, null fields left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


EVIDENCE_PARTS = ("event_id", "source_url", "stance", "statement", "publisher", "revises")


def evidence_ledger_of(lines: DataFrame) -> DataFrame:
    """Stored evidence as JSON lines (column ``line``), with a reason where the id isn't the hash of the content: it was tampered with."""
    kind = "evidence_id string, " + ", ".join(f"{x} string" for x in EVIDENCE_PARTS)
    rows = lines.select(F.from_json("line", kind).alias("j")).select("j.*")
    own = short_hash(*[F.col(x) for x in EVIDENCE_PARTS], n=16)
    return rows.withColumn("reason", F.when(F.coalesce(F.col("evidence_id") != own, F.lit(True)), "id_is_not_the_hash_of_its_content"))


def evidence_ledger(spark: SparkSession, path: str) -> Split:
    return split_on_reason(evidence_ledger_of(spark.read.text(path).select(F.col("value").alias("line"))))


class Unconfigured(RuntimeError):
    """A provider without credentials refuses; it never invents rows."""


def unconfigured(name: str):
    raise Unconfigured(f"{name} is not configured")


def csv_rows_of(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Lines (column ``line``) of a CSV without its header, all strings, blank as null; other columns stay."""
    own = [c for c in lines.columns if c != "line"]
    read = lines.select(*own, F.from_csv("line", ", ".join(f"`{c}` string" for c in columns), {"escape": '"'}).alias("r"))
    return read.select(*own, *[F.nullif(F.trim(F.col(f"r.{c}")), F.lit("")).alias(c) for c in columns])
