"""Reviewed identities: order of review, evidence records, filing reviews, frozen cohorts, remediation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.listing import listing_problems
from tidemark.functions.text import names_agree, significant_tokens
from tidemark.operators.model import fingerprint
from tidemark.operators.ordering import numbered
from tidemark.operators.review import contemporaneous

#: Columns that know the outcome, forms that can prove an identity, sources that never do.
OUTCOMES = ("resolution_type", "status", "label", "y", "broken", "p_break", "primary_break_vector", "outcome")
PROOF_FORMS = (
    "8-K", "8-K/A", "DEFM14A", "PREM14A", "DEFA14A", "PREC14A", "DEFM14C", "PREM14C", "SC TO-T", "SC TO-T/A", "SC TO-C", "SC TO-C/A", "SC TO-I", "SC TO-I/A",
    "SC 13E-3", "SC 13E-3/A", "SC 13E3", "SC 13E3/A", "S-4", "S-4/A", "425",
)
CONVENTIONS = ("sec_company_tickers", "company_tickers.json", "deal_id_convention")
ACCESSION = r"^\d{10}-\d{2}-\d{6}$"


def review_order(rows: DataFrame, order: Sequence[str] = ("deal_id",)) -> DataFrame:
    """Deferred rows with their place in the review, from 1; an order that looks at an outcome is refused."""
    if seen := set(order) & set(OUTCOMES):
        raise ValueError(f"the order of review must not know the outcome: {sorted(seen)}")
    deferred = rows.where("canonical_status = 'DEFERRED_IDENTITY'")
    return numbered(deferred, [], list(order), "place").withColumn("place", F.col("place") + 1)


def deal_code_ticker(deal_id: Column) -> Column:
    """The second part of DEAL-TICKER-...; null for other ids."""
    parts = F.split(deal_id, "-")
    return F.when((F.size(parts) >= 3) & (F.get(parts, 0) == "DEAL"), F.nullif(F.upper(F.trim(F.get(parts, 1))), F.lit("")))


def identity_evidence(deals: DataFrame, listings: DataFrame) -> DataFrame:
    """One reconstructable identity record per deal: tokens of both names, whether they agree, whether the listing covers the
    announcement, and proof B earned anew from these two, never copied from an earlier flag."""
    rows = deals.join(listings, "deal_id")
    agree, target = names_agree(F.col("provider_name"), F.col("target_name")), F.col("target_name")
    problems = listing_problems(F.col("provider_name"), target, F.col("listing_start"), F.col("listing_end"), F.col("announce_date"))
    covers = ~F.array_contains(problems, "listing_does_not_cover_announcement")
    tokens = lambda c: F.array_sort(significant_tokens(F.coalesce(c, F.lit(""))))
    return rows.select(
        "deal_id", F.nullif(F.upper("ticker"), F.lit("")).alias("historical_ticker"), F.array_join(tokens(target), " ").alias("target_tokens"), F.array_join(tokens(F.col("provider_name")), " ").alias("provider_tokens"),
        agree.alias("names_agree"), covers.alias("listing_covers"), (agree & covers & (F.size(problems) == 0)).alias("proof_b"), F.when(F.col("openfigi_status") == "MATCHED", True).otherwise(False).alias("proof_a"),
    )


def is_convention(ticker: Column, source: Column, deal_id: Column) -> Column:
    """Whether a ticker only follows a convention: a current ticker list, or the deal's own id."""
    src = F.lower(F.coalesce(source, F.lit("")))
    return F.coalesce(src.isin(*CONVENTIONS) | (src.isin("", "deal_id", "heuristic") & (deal_code_ticker(deal_id) == F.upper(ticker))), F.lit(False))


def earns_proof(rows: DataFrame) -> Column:
    """Whether a reviewed row (ticker, source, deal_id, sec_accession, sec_filed_date) cites a filing of the deal's time."""
    cited = F.coalesce(F.regexp_like("sec_accession", F.lit(ACCESSION)), F.lit(False)) & F.col("sec_filed_date").isNotNull()
    return cited & contemporaneous(F.col("sec_filed_date"), F.col("announce_date"), F.col("resolution_date"))


def filing_review(extracted: DataFrame) -> DataFrame:
    """Extracted identities (listing.filing_identity) with their status, the row of the ticker map that a resolved one earns, and why not."""
    found = F.col("historical_ticker").isNotNull() & F.col("evidence_location").isNotNull()
    several = (F.col("n_parenthetical") > 1) & (F.col("evidence_location") == "parenthetical_ticker_adjacent_to_target_name") & F.col("name_adjacent_ticker").isNull()
    status = F.when(~found, "NO_SUFFICIENT_EVIDENCE").when(several, "STILL_AMBIGUOUS").otherwise("RESOLVED_PROOF_C")
    usable = (status == "RESOLVED_PROOF_C") & F.col("sec_accession").isNotNull()
    row = F.struct(F.col("historical_ticker").alias("ticker"), "exchange", "sec_accession", F.col("filed").alias("sec_filed_date"), F.col("form").alias("sec_form"), F.col("evidence_location").alias("source_identifier"))
    return extracted.withColumns({"status": status, "map_row": F.when(usable, row), "form_can_prove": F.col("form").isin(*PROOF_FORMS)})


def frozen_cohort(deals: DataFrame, prints: DataFrame, eligible: DataFrame) -> DataFrame:
    """Sizes and one fingerprint of a frozen cohort: members, the corpus's projection, and its members' prints. What changes
    with a run (retrieval times, flags) isn't part of it."""
    members = eligible.select("deal_id").distinct()
    corpus = deals.select("deal_id", "target", "announce_date", "resolution_date", "status")
    own = prints.join(members, "deal_id", "left_semi").select("deal_id", "session_date", "close", "provider")
    parts = [("members", members), ("canonical_corpus", corpus), ("price_observations", own)]
    each = [fingerprint(df, df.columns).select(F.lit(name).alias("part"), "n_rows", "fingerprint") for name, df in parts]
    return each[0].unionByName(each[1]).unionByName(each[2])


def in_deal_window(prints: DataFrame, deals: DataFrame, pad_days: int = 0) -> DataFrame:
    """Prints from the announcement to the resolution (the announcement, if there is none), with so many days around."""
    start, end = F.date_sub("announce_date", pad_days), F.date_add(F.coalesce("resolution_date", "announce_date"), pad_days)
    return prints.join(deals.select("deal_id", "announce_date", "resolution_date"), "deal_id").where(F.col("session_date").between(start, end)).drop("announce_date", "resolution_date")


def resolved_sides(sides: DataFrame, cached: DataFrame) -> DataFrame:
    """Per deal and side what serves it: a live series, else what an earlier fetch kept, else nothing."""
    rows = sides.join(cached.select("deal_id", "side", F.col("n").alias("n_cached")), ["deal_id", "side"], "left")
    source = F.when((F.col("status") == "AVAILABLE") & (F.col("n") > 0), "live").when(F.col("n_cached") > 0, "refetch_cache").otherwise("missing")
    return rows.select("deal_id", "side", source.alias("source"), F.when(source == "live", F.col("n")).when(source == "refetch_cache", F.col("n_cached")).otherwise(0).alias("n"))


def admission_meta(rows: DataFrame, prints: DataFrame, least: int = 3, ready: int = 20) -> DataFrame:
    """The totals that a coverage report states, in one row, from its rows and the admitted prints (deal_id)."""
    per = prints.groupBy("deal_id").agg(F.count("*").alias("n"))
    totals = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_prints"), F.count_if(F.col("n") >= least).alias("deals_with_enough"))
    counts = {"canonically_admitted": F.col("status") == "CANONICALLY_ADMITTED", "deferred_identity": F.col("status") == "DEFERRED_IDENTITY", "deferred_price_conflict": F.col("status") == "DEFERRED_PRICE_CONFLICT", "no_price_history": F.col("status") == "NO_PRICE_HISTORY", "first_covered": F.col("tiingo_n") >= least, "second_covered": F.col("yahoo_n") >= least}
    own = rows.agg(F.count("*").alias("canonical_n"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in counts.items()])
    return own.crossJoin(F.broadcast(totals)).withColumn("price_data_ready", F.col("deals_with_enough") >= ready)
