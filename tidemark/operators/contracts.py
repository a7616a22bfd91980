"""Contracts of evidence records and of links from events to deals: every rule, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import time_point
from tidemark.functions.text import url_host
from tidemark.operators.evidence import ADMISSIBLE, UNTRUSTED

#: Vocabularies of evidence records.
CATEGORIES = (
    "sanctions russia_ukraine_energy_infrastructure iran_us_diplomacy strait_of_hormuz_maritime energy_supply_interruption rates_and_acquisition_financing "
    "government_procurement_regulatory sector_geopolitical_exposure"
).split()
STATUSES = ("VERIFIED_PRIMARY", "CORROBORATED_SECONDARY", "ATTRIBUTED_CLAIM", "UNCONFIRMED", "DISPUTED", "RETRACTED")
SOURCE_TYPES = ("primary_official", "reputable_secondary", "ai_brief", "social_post", "other")
CLAIM_TYPES = ("occurred", "attributed_statement", "scheduled", "prediction", "rumor")
STANCES, REVISIONS = ("supports", "contradicts"), ("correction", "update", "retraction")
#: Feeds that only relay what others say; a parameter, as each installation names its own.
RELAYED = ("brief_feed", "adapter_feed")
SECTORS = (
    "energy_upstream energy_midstream energy_refining utilities_power shipping_maritime logistics_transport airlines defense_aerospace government_services industrials chemicals "
    "metals_mining semiconductors technology_software telecom_media banking insurance asset_management fintech_payments healthcare biopharma consumer real_estate agriculture_food"
).split()
REGIONS = ("EU", "GCC", "GLOBAL", "MENA", "EMEA", "APAC", "LATAM")
#: Domains of issuing authorities.
PRIMARY_DOMAINS = (
    "sec.gov treasury.gov whitehouse.gov federalregister.gov state.gov commerce.gov bis.gov bis.doc.gov defense.gov energy.gov eia.gov federalreserve.gov ftc.gov justice.gov sam.gov "
    "europa.eu gov.uk legislation.gov.uk un.org iaea.org imo.org"
).split()
#: How an event can bear on a deal, and what a link can claim.
CHANNELS = (
    "financing_risk", "regulatory_approval_risk", "sanctions_exposure", "energy_transport_costs", "currency_sovereign_risk", "supply_chain_disruption", "defense_procurement_infrastructure",
)
LINK_TYPES, NO_EFFECT = ("CONFIRMED_DEAL_SPECIFIC", "SECTOR_HYPOTHESIS"), "NOT_ESTIMATED"
TIMES = ("publication_timestamp", "event_valid_timestamp", "first_observed_timestamp", "known_at")


def absent(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def registered(host: Column) -> Column:
    """Whether a host is a registered authority's, or below it."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.arrays_overlap(suffixes, F.array(*map(F.lit, PRIMARY_DOMAINS)))


def web_host(url: Column) -> Column:
    """The host of an absolute http(s) address, null for anything else."""
    return F.when(F.regexp_like(url, F.lit(r"(?i)^https?://")), F.nullif(url_host(url), F.lit("")))


def evidence_contract(records: DataFrame, relayed: tuple[str, ...] = RELAYED) -> DataFrame:
    """``evidence_id, errors, known_at_basis, known_utc, event_key_id``: all rules that a record breaks, in order.

    The registry of authorities is asked only about records without another error, and times are compared only where
    all can be read.
    """
    c = F.col
    at = {t: time_point(c(t)) for t in TIMES}
    each = lambda array, ok: F.exists(F.coalesce(c(array), F.array().cast("array<string>")), lambda x: ~ok(x))
    rules = {
        "event_key_required": absent(c("event_key")),
        "unknown_category": ~c("category").isin(*CATEGORIES),
        "statement_required": absent(c("statement")),
        "reporting_entity_required": absent(c("reporting_entity")),
        "publisher_required": absent(c("publisher")),
        "unknown_source_type": ~c("source_type").isin(*SOURCE_TYPES),
        "unknown_claim_type": ~c("claim_type").isin(*CLAIM_TYPES),
        "unknown_stance": ~c("stance").isin(*STANCES),
        "unknown_claimed_status": c("claimed_status").isNotNull() & ~c("claimed_status").isin(*STATUSES),
        "revision_and_type_go_together": c("revises").isNull() != c("revision_kind").isNull(),
        "unknown_revision_type": c("revision_kind").isNotNull() & ~c("revision_kind").isin(*REVISIONS),
        "unknown_sector": each("sectors", lambda x: x.isin(*SECTORS)),
        "unknown_geography": each("geographies", lambda x: F.regexp_like(x, F.lit("^[A-Z]{2}$")) | x.isin(*REGIONS)),
        "bad_source_url": web_host(c("source_url")).isNull(),
        "relayed_item_is_untrusted": c("ingested_via").isin(*relayed) & (~c("source_type").isin(*UNTRUSTED) | c("retrieved")),
        "bad_lead_url": each("lead_urls", lambda x: web_host(x).isNotNull()),
    }
    plain = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(True)), F.lit(n)) for n, x in rules.items()]))
    rows = records.withColumns({"_errors": plain, **{f"_{t}": x for t, x in at.items()}})
    late = {"authority_not_registered": (F.size("_errors") == 0) & (c("source_type") == "primary_official") & ~registered(web_host(c("source_url")))}
    late |= {f"unreadable_{t}": c(f"_{t}")["precision"] == "refused" for t in TIMES}
    rows = rows.withColumn("_errors", F.concat("_errors", F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in late.items()]))))
    utc = {t: c(f"_{t}")["latest_utc"] for t in TIMES}
    early = (F.size("_errors") == 0) & (utc["known_at"] < utc["publication_timestamp"])
    rows = rows.withColumn("_errors", F.when(F.coalesce(early, F.lit(False)), F.array(F.lit("known_before_publication"))).otherwise(c("_errors")))
    basis = F.when(utc["known_at"].isNotNull(), "explicit").when(utc["publication_timestamp"].isNotNull(), "publication_timestamp").when(utc["first_observed_timestamp"].isNotNull(), "first_observed_timestamp").otherwise("missing")
    cluster = F.concat(F.lit("GEO-"), F.upper(F.substring(F.sha1(F.concat_ws("|", F.coalesce("category", F.lit("")), F.lower(F.trim("event_key")))), 1, 12)))
    return rows.select("evidence_id", F.array_join("_errors", ";").alias("errors"), basis.alias("known_at_basis"), F.coalesce(utc["known_at"], utc["publication_timestamp"], utc["first_observed_timestamp"]).alias("known_utc"), cluster.alias("cluster_id"))


def exposure_links(links: DataFrame, deals: DataFrame, states: DataFrame, citations: DataFrame, sectors: DataFrame) -> DataFrame:
    """Links from events to deals with the window of the deal's life and the first rule that refuses them, if any.

    ``deals``: deal_id, announce_date, resolution_date; ``states``: event_id, status, valid_at; ``citations``: evidence_id,
    event_id, source_type, retrieved, deal_ids; ``sectors``: event_id, sectors. A link never carries an effect.
    """
    cited = citations.select(F.col("evidence_id").alias("citation_id"), F.col("event_id").alias("_cited_event"), F.col("source_type").alias("_kind"), F.col("retrieved").alias("_retrieved"), F.col("deal_ids").alias("_deals"))
    own = deals.select("deal_id", "announce_date", "resolution_date", F.lit(True).alias("_known"))
    rows = links.join(own, "deal_id", "left").join(states.select("event_id", "status", "valid_at"), "event_id", "left").join(cited, "citation_id", "left").join(sectors, "event_id", "left")
    day = F.to_date("valid_at")
    window = F.when(day.isNull(), "valid_time_unknown").when(day < F.col("announce_date"), "pre_announcement_context").when(day > F.col("resolution_date"), "after_resolution").otherwise("during_deal_life")
    confirmed = F.col("link_type") == "CONFIRMED_DEAL_SPECIFIC"
    no = lambda x: ~F.coalesce(x, F.lit(False))
    reason = (
        F.when(no(F.col("channel").isin(*CHANNELS)), "unknown_channel")
        .when(no(F.col("link_type").isin(*LINK_TYPES)), "unknown_link_type")
        .when(no(F.col("effect") == NO_EFFECT), "carries_an_effect")
        .when(absent(F.col("rationale")) | absent(F.col("reviewer")), "rationale_and_reviewer_required")
        .when(F.col("_known").isNull(), "unknown_deal")
        .when(F.col("status").isNull(), "unknown_event")
        .when(window == "after_resolution", "event_after_resolution")
        .when(confirmed & no(F.col("status").isin(*ADMISSIBLE)), "event_not_admissible")
        .when(confirmed & no(F.col("_cited_event") == F.col("event_id")), "citation_not_of_this_event")
        .when(confirmed & no(~F.col("_kind").isin(*UNTRUSTED) & F.col("_retrieved")), "citation_not_trusted")
        .when(confirmed & no(F.array_contains("_deals", F.col("deal_id"))), "citation_does_not_name_the_deal")
        .when(~confirmed & no(F.col("deal_sector").isin(*SECTORS)), "unknown_sector")
        .when(~confirmed & no(F.array_contains("sectors", F.col("deal_sector"))), "sector_not_of_this_event")
    )
    return rows.select("link_id", "event_id", "deal_id", window.alias("deal_window"), F.coalesce(reason, F.lit("valid")).alias("decision"))
