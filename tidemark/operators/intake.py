"""From registers, filings and candidates to deals: formation, events, verification, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import extract
from tidemark.functions.dates import stamp
from tidemark.functions.text import deal_code, ticker_token
from tidemark.operators.canonical import VERIFICATION_RANK
from tidemark.operators.ordering import numbered
from tidemark.storage import checkpointed

#: Events of a canonical deal, what a known time can rest on, and the kinds of deals by their prefix.
CANONICAL_EVENTS = (
    "announcement proposal_submitted talks_reported reported_announcement proposal_rejected go_shop_started go_shop_expired offer_document_published board_recommendation "
    "shareholder_vote regulatory_invitation_to_comment regulatory_phase1_launched regulatory_clearance regulatory_case_closed regulatory_early_termination regulatory_consent_order "
    "regulatory_consent_order_proposed regulatory_enforcement_order regulatory_approvals_received regulatory_abandonment_notice remedy_divestiture_completed court_injunction "
    "court_order_specific_performance litigation_appeal litigation_settlement completion_indicated closing termination withdrawal"
).split()
KNOWN_BASES = ("sec_acceptance", "source_stated", "event_date_assumed")
DEAL_KINDS = {"signed_definitive": "DEAL", "proposal": "PROP", "unverified": "UNVR"}
#: The event that a register's free text names, first match first; the last ones name none beside the formation.
WINDOW_EVENTS = (
    (r"^announced\+terminated", "termination"), (r"^announced\+closed", "closing"), (r"^terminated", "termination"), (r"^closed", "closing"), (r"^blocked", "court_injunction"),
    (r"^rejected", "proposal_rejected"), (r"^litigation", "court_order_specific_performance"), (r"holder vote", "shareholder_vote"), (r"state AG settlement", "litigation_settlement"),
    (r"go-shop expired", "go_shop_expired"), (r"approvals; close scheduled", "regulatory_approvals_received"), (r"CMA Phase 1 launched", "regulatory_phase1_launched"),
    (r"CMA invitation to comment", "regulatory_invitation_to_comment"), (r"FTC proposed consent", "regulatory_consent_order_proposed"), (r"^(announced|proposal|reported|pending)", None),
)
STATUS_EVENTS = (("closed", "closing"), ("terminated", "termination"), ("rejected", "proposal_rejected"), ("blocked", "court_injunction"))
#: Events whose date is the register's resolution date.
RESOLUTIONS = ("termination", "closing", "court_injunction", "proposal_rejected")


def deal_kind(deal_type: Column, window_event: Column, verification: Column, status: Column) -> Column:
    """proposal, unverified or signed_definitive, from a register's words."""
    kind, event = F.lower(deal_type), F.lower(window_event)
    proposal = kind.contains("proposal") | kind.contains("talks") | event.isin("rejected", "proposal") | event.startswith("reported")
    return F.when(proposal, "proposal").when((verification == "reported_only") | status.startswith("planned"), "unverified").otherwise("signed_definitive")


def formation_event(kind: Column, deal_type: Column) -> Column:
    return F.when(kind == "proposal", F.when(F.lower(deal_type).contains("talks"), "talks_reported").otherwise("proposal_submitted")).when(kind == "signed_definitive", "announcement").otherwise("reported_announcement")


def press_level(verification: Column, n_urls: Column) -> Column:
    """The level of press evidence: as stated, else by how many sources are cited."""
    return F.when(verification.isin("press_multi", "press_single", "reported_only"), verification).when(n_urls >= 2, "press_multi").otherwise("press_single")


def window_event(text: Column) -> Column:
    """The event that the text names; ``unmapped`` for words that no rule knows, null where it names the formation only."""
    out = F.lit("unmapped")
    for pattern, event in reversed(WINDOW_EVENTS):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(event).cast("string")).otherwise(out)
    return out


def register_events(register: DataFrame) -> DataFrame:
    """The formation and the window or resolution event of each register row (all columns text), with level, known time and basis.

    Press evidence without a time of its own is known at the event's date, as an assumption. An agreement can't be
    public before it exists: a later valid date is capped at the disclosure. Rows that name an unknown event, or one
    without a date, come out with the problem and no event.
    """
    col, empty = F.col, lambda c: F.nullif(F.col(c), F.lit(""))
    kind = deal_kind(col("deal_type"), col("window_event"), col("verification"), col("status"))
    urls = F.filter(F.transform(F.split("sources", ";"), lambda u: F.trim(u)), lambda u: u.startswith("http"))
    rows = register.withColumns({"kind": kind, "press": press_level(col("verification"), F.size(urls))})
    opened = F.coalesce(empty("announce_date"), F.when(F.regexp_like("window_event", F.lit("^(announced|reported)")), empty("window_event_date")))
    disclosed = empty("sec_announce_accession").isNotNull() & empty("announce_known_at").isNotNull()
    capped = disclosed & (stamp(opened)["earliest"] > stamp(col("announce_known_at"))["latest"])
    formation = F.struct(
        formation_event(col("kind"), col("deal_type")).alias("event_type"), F.when(capped, F.substring("announce_known_at", 1, 10)).otherwise(opened).alias("valid_at"), F.when(disclosed, col("announce_known_at")).otherwise(opened).alias("known_at"),
        F.when(disclosed, "sec_metadata_confirmed").otherwise(col("press")).alias("level"), F.when(disclosed, "sec_acceptance").otherwise("event_date_assumed").alias("basis"), F.when(capped, "valid_at capped at the disclosure").alias("note"), F.lit(None).cast("string").alias("problem"),
    )
    named, status = window_event(col("window_event")), F.lit(None).cast("string")
    for prefix, event in reversed(STATUS_EVENTS):
        status = F.when(col("status").startswith(prefix), event).otherwise(status)
    event = F.coalesce(named, F.when(empty("resolution_date").isNotNull(), status))
    on = F.when(event.isin(*RESOLUTIONS), empty("resolution_date")).otherwise(empty("window_event_date"))
    accepted = event.isin("closing", "termination") & empty("sec_resolution_accession").isNotNull() & empty("resolution_accepted").isNotNull()
    problem = F.when(event == "unmapped", "unmapped_window_event").when(on.isNull(), "event_without_a_date")
    window = F.struct(
        F.when(problem.isNull(), event).alias("event_type"), on.alias("valid_at"), F.when(accepted, col("resolution_accepted")).otherwise(on).alias("known_at"), F.when(accepted, "sec_metadata_confirmed").otherwise(col("press")).alias("level"),
        F.when(accepted, "sec_acceptance").otherwise("event_date_assumed").alias("basis"), F.lit(None).cast("string").alias("note"), problem.alias("problem"),
    )
    indicated = col("status").startswith("likely closed") & empty("sec_resolution_accession").isNotNull() & empty("resolution_accepted").isNotNull()
    completion = F.struct(
        F.lit("completion_indicated").alias("event_type"), F.substring("resolution_accepted", 1, 10).alias("valid_at"), col("resolution_accepted").alias("known_at"), F.lit("sec_metadata_confirmed").alias("level"),
        F.lit("sec_acceptance").alias("basis"), F.lit("metadata only, no closing label").alias("note"), F.lit(None).cast("string").alias("problem"),
    )
    found = F.array_compact(F.array(F.when(opened.isNotNull(), formation), F.when(indicated, completion), F.when(event.isNotNull(), window)))
    return rows.select("deal_id", "kind", F.explode(found).alias("e")).select("deal_id", "kind", "e.*")


def event_errors(events: DataFrame, deals: DataFrame) -> DataFrame:
    """``events`` with every rule that each breaks: words outside the vocabularies, known before it happened, no such deal.

    Events attach to deals that exist; they never make one.
    """
    known = events.join(deals.select("deal_id", F.lit(True).alias("_deal")).distinct(), "deal_id", "left")
    rules = {
        "unknown_event_type": ~F.col("event_type").isin(*CANONICAL_EVENTS),
        "unknown_level": ~F.col("level").isin(*VERIFICATION_RANK),
        "unknown_basis": ~F.col("basis").isin(*KNOWN_BASES),
        "known_before_valid": stamp(F.col("valid_at"))["earliest"] > stamp(F.col("known_at"))["latest"],
        "unknown_deal": F.col("_deal").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return known.withColumn("errors", F.array_join(broken, ";")).drop("_deal")


def build_stats(deals: DataFrame, events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """How many deals by kind, events by type, and outcomes of signed deals: ``what, value, n``."""
    count = lambda df, what, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    signed = outcomes.join(deals.where("kind = 'signed_definitive'").select("deal_id"), "deal_id", "left_semi")
    return count(deals, "deal_kind", "kind").unionByName(count(events, "event_type", "event_type")).unionByName(count(signed, "outcome", "outcome_candidate"))


def register_problems(register: DataFrame, filings: DataFrame) -> DataFrame:
    """What a register claims and its filings don't show: ``deal_id, problem, cited``."""
    cited = F.array(*[F.struct(F.lit(c).alias("claim"), F.nullif(F.col(c), F.lit("")).alias("accession")) for c in ("sec_announce_accession", "sec_resolution_accession")])
    claims = register.where("sec_cik is not null").select("deal_id", F.col("sec_cik").alias("cik"), F.explode(cited).alias("c")).select("deal_id", "cik", "c.*").where("accession is not null")
    missing = claims.join(filings.select("cik", "accession").distinct(), ["cik", "accession"], "left_anti").select("deal_id", F.concat("claim", F.lit("_not_found")).alias("problem"), F.col("accession").alias("cited"))
    no_citation = (F.col("verification") == "sec_metadata_confirmed") & F.coalesce(F.nullif("sec_announce_accession", F.lit("")), F.nullif("sec_resolution_accession", F.lit(""))).isNull()
    own = F.array_compact(F.array(F.when(no_citation, "confirmed_without_accession"), F.when(F.coalesce("filing_content_verified", F.lit("no")) != "no", "claims_that_content_was_read")))
    stated = register.select("deal_id", F.explode(own).alias("problem"), F.lit(None).cast("string").alias("cited"))
    return missing.unionByName(stated)


def manifest_deals(manifest: DataFrame, filings: DataFrame) -> DataFrame:
    """Reviewed deals (deal_id, target_cik, announcement, terms and resolution accessions, resolution_type, ...) checked against
    their filings (cik, accession, accepted, events): the known times that the filings prove, or the reason of the refusal."""
    shown = filings.select(F.col("cik").alias("target_cik"), "accession", "accepted", "events")
    out = manifest
    for role in ("announcement", "terms", "resolution"):
        out = out.join(shown.select("target_cik", F.col("accession").alias(f"{role}_accession"), F.col("accepted").alias(f"{role}_known_at"), F.col("events").alias(f"{role}_events")), ["target_cik", f"{role}_accession"], "left")
    resolved = F.col("resolution_type").isNotNull()
    reason = (
        F.when(F.col("announcement_known_at").isNull(), "announcement_not_found")
        .when(~F.array_contains("announcement_events", "announcement"), "not_an_announcement")
        .when(F.col("terms_known_at").isNull(), "terms_not_found")
        .when(resolved & F.col("resolution_known_at").isNull(), "resolution_not_found")
        .when(resolved & ~F.array_contains("resolution_events", F.col("resolution_type")), "not_that_resolution")
    )
    return out.withColumns({"reason": reason, "resolved_at": F.when(resolved, F.coalesce("resolution_timestamp", "resolution_known_at"))}).drop(*[f"{r}_events" for r in ("announcement", "terms", "resolution")])


#: What a buyer's name can't be, one check a row in the order of the checks, as patterns of its lower-case
#: form; the last one comes behind the comparison with the target.
ACQUIRER_REFUSALS = (
    ("no_entity", r"^(?:an |a )"),
    ("no_entity", r"^(?:the company|the operating partnership|the registrant)$"),
    ("role_word", r"^(?:the )?(?:parent|purchaser|buyer|holdings|holding|inc|corp|corporation|company|ltd|llc|lp|plc|group|partners|acquisition|acquireco|merger|merger sub|newco|unk|buyer consortium|consortium|acquisition sub|investor group)$"),
    ("residue", r"\b(desires?|intends?|proposes?|agrees?|wishes|pursuant|non-binding|proposal from|under the terms|e-?mail|this agreement|adopt this|led by|as a result|surviving corporation|funds? advised by|, which|\bin 20\d{2}\b)\b"),
    ("residue", r",\s*which\b"),
    ("residue", r"\bin 20\d{2}\b"),
    ("residue", r"^\(?[ivx]+\)\b"),
    ("residue", r"\bthe company\b"),
    ("residue", r"\binvestor group\b"),
    ("residue", r"^(?:the surviving|surviving )"),
    ("residue", r"signing|definitive|merger agreement|exhibit|\.htm|managed by|\binvestment funds\b|\bthe signing\b|\bannounced\b|\bagreement under\b|\bpress release\b|\bform\s*8-k\b|\bhas agreed\b|\bpurchaser has\b|@|\bhttp\b|\bwww\."),
    ("price", r"for \$"),
    ("price", r"\$\s*\d"),
    ("no_buyer", r"\b(operating partnership|credit agreement|indenture)\b"),
    ("several_parties", r" and "),
)
#: Words that don't tell a buyer from others, and letters in which the parties' sides are checked.
PARTY_FILLER, SIDE_HEAD = ("INC", "INCORPORATED", "CORP", "CORPORATION", "LLC", "LTD", "THE", "AND"), 16_000
ENTITY = r"(?i)\b(Inc|Incorporated|Corp|Corporation|LLC|L\.L\.C\.?|Ltd|LP|L\.P\.?|PLC|Partners|Capital|Management|Company|Co|Bancorp|Bank|Holdings|Group|Acquisition|AcquireCo|Investments|Advisors|Partnership|KGaA|GmbH|S\.A\.?|N\.V\.?)\b"
BRAND = r"(?i)\b(Capital|Partners|Management|Holdings|Holding|Equity|Group|Fund|Funds|Advisors|Industries|Pharmaceutical|Pharma|Technologies|Semiconductor|International|Corporation|Corp|Company|Inc|LLC|LP|Ltd|PLC|SA|AG|Acquisition|Bravo|Vista|Blackstone|Carlyle|Apollo|Permira|Bain|KKR|TPG)\b"


def acquirer_refusal(name: Column, target: Column) -> Column:
    """Why a name can't be a deal's buyer; null if it can."""
    low = F.lower(F.trim(name))
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[A-Z]"))))
    entity, single = F.regexp_like(name, F.lit(ENTITY)), F.regexp_like(name, F.lit(r"^[A-Z][A-Za-z0-9\-]{3,}$"))
    brand = F.size(words).between(2, 6) & (capitals >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))) & F.regexp_like(name, F.lit(BRAND))
    last = F.element_at(words, -1)
    place = entity & (F.size(words) >= 3) & F.regexp_like(last, F.lit("^[A-Z][A-Za-z]{3,}$")) & ~F.regexp_like(last, F.lit(ENTITY)) & ~F.array_contains(F.transform(F.slice(words, 1, F.size(words) - 1), F.lower), F.lower(last)) & ~F.lower(last).isin("holdings", "partners")
    own = ticker_token(F.coalesce(target, F.lit("")))
    out = F.when(name.isNull() | (low == ""), "missing")
    for code, pattern in ACQUIRER_REFUSALS[:-1]:
        out = out.when(F.regexp_like(low, F.lit(pattern)), code)
    out = out.when(ticker_token(name) == own, "equals_the_target").when((own != "UNK") & F.array_contains(F.split(F.upper(F.regexp_replace(name, "[^A-Za-z0-9]+", " ")), " "), own), "names_the_target")
    out = out.when(F.regexp_like(low, F.lit(ACQUIRER_REFUSALS[-1][1])), ACQUIRER_REFUSALS[-1][0])
    return out.when(~entity & ~brand & ~single, "no_entity_form").when(F.size(words) > 8, "too_long").when(place, "trailing_place")


def is_acquired(text: Column, buyer: Column) -> Column:
    """Whether the head of a text says that someone will acquire the buyer: then the parties' sides are mixed up."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(buyer, F.lit("")), "[^A-Za-z0-9 ]+", " ")), " +")
    core = F.get(F.filter(words, lambda w: (w != "") & ~F.upper(w).isin(*PARTY_FILLER)), 0)
    return F.coalesce(F.regexp_like(F.substring(text, 1, SIDE_HEAD), F.concat(F.lit(r"(?i)\bwill acquire\s+"), core, F.lit(r"\b"))), F.lit(False))


def resolve_candidates(candidates: DataFrame, filings: DataFrame, texts: DataFrame, resolutions: DataFrame, existing: DataFrame, max_admit: int) -> DataFrame:
    """Candidates (rank, target_cik, target, accession) as ADMIT, EXCLUDE or DEFER with the reason; the first rule that fits decides.

    ``filings`` (cik, accession, filed, events), ``texts`` (accession, text, and agreement, if there is that column), ``resolutions`` (cik, accession of the
    announcement, resolution, resolution_date; null resolution if the timeline is contradictory) and ``existing`` (cik)
    are what is known. Of candidates of one target the first admissible one stays. Ranks are worked off until
    ``max_admit`` are admitted; later candidates aren't examined and don't come out. Where the buyer that the terms name
    can't be one, the first of the text's and then of the agreement's buyer candidates that can be takes its place.
    """
    meta = filings.select(F.col("cik").alias("target_cik"), "accession", "filed", "events")
    taken = existing.select(F.col("cik").alias("target_cik"), F.lit(True).alias("taken")).distinct()
    ends = resolutions.select(F.col("cik").alias("target_cik"), "accession", "resolution", "resolution_date")
    rows = candidates.join(taken, "target_cik", "left").join(meta, ["target_cik", "accession"], "left").join(texts, "accession", "left").join(ends, ["target_cik", "accession"], "left")
    rows = rows.withColumn("f", extract.deal_terms(F.coalesce("text", F.lit("")))).withColumn("t", extract.decided_terms(F.col("f"))).drop("f")
    rows = checkpointed(rows.withColumn("first_refusal", acquirer_refusal(F.col("t.acquirer"), F.col("target"))))  # else the checks run again for each rule
    open_text = lambda c: extract.buyer_candidates(F.when(F.col("first_refusal").isNotNull(), F.col(c)))
    others = F.concat(open_text("text"), open_text("agreement")) if "agreement" in texts.columns else open_text("text")
    rows = rows.withColumn("others", others)
    other = F.get(F.filter("others", lambda n: acquirer_refusal(n, F.col("target")).isNull()), 0)
    rows = rows.withColumns({"length": F.length("text"), "acquirer": F.when(F.col("first_refusal").isNull(), F.col("t.acquirer")).otherwise(F.coalesce(other, "t.acquirer")), "refused": F.when(other.isNull(), F.col("first_refusal"))})
    rows = checkpointed(rows.withColumn("inverted", is_acquired(F.col("text"), F.col("acquirer"))).drop("text", "agreement", "others"))
    refused = F.col("refused")
    reason = (
        F.when(F.col("taken"), "EXCLUDE:duplicate_target")
        .when(F.col("events").isNull(), "DEFER:no_filing_metadata")
        .when(~F.array_contains("events", "announcement"), "EXCLUDE:not_an_announcement")
        .when(F.coalesce("length", F.lit(0)) < 200, "DEFER:text_missing_or_short")
        .when(F.col("t.reason").isNotNull(), F.concat(F.lit("EXCLUDE:"), F.col("t.reason")))
        .when(refused.isNotNull(), F.concat(F.lit("DEFER:acquirer_"), refused))
        .when(F.col("inverted"), "EXCLUDE:party_inversion")
        .when(F.col("resolution").isNull(), "DEFER:no_resolution")
        .when((F.col("resolution") == "closed") & (F.col("resolution_date") == F.col("filed")), "DEFER:same_day_close")
        .otherwise("ADMIT:rules_pass")
    )
    judged = rows.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason") == "ADMIT:rules_pass", F.col("rank"))).over(Window.partitionBy("target_cik"))
    judged = judged.withColumn("reason", F.when((F.col("reason") == "ADMIT:rules_pass") & (F.col("rank") > first), "EXCLUDE:duplicate_target").otherwise(F.col("reason")))
    judged = judged.withColumn("deal_id", deal_code(F.col("target"), F.col("acquirer"), F.year("filed")))
    admitted = numbered(judged.where("reason = 'ADMIT:rules_pass'").select("rank"), [], ["rank"], "place").where(F.col("place") == max_admit - 1).agg(F.max("rank").alias("last"))
    part = lambda i: F.element_at(F.split("reason", ":"), i)
    seen = judged.crossJoin(F.broadcast(admitted)).where("last is null or rank <= last")
    return seen.select("rank", "target_cik", part(1).alias("decision"), part(2).alias("reason"), F.when(part(1) == "ADMIT", F.struct("deal_id", "acquirer", "t.consideration_type", "t.offer_price", "t.exchange_ratio", "resolution", "resolution_date")).alias("entry"))
