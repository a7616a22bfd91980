"""Evidence: deduplication, revisions, verification as of a time, admissibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordering import small
from tidemark.operators.pit import at_first_cutoff, until_next
from tidemark.storage import checkpointed

#: Sources that never verify anything, and statuses that research may use.
UNTRUSTED = ("ai_brief", "social_post", "other")
ADMISSIBLE = ("VERIFIED_PRIMARY", "CORROBORATED_SECONDARY")


def first_of_each(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Acceptance in feed order: the first record of each key stays, later ones are duplicates of it."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = records.withColumns({"place": F.row_number().over(w), "accepted_id": F.first(order).over(w)})
    return rows.withColumn("outcome", F.when(F.col("place") == 1, "accepted").otherwise("duplicate")).drop("place")


def effective(records: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per cut-off the records known by then, each marked superseded or retracted by a known revision of its own cluster.

    A record without a known time is never knowable.
    """
    known = records.join(small(cutoffs), F.col("known_at") <= F.col("cutoff"))
    return mark_revised(known)


def mark_revised(known: DataFrame) -> DataFrame:
    revisions = known.where("revises is not null").groupBy("event_id", "cutoff", F.col("revises").alias("evidence_id")).agg(F.bool_or(F.col("revision_kind") == "retraction").alias("retracted"), F.lit(True).alias("revised"))
    rows = known.join(revisions, ["event_id", "cutoff", "evidence_id"], "left")
    gone = F.coalesce("revised", F.lit(False))
    return rows.withColumns({"retracted": F.coalesce("retracted", F.lit(False)), "in_effect": ~gone & (F.coalesce("revision_kind", F.lit("")) != "retraction")}).drop("revised")


def status(marked: DataFrame) -> DataFrame:
    """The verification status of each cluster at each cut-off; the first rule that fits decides."""
    trusted_kind = ~F.col("source_type").isin(*UNTRUSTED)
    trusted = F.col("in_effect") & trusted_kind & F.col("retrieved")
    supports, contradicts = trusted & (F.col("stance") == "supports"), trusted & (F.col("stance") == "contradicts")
    primary, occurred = F.col("source_type") == "primary_official", F.col("claim_type") == "occurred"
    agg = marked.groupBy("event_id", "cutoff").agg(
        F.count("*").alias("n_records"),
        F.count_if(supports).alias("support"), F.count_if(contradicts).alias("against"), F.count_if(supports & primary & occurred).alias("primary_for"), F.count_if(contradicts & primary).alias("primary_against"),
        F.count_distinct(F.when(supports & (F.col("source_type") == "reputable_secondary") & occurred, F.col("publisher"))).alias("publishers"),
        F.count_if(supports & F.col("claim_type").isin("attributed_statement", "scheduled", "occurred")).alias("attributable"), F.count_if(F.col("retracted") & trusted_kind).alias("withdrawn"),
        F.max(F.when(supports & occurred, F.col("valid_at"))).alias("valid_at"),
    )
    return agg.select("event_id", "cutoff", "n_records", "publishers", "valid_at", ladder().alias("status"))


def ladder() -> Column:
    """The first rule that fits a cluster's counts."""
    return (
        F.when((F.col("withdrawn") > 0) & (F.col("support") == 0), "RETRACTED")
        .when((F.col("primary_against") > 0) | ((F.col("against") > 0) & (F.col("primary_for") == 0)), "DISPUTED")
        .when(F.col("primary_for") > 0, "VERIFIED_PRIMARY")
        .when(F.col("publishers") >= 2, "CORROBORATED_SECONDARY")
        .when(F.col("attributable") > 0, "ATTRIBUTED_CLAIM")
        .otherwise("UNCONFIRMED")
    )


def changes(records: DataFrame) -> DataFrame:
    """By how much each count of a cluster changes at each time at which something about it became known.

    A record counts from its known time until the first revision of it is known. A publisher counts while any of its
    records does: its running number of records, and a change where that leaves or reaches zero.
    """
    known = records.where("known_at is not null")
    revised = known.where("revises is not null").groupBy("event_id", F.col("revises").alias("evidence_id")).agg(
        F.min("known_at").alias("until"), F.min(F.when(F.col("revision_kind") == "retraction", F.col("known_at"))).alias("retracted_at")
    )
    rows = known.join(revised, ["event_id", "evidence_id"], "left")
    trusted_kind, occurred = ~F.col("source_type").isin(*UNTRUSTED), F.col("claim_type") == "occurred"
    trusted = trusted_kind & F.col("retrieved") & (F.coalesce("revision_kind", F.lit("")) != "retraction") & (F.col("until").isNull() | (F.col("until") > F.col("known_at")))
    supports, contradicts, primary = trusted & (F.col("stance") == "supports"), trusted & (F.col("stance") == "contradicts"), F.col("source_type") == "primary_official"
    flags = {
        "support": supports, "against": contradicts, "primary_for": supports & primary & occurred, "primary_against": contradicts & primary,
        "attributable": supports & F.col("claim_type").isin("attributed_statement", "scheduled", "occurred"), "secondary": supports & (F.col("source_type") == "reputable_secondary") & occurred,
    }
    rows = rows.select("event_id", "publisher", "known_at", "until", "retracted_at", trusted_kind.alias("trusted_kind"), *[F.coalesce(x, F.lit(False)).cast("long").alias(c) for c, x in flags.items()])

    def step(at: Column, sign: int, withdrawn: Column) -> Column:
        return F.struct(at.alias("cutoff"), *[(F.col(c) * sign).alias(c) for c in flags], withdrawn.cast("long").alias("withdrawn"))

    none, nothing = F.lit(0), {c: F.lit(0).cast("long").alias(c) for c in (*flags, "withdrawn")}
    withdrawal = F.struct(F.greatest("known_at", "retracted_at").alias("cutoff"), *[nothing[c] for c in flags], F.col("trusted_kind").cast("long").alias("withdrawn"))
    steps = F.array(step(F.col("known_at"), 1, none), F.when(F.col("until").isNotNull(), step(F.col("until"), -1, none)), F.when(F.col("retracted_at").isNotNull(), withdrawal))
    moved = rows.select("event_id", "publisher", F.explode(F.array_compact(steps)).alias("s")).select("event_id", "publisher", "s.*")
    per = moved.where("secondary <> 0 and publisher is not null").groupBy("event_id", "publisher", "cutoff").agg(F.sum("secondary").alias("d"))
    now = F.sum("d").over(Window.partitionBy("event_id", "publisher").orderBy("cutoff"))
    voices = per.withColumn("n", now).select("event_id", "cutoff", ((F.col("n") > 0).cast("long") - (F.col("n") - F.col("d") > 0).cast("long")).alias("publishers"))
    return moved.drop("publisher", "secondary").unionByName(voices, allowMissingColumns=True)


def status_history(records: DataFrame) -> DataFrame:
    """Changes of each cluster's status over the times at which something about it became known.

    Counts are running sums of their changes, so a cluster costs one sort of its times, however many records it has.
    """
    counts = ("support", "against", "primary_for", "primary_against", "attributable", "withdrawn", "publishers")
    w = Window.partitionBy("event_id").orderBy("cutoff")
    steps = changes(records).groupBy("event_id", "cutoff").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    rows = steps.withColumns({c: F.sum(c).over(w) for c in counts}).withColumn("status", ladder()).withColumn("before", F.lag("status").over(w))
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col("status"))).select("event_id", F.col("cutoff").alias("as_of_utc"), "status")


def status_at(records: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The status of each cluster at each of any number of cut-offs from its first known record on: the history of its
    statuses, carried over the cut-offs in one sweep. It says what ``status`` says of the records in effect."""
    rows, numbers = at_first_cutoff(status_history(records), cutoffs, "as_of_utc")
    last = rows.groupBy("event_id", "_i").agg(F.max_by("status", "as_of_utc").alias("status"))
    return until_next(last, ["event_id"], numbers).select("event_id", "cutoff", "status")


def admissible_since(history: DataFrame, cutoff: Column) -> DataFrame:
    """Clusters admissible at the cut-off, and since when without a break: the last time they became so."""
    w = Window.partitionBy("event_id").orderBy("as_of_utc")
    seen = history.where(F.col("as_of_utc") <= cutoff).withColumn("fine", F.col("status").isin(*ADMISSIBLE))
    rows = seen.withColumn("starts", F.col("fine") & ~F.coalesce(F.lag("fine").over(w), F.lit(False)))
    last = rows.groupBy("event_id").agg(F.max_by("fine", "as_of_utc").alias("fine"), F.max(F.when(F.col("starts"), F.col("as_of_utc"))).alias("admissible_since"))
    return last.where("fine").select("event_id", "admissible_since")


def candidates(states: DataFrame, since: DataFrame) -> DataFrame:
    """Each cluster at its cut-off as admitted or rejected with the reason; what is admitted leaks nothing."""
    rows = states.join(since, "event_id", "left")
    reason = (
        F.when(~F.col("status").isin(*ADMISSIBLE), F.concat(F.lit("status_"), F.col("status")))
        .when(F.col("valid_at").isNull(), "missing_valid_time")
        .when(F.col("valid_at") > F.col("cutoff"), "valid_time_after_prediction_time")
        .when(F.col("admissible_since").isNull() | (F.col("admissible_since") > F.col("cutoff")), "known_at_after_prediction_time")
    )
    return rows.select("event_id", "cutoff", "status", "valid_at", "admissible_since", F.coalesce(reason, F.lit("admitted")).alias("decision"))


def revision_chain(records: DataFrame) -> DataFrame:
    """The original that each record goes back to through its revisions, and how many steps that takes. Ids are unique.

    Each round every record takes over where the record it points at points, so a chain of n takes log2(n) rounds, which
    are checkpointed. Revisions that form a cycle raise.
    """
    rows = checkpointed(records.select("evidence_id", F.coalesce("revises", "evidence_id").alias("root"), F.when(F.col("revises").isNull(), 0).otherwise(1).alias("steps")))
    most = rows.count()
    for reach in range(most.bit_length() + 2):
        onward = rows.where("steps > 0").select(F.col("evidence_id").alias("root"), F.col("root").alias("further"), F.col("steps").alias("more"))
        joined = checkpointed(rows.join(onward, "root", "left"))
        if not joined.where("more is not null").limit(1).count():
            return rows
        rows = joined.select("evidence_id", F.coalesce("further", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    raise ValueError("revisions form a cycle")


def exposure_windows(links: DataFrame, deals: DataFrame, grace_days: int = 30) -> DataFrame:
    """Links from events to deals, valid while the event lies in the deal's life, else with the reason."""
    rows = links.join(deals.select("deal_id", "announce_date", "resolution_date"), "deal_id", "left")
    end = F.coalesce(F.date_add("resolution_date", grace_days), F.lit("9999-12-31").cast("date"))
    reason = F.when(F.col("announce_date").isNull(), "unknown_deal").when(F.col("event_date") < F.col("announce_date"), "before_announcement").when(F.col("event_date") > end, "after_resolution")
    return rows.select("link_id", "deal_id", "event_date", F.coalesce(reason, F.lit("valid")).alias("decision"))
