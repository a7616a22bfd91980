"""Rows of a price coverage run: what a provider's answer leads to, which cached rows stay, which can be brought to the present schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema's version, what a row of it must have, statuses that say nothing about prices, attempts allowed.
VERSION = 2
REQUIRED = ("exact_matches", "tolerable_matches", "material_conflicts", "canonical_status", "identity_proofs", "reconcile_rule", "tiingo_identity_verified")
INFRASTRUCTURE = ("TRANSIENT_FAILURE", "PROVIDER_ERROR", "CREDENTIALS_REQUIRED")
MOST_WAITS, MOST_ATTEMPTS = 3, 3


def retry_decision(status: Column, hourly_limited: Column, attempts: Column) -> Column:
    """What to do with an answer after so many attempts; a failure is never taken as a lack of prices. Null attempts are none."""
    done, limited = F.coalesce(attempts, F.lit(0)), F.coalesce(hourly_limited, F.lit(False))
    spent = done >= F.when(limited, MOST_WAITS).otherwise(MOST_ATTEMPTS)
    failed = F.coalesce(status == "TRANSIENT_FAILURE", F.lit(False))
    return F.when(~failed, "accept").when(spent, "unresolved").when(limited, "hourly_wait").otherwise("bounded_retry")


def no_outcome() -> Column:
    """No prints, and a provider or the network failed."""
    prints = F.greatest(F.coalesce("tiingo_n", F.lit(0)), F.coalesce("yahoo_n", F.lit(0))) > 0
    failed = [F.coalesce(F.col(c).isin(*INFRASTRUCTURE), F.lit(False)) for c in ("tiingo_status", "yahoo_status")]
    return ~prints & (failed[0] | failed[1])


def cached_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cache``: ``reuse``, ``migrated``, or why a row must be fetched again, and ``row_migration``, what was done.

    Nothing is invented: matches that a row doesn't classify are zero only where no session overlaps; an old row that has
    everything gets the version's stamp. Columns that an old row lacks are null; extra columns stay.
    """
    overlap = F.coalesce("overlap_sessions", F.lit(0))
    transient = [F.coalesce(F.col(c) == "TRANSIENT_FAILURE", F.lit(False)) for c in ("tiingo_status", "yahoo_status")]
    parts = F.col("exact_matches") + F.col("tolerable_matches") + F.col("material_conflicts")
    complete = F.lit(True)
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    sound = complete & F.coalesce(parts == overlap, F.lit(False))
    reusable = F.coalesce(F.col("row_schema_version") == VERSION, F.lit(False)) & ~transient[0] & ~transient[1] & ~no_outcome() & sound
    unclassified = F.col("exact_matches").isNull() | F.col("tolerable_matches").isNull()
    marked = rows.withColumns({"_reuse": reusable, "_failed": transient[0] | no_outcome(), "_unclassified": unclassified, "_overlap": overlap, "_transient": transient[1]})
    fill = ~F.col("_reuse") & ~F.col("_failed") & F.col("_unclassified") & (F.col("_overlap") == 0)
    filled = marked.withColumn("_fill", fill).withColumns({
        "exact_matches": F.when(F.col("_fill"), 0).otherwise(F.col("exact_matches")), "tolerable_matches": F.when(F.col("_fill"), 0).otherwise(F.col("tolerable_matches")),
        "material_conflicts": F.when(F.col("_fill"), F.coalesce("material_conflicts", F.lit(0))).otherwise(F.col("material_conflicts")),
    })
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in REQUIRED])
    cache = (
        F.when(F.col("_reuse"), "reuse").when(F.col("_failed"), "infrastructure").when(F.col("_unclassified") & (F.col("_overlap") != 0), "unclassified_overlap")
        .when(missing.isNotNull(), missing).when(parts != F.col("_overlap"), "overlap_mismatch").when(F.col("_transient"), "not_reusable").otherwise("migrated")
    )
    done = F.when(F.col("cache") == "migrated", F.when(F.col("_fill"), "zero_overlap_classifications_are_identically_zero").otherwise("stamped_row_schema_version_from_complete_fields"))
    out = filled.withColumn("cache", cache).withColumn("row_migration", done).withColumn("row_schema_version", F.when(F.col("cache") == "migrated", VERSION).otherwise(F.col("row_schema_version")))
    return out.drop("_reuse", "_failed", "_unclassified", "_overlap", "_transient", "_fill")


def ingested_prints(batch: DataFrame, deals: DataFrame, store: DataFrame, order: str) -> DataFrame:
    """``batch`` (deal_id, observed_at, target_price, source_name, source_identifier, known_at) with ``outcome`` and ``problems``.

    A print is quarantined with all its problems, or as an orphan if its deal isn't known; of the others the first in
    ``order`` (unique) of a deal, time and source is accepted unless the ``store`` has that key, the rest are duplicates. So
    a batch that comes again adds nothing.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    problems = F.array_compact(F.array(
        F.when(empty("deal_id"), "missing deal_id"), F.when(~F.coalesce((F.col("target_price") > 0) & ~F.isnan("target_price"), F.lit(False)), "target_price must be a positive float"),
        F.when(F.col("observed_at").isNull(), "missing observation_timestamp"), F.when(empty("source_name") | empty("source_identifier"), "missing source"), F.when(F.col("known_at").isNull(), "known_at missing (never inferred for historical prints)"),
    ))
    known = deals.select("deal_id").distinct().withColumn("_known", F.lit(True))
    rows = batch.withColumn("problems", problems).join(known, "deal_id", "left")
    orphan = F.concat(F.lit("orphan deal_id "), F.col("deal_id").cast("string"))
    rows = rows.withColumn("problems", F.when((F.size("problems") == 0) & F.col("_known").isNull(), F.array(orphan)).otherwise(F.col("problems"))).drop("_known")
    key = ["deal_id", "observed_at", "source_name"]
    fresh = rows.where(F.size("problems") == 0).groupBy(*key).agg(F.min(order).alias("_first")).join(store.select(*key).distinct(), key, "left_anti")
    first = rows.join(fresh.select(F.col("_first").alias(order), F.lit(True).alias("_fresh")), order, "left")
    outcome = F.when(F.size("problems") > 0, "quarantined").when(F.col("_fresh"), "accepted").otherwise("duplicate")
    return first.withColumn("outcome", outcome).select(*batch.columns, "outcome", F.array_join("problems", "; ").alias("problems"))
