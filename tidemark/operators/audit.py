"""Identity, registers, validation, audits and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import names_agree, short_hash
from tidemark.operators.intervals import around, day_number, pieces
from tidemark.operators.ordering import small
from tidemark.storage import checkpointed


def bias_audit(rows: DataFrame, dimensions: Sequence[str], covered: Column) -> DataFrame:
    """Coverage by each value of each dimension, from one pass over unpivoted dimensions."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("value")) for d in dimensions])
    long = rows.select(covered.alias("covered"), F.explode(pairs).alias("p")).select("covered", "p.*")
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if("covered").alias("n_covered"))
    return counts.withColumn("rate", F.col("n_covered") / F.col("n"))


def counts_over_vocabulary(rows: DataFrame, by: str, vocabulary: Sequence[str], column: str) -> DataFrame:
    """Counts per ``by`` and word of the vocabulary, zero where there is none."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    grid = rows.select(by).distinct().crossJoin(small(words))
    return grid.join(rows.groupBy(by, column).agg(F.count("*").alias("n")), [by, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prints_before_resolution(prints: DataFrame, deals: DataFrame, least: int = 3) -> DataFrame:
    """How many prints lie before their deal's resolution, and how many deals have enough of them."""
    per = prints.join(deals, "deal_id").where("resolved_at is null or observed_at < resolved_at").groupBy("deal_id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_prints"), F.count_if(F.col("n") >= least).alias("deals_with_enough"), F.count("*").alias("deals_with_any"))


def identifier_candidates(asked: DataFrame, history: DataFrame) -> DataFrame:
    """Securities whose name history covers the asked day under the asked ticker, with open ends; unique, ambiguous or none.

    Nothing pairs questions with a ticker's rows: the history is summed up to its least and greatest security per ticker and
    dyadic piece of days, and a ticker's asked days, each once, meet the pieces around them. Names are compared only on
    days with one security, whose own names are all that they meet.
    """
    start, end = F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    extent = [F.min("low").alias("low"), F.max("high").alias("high")]
    ranged = history.where(start <= end).select("ticker", "issuer_name", F.col("security").alias("low"), F.col("security").alias("high"), F.explode(pieces(day_number(start), day_number(end))).alias("piece"))
    named = checkpointed(ranged.groupBy("ticker", "piece", "issuer_name").agg(*extent))
    spans = named.groupBy("ticker", "piece").agg(*extent)
    days = asked.where("ticker is not null and as_of is not null").select("ticker", "as_of").distinct()
    around_days = days.select("ticker", "as_of", F.explode(around(day_number(F.col("as_of")))).alias("piece"))
    on_day = checkpointed(around_days.join(spans, ["ticker", "piece"]).groupBy("ticker", "as_of").agg(*extent))
    single = on_day.where("low <=> high").select("ticker", "as_of", F.explode(around(day_number(F.col("as_of")))).alias("piece"))
    names = single.join(named, ["ticker", "piece"]).select("ticker", "as_of", "issuer_name").distinct()
    rows = asked.select("deal_id", "ticker", "as_of", F.coalesce("asked_name", F.lit("")).alias("asked_name"))
    agreed = rows.select("ticker", "as_of", "asked_name").distinct().join(names, ["ticker", "as_of"])
    agreed = agreed.groupBy("ticker", "as_of", "asked_name").agg(F.bool_or(names_agree(F.col("asked_name"), F.col("issuer_name"))).alias("agrees"))
    met = rows.join(on_day, ["ticker", "as_of"]).join(agreed, ["ticker", "as_of", "asked_name"], "left")
    hits = met.groupBy("deal_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("agrees").alias("agrees"), F.lit(True).alias("met"))
    status = F.when(F.col("met").isNull(), "UNRESOLVED").when(F.col("low") < F.col("high"), "AMBIGUOUS").when(~F.col("agrees"), "NAME_MISMATCH").otherwise("MATCHED")
    return asked.select("deal_id").join(hits, "deal_id", "left").select("deal_id", status.alias("status"), F.when(status == "MATCHED", F.col("low")).alias("security"))


def identity_ladder(deals: DataFrame, reviewed: DataFrame, mapped: DataFrame) -> DataFrame:
    """The ticker of each deal and what it rests on: the reviewed map, then the public one, then the id's convention."""
    rows = deals.join(reviewed.select("deal_id", F.col("ticker").alias("t1")), "deal_id", "left").join(mapped.select("deal_id", F.col("ticker").alias("t2")), "deal_id", "left")
    own = F.nullif(F.regexp_extract("name", r"^([A-Z]{2,5})-", 1), F.lit(""))
    basis = F.when(F.col("t1").isNotNull(), "reviewed_sec_mapping").when(F.col("t2").isNotNull(), "sec_company_tickers").when(own.isNotNull(), "id_convention").otherwise("unresolved")
    return rows.select("deal_id", F.coalesce("t1", "t2", own).alias("ticker"), basis.alias("identity_basis"))


def pick_resolution(timeline: DataFrame, months: int = 60) -> DataFrame:
    """Per deal what its timeline says within so many months of the announcement.

    Only a close that stands last wins; a break after a close contradicts it and is deferred.
    """
    end = F.add_months("announce_date", months)  # the same day of that month, or its last: months_between would take the last for any later day
    rows = timeline.where(F.col("event_date").between(F.col("announce_date"), end))
    last = F.max_by("kind", F.struct("event_date", "seq"))
    got = rows.groupBy("deal_id").agg(last.alias("last"), F.bool_or(F.col("kind") == "close").alias("c"), F.bool_or(F.col("kind") == "break").alias("b"), F.max("event_date").alias("event_date"))
    out = F.when(F.col("c") & F.col("b") & (F.col("last") == "break"), "deferred_contradictory").when(F.col("last") == "close", "closed").otherwise("broken")
    return got.select("deal_id", out.alias("resolution"), F.when(out != "deferred_contradictory", F.col("event_date")).alias("resolution_date"))


def register_groups(register: DataFrame) -> DataFrame:
    """Rows about one (kind, target, acquirer) as one deal: its id from the names and the year of the earliest agreement, else of the first event."""
    agreed = F.min(F.when(F.col("row_type") == "agreement", F.col("event_date")))
    rows = register.groupBy("kind", "target", "acquirer").agg(F.count("*").alias("n_rows"), agreed.alias("agreed"), F.min("event_date").alias("first"))
    year = F.year(F.coalesce("agreed", "first"))
    code = lambda c: F.upper(F.substring(F.regexp_replace(c, "[^A-Za-z0-9]", ""), 1, 6))
    name = F.concat_ws("-", F.col("kind"), code(F.col("target")), code(F.col("acquirer")), year.cast("string"))
    return rows.select("kind", "target", "acquirer", "n_rows", name.alias("canonical_deal_id"), F.col("agreed").isNull().alias("year_assumed"))


def evidence_errors(records: DataFrame) -> DataFrame:
    """Every rule that each record breaks, in a fixed order; empty for valid ones."""
    rules = {
        "known_at_missing": F.col("known_at").isNull(),
        "known_before_valid": F.col("known_at") < F.col("valid_at"),
        "untrusted_occurred": F.col("source_type").isin("ai_brief", "social_post") & (F.col("claim_type") == "occurred"),
        "revision_without_kind": F.col("revises").isNotNull() & F.col("revision_kind").isNull(),
        "unretrieved_primary": (F.col("source_type") == "primary_official") & ~F.col("retrieved"),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return records.select("evidence_id", F.array_join(errors, ";").alias("errors"), (F.size(errors) == 0).alias("valid"))


def verification_needs(records: DataFrame) -> DataFrame:
    """What is missing before a record can verify anything, as text."""
    needs = F.array(
        F.when(~F.col("retrieved"), "retrieve the source"),
        F.when(F.col("source_type").isin("ai_brief", "social_post"), "find a primary or reputable secondary source"),
        F.when(F.col("claim_type") != "occurred", "confirm that the event occurred"),
        F.when(F.col("known_at").isNull(), "establish when it was known"),
    )
    return records.select("evidence_id", F.array_join(F.array_compact(needs), "; ").alias("needs"))


def retry_plan(rows: DataFrame) -> DataFrame:
    """What to do with each cached row: keep it, fetch it again, or wait for the hourly limit."""
    action = F.when(F.col("tiingo_status") == "TRANSIENT_FAILURE", "retry_after_reset").when(F.col("infrastructure_failed"), "refetch").when(F.col("identity_basis").isNull() & (F.col("tiingo_status") == "IDENTITY_AMBIGUOUS"), "refetch").otherwise("reuse")
    return rows.select("deal_id", action.alias("action"))


def compare_models(rows: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Metrics of two scores on the deals that have both, and their differences (b - a)."""
    from tidemark.operators.evaluation import auc, probability_metrics

    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def metrics(score: str, suffix: str) -> DataFrame:
        x = both.withColumn("p_break", F.col(score))
        got = auc(x, by).join(probability_metrics(x, by).drop("n"), list(by))
        return got.select(*by, F.col("n").alias(f"n_{suffix}"), *[F.col(m).alias(f"{m}_{suffix}") for m in ("roc_auc", "average_precision", "brier")])

    out = metrics(a, "a").join(metrics(b, "b").drop("n_b"), list(by)).withColumnRenamed("n_a", "n")
    return out.withColumns({f"delta_{m}": F.col(f"{m}_b") - F.col(f"{m}_a") for m in ("roc_auc", "average_precision", "brier")})


def plan_windows(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Sizes of the training and test sets of each window (cutoff, window_end]."""
    marked = rows.join(small(cutoffs), F.col("announce_date") <= F.col("window_end"))
    train = F.col("resolution_date") <= F.col("cutoff")
    test = (F.col("announce_date") > F.col("cutoff")) & (F.col("announce_date") <= F.col("window_end"))
    return marked.groupBy("cutoff", "window_end").agg(F.count_if(train).alias("n_train"), F.count_if(train & (F.col("label") == 1)).alias("n_train_broken"), F.count_if(test).alias("n_test"))


def outside_cohort(training: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """Training rows that aren't members; must be empty before a model is registered."""
    return training.join(cohort.select(key).distinct(), key, "left_anti")


def session_valid(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekends never; else what the calendar says, and open where it has no row."""
    known = small(calendar.select("obs_date", "is_trading"))
    return days.join(known, "obs_date", "left").withColumn("valid", (F.weekday("obs_date") < 5) & F.coalesce("is_trading", F.lit(True)))


def announcement_eligible(stamp: Column) -> Column:
    """Whether a UTC announcement came strictly before 16:00 in New York."""
    local = F.from_utc_timestamp(stamp, "America/New_York")
    return F.date_format(local, "HH:mm:ss") < "16:00:00"


def event_key(*parts: Column) -> Column:
    return short_hash(*parts, n=16)


def figi_status(candidates: DataFrame) -> DataFrame:
    """MATCHED for one plausible security of an agreeing name, else AMBIGUOUS, NAME_MISMATCH or NO_MATCH."""
    ok = F.col("security_type").isin("Common Stock", "ADR", "REIT")
    agrees = names_agree(F.col("asked_name"), F.col("name"))
    rows = candidates.groupBy("deal_id").agg(F.count_if(ok).alias("n"), F.count_distinct(F.when(ok & agrees, F.col("figi"))).alias("named"), F.min(F.when(ok & agrees, F.col("figi"))).alias("figi"))
    status = F.when(F.col("n") == 0, "NO_MATCH").when(F.col("named") == 0, "NAME_MISMATCH").when(F.col("named") > 1, "AMBIGUOUS").otherwise("MATCHED")
    return rows.select("deal_id", status.alias("status"), F.when(status == "MATCHED", F.col("figi")).alias("figi"))


def latest_rank(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The preferred row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
