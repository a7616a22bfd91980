"""Point-in-time operators over bitemporal facts: a fact counts at T if it was valid and known by T."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import MAX_PRINT_AGE_DAYS, RESOLUTION_EVENTS
from tidemark.functions.dates import age_days
from tidemark.operators.ordering import numbered, running_max, small
from tidemark.storage import checkpointed


def visible(facts: DataFrame, cutoff: Column, valid: str, known: str = "known_at") -> DataFrame:
    """The facts that count at one cut-off."""
    return facts.where((F.col(valid) <= cutoff) & (F.col(known) <= cutoff))


def visible_at(facts: DataFrame, cutoffs: DataFrame, valid: str, known: str = "known_at") -> DataFrame:
    """The facts that count at each of a few cut-offs (column ``cutoff``); the cut-offs are a small broadcast table."""
    return facts.join(small(cutoffs), (F.col(valid) <= F.col("cutoff")) & (F.col(known) <= F.col("cutoff")))


def state_as_of(facts: DataFrame, cutoffs: DataFrame, fields: Sequence[str], order: Sequence[str], valid: str, key: str = "deal_id", stale: dict[str, float] | None = None, provenance: Sequence[str] = ()) -> DataFrame:
    """Per key and cut-off, each field's last non-null value by ``order``, with when it was observed and the columns of
    ``provenance`` of the row it comes from (as ``<field>_<column>``).

    ``stale`` gives the days after which a field's value no longer counts. Facts and cut-offs meet in one sweep over time:
    a fact goes to the first cut-off at which it counts, states are carried from there, and a state is given out for the
    cut-offs until the next one, so the work is that of the facts, the cut-offs and the result.
    """
    usable = facts.where(F.col(valid).isNotNull() & F.col("known_at").isNotNull()).withColumn("_at", F.greatest(valid, "known_at"))
    rows, numbers = at_first_cutoff(usable, cutoffs, "_at")
    place = lambda f: F.when(F.col(f).isNotNull(), F.struct(*order))
    best = rows.groupBy(key, "_i").agg(*[F.max(place(f)).alias(f"_order_{f}") for f in fields], *[F.max_by(F.struct(F.col(f).alias("v"), F.col(valid).alias("at"), *provenance), place(f)).alias(f) for f in fields])
    so_far = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)  # a row for each cut-off at most
    found = until_next(best.select(key, "_i", *[F.max_by(f, f"_order_{f}").over(so_far).alias(f) for f in fields]), [key], numbers)
    out = []
    for f in fields:
        fresh = age_days(F.col("cutoff"), F.col(f)["at"]) <= stale[f] if stale and f in stale else F.lit(True)
        out += [F.when(fresh, F.col(f)["v"]).alias(f), F.col(f)["at"].alias(f"{f}_at"), *[F.when(fresh, F.col(f)[p]).alias(f"{f}_{p}") for p in provenance]]
    return found.select(key, "cutoff", *out)


#: Cut-offs that an expression compares with each row; more of them are sorted together with the rows.
FEW = 64


def at_first_cutoff(rows: DataFrame, cutoffs: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_i``, the number from 0 of the first cut-off at or after their time, without those that have none; and
    the numbered cut-offs (cutoff, _i). Any number of either: beyond a few cut-offs both are sorted together, by ranges of time."""
    days = cutoffs.select("cutoff").where("cutoff is not null").distinct()
    kind = days.schema["cutoff"].dataType
    few = [F.lit(r[0]).cast(kind) for r in days.orderBy("cutoff").limit(FEW + 1).select(F.col("cutoff").cast("string")).collect()]
    if len(few) <= FEW:
        number, nth = F.col("id").alias("_i"), F.get(F.array(*few), F.col("id").cast("int")) if few else F.lit(None).cast(kind)
        numbers = rows.sparkSession.range(len(few)).select(nth.alias("cutoff"), number)
        before = F.size(F.filter(F.array(*few), lambda c: c < F.col(at))) if few else F.lit(0)
        return rows.withColumn("_i", before.cast("long")).where(F.col("_i") < len(few)), numbers
    numbers = checkpointed(numbered(days, [], ["cutoff"], "_i"))
    one = F.lit(0).alias("_one")
    found = as_of_join(rows.select("*", one), numbers.select("*", one, F.col("_i").alias("_last"), F.col("cutoff").alias("_found")), "_one", at, "cutoff", ["_last", "_found"], "_i")
    first = F.when(F.col("_found") == F.col(at), F.col("_last")).otherwise(F.coalesce(F.col("_last") + 1, F.lit(0)))
    return found.select(*rows.columns, first.alias("_i")).where(F.col("_i") < numbers.count()), numbers


def until_next(states: DataFrame, keys: Sequence[str], numbers: DataFrame) -> DataFrame:
    """``states`` (keys, _i, ...) for each cut-off from their own to before the key's next one, as column ``cutoff``."""
    after = F.lead("_i").over(Window.partitionBy(*keys).orderBy("_i"))
    each = states.withColumn("_end", F.coalesce(after, F.lit(numbers.count())) - 1).withColumn("_i", F.explode(F.sequence("_i", "_end")))
    return each.drop("_end").join(small(numbers), "_i").drop("_i")


def latest_vintage(vintages: DataFrame, cutoff: Column, keys: Sequence[str], known: str = "known_at", tie: str = "seq") -> DataFrame:
    """The last vintage known at the cut-off per key; a null vintage hides what it revises."""
    w = Window.partitionBy(*keys).orderBy(F.col(known).desc(), F.col(tie).desc())
    return vintages.where(F.col(known) <= cutoff).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: Sequence[str], tie: str, rank: Sequence[str] | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    ``right_at`` is when a right row can be used first; ``rank`` names the columns that tell which of the usable ones
    is the last, where that isn't the order in which they became usable. Both sides go through one shuffle as a
    union, dealt out by ranges of key and time; each range carries its last right row forward and hands it on to the next,
    so no pairs are made and a key with any number of rows is many tasks.
    """
    row_type = left.select(F.struct("*").alias("x")).schema["x"].dataType
    order = F.struct(*[F.col(x).alias(f"o{i}") for i, x in enumerate(rank or (right_at, tie))])
    r = right.select(F.col(key), F.col(right_at).alias("t"), F.lit(0).alias("side"), F.struct(order.alias("order"), F.struct(*values).alias("v")).alias("found"), F.lit(None).cast(row_type).alias("row"))
    lft = left.select(F.col(key), F.col(at).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(r.schema["found"].dataType).alias("found"), F.struct("*").alias("row"))
    carried = running_max(r.unionByName(lft), [key], ["t", "side"], "found").where("side = 1")
    return carried.select("row.*", *[F.col("found")["v"][v].alias(v) for v in values])


def first_resolution(events: DataFrame, cutoff: Column) -> DataFrame:
    """Per deal its first resolution at the cut-off, and the label: 1 broken, 0 closed, null censored."""
    seen = visible(events, cutoff, "event_at")
    first = seen.groupBy("deal_id").agg(F.min_by("event_type", F.when(F.col("event_type").isin(*RESOLUTION_EVENTS), F.struct("event_at", "seq"))).alias("resolution"), F.min(F.when(F.col("event_type").isin(*RESOLUTION_EVENTS), F.col("event_at"))).alias("resolved_at"))
    return first.withColumn("label", F.when(F.col("resolution") == "closing", 0).when(F.col("resolution").isNotNull(), 1))


def feature_dates(events: DataFrame, cutoff: Column) -> DataFrame:
    """Per deal when its first visible announcement was both valid and known."""
    seen = visible(events, cutoff, "event_at").where("event_type = 'announcement'")
    return seen.groupBy("deal_id").agg(F.min_by(F.greatest("event_at", "known_at"), F.struct("event_at", "seq")).alias("feature_at"))


def training_disposition(deals: DataFrame, events: DataFrame, cutoff: Column) -> DataFrame:
    """Each deal as eligible, censored or excluded, with the reason; rules apply in this order."""
    rows = deals.join(feature_dates(events, cutoff), "deal_id", "left").join(first_resolution(events, cutoff), "deal_id", "left")
    reason = (
        F.when(F.col("feature_at").isNull(), "no_known_announcement")
        .when(F.col("feature_at") > cutoff, "feature_date_after_cutoff")
        .when(F.col("label").isNull(), "censored")
        .when(F.col("feature_at") >= F.col("resolved_at"), "feature_date_not_before_resolution")
    )
    kind = F.when(reason.isNull(), "eligible").when(reason == "censored", "censored").otherwise("excluded")
    return rows.select("deal_id", "feature_at", "label", kind.alias("disposition"), F.when(reason != "censored", reason).alias("reason"))


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """Resolutions before their deal's first announcement, or without one."""
    first = F.min(F.when(F.col("event_type") == "announcement", F.col("event_at"))).over(Window.partitionBy("deal_id"))
    return events.withColumn("announced_at", first).where(F.col("event_type").isin(*RESOLUTION_EVENTS) & (F.col("announced_at").isNull() | (F.col("event_at") < F.col("announced_at"))))


def print_series(observations: DataFrame, cutoff: Column, vol_window: int = 5, key: str = "deal_id") -> DataFrame:
    """Visible target prints with the offer known by each: spread, its change against the last spread, rolling volatility."""
    seen = visible(observations, cutoff, "observed_at")
    prints = seen.where("target_price is not null").select(key, "seq", "observed_at", "known_at", "target_price")
    offers = seen.where("offer_price is not null").select(
        key, F.greatest("observed_at", "known_at").alias("usable_at"), F.col("observed_at").alias("offer_at"), F.col("known_at").alias("offer_known_at"), F.col("seq").alias("offer_seq"), "offer_price"
    )
    rows = as_of_join(prints, offers, key, "observed_at", "usable_at", ["offer_price"], "offer_seq", rank=["offer_at", "offer_known_at", "offer_seq"])
    w = Window.partitionBy(key).orderBy("observed_at", "seq")
    spread = F.try_divide(F.col("offer_price") - F.col("target_price"), F.col("target_price"))
    rows = rows.withColumn("spread", spread)
    rows = rows.withColumn("delta", F.col("spread") - F.last("spread", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    recent = w.rowsBetween(-(vol_window - 1), 0)
    least = max(2, min(3, vol_window))
    return rows.withColumn("delta_vol", F.when(F.count("delta").over(recent) >= least, F.stddev_samp("delta").over(recent)))



def spread_panel(observations: DataFrame, events: DataFrame, cutoff: Column, vol_window: int = 5, least_prints: int = 3) -> DataFrame:
    """Per deal of ``events`` its spread features at its last visible print, its label at the cut-off, and what becomes of it.

    Features use only what was known by the feature time; a deal without a print takes its announcement's. A deal is
    eligible, censored or excluded with a reason; rules apply in the order they stand in.
    """
    last = F.max(F.when(F.col("target_price").isNotNull(), F.col("observed_at"))).over(Window.partitionBy("deal_id"))
    seen = visible(observations, cutoff, "observed_at").withColumn("print_at", last)
    own = seen.where((F.col("observed_at") <= F.col("print_at")) & (F.col("known_at") <= F.col("print_at"))).drop("print_at")
    newest = F.max_by(F.struct("spread", "delta", "delta_vol"), F.struct("observed_at", "seq")).alias("x")
    features = print_series(own, cutoff, vol_window).groupBy("deal_id").agg(F.count("*").alias("n_prints"), F.count("delta").alias("n_delta"), newest)
    times = seen.groupBy("deal_id").agg(F.first("print_at", ignorenulls=True).alias("print_at"))
    rows = events.select("deal_id").distinct()
    for more in (times, feature_dates(events, cutoff), features, first_resolution(events, cutoff)):
        rows = rows.join(more, "deal_id", "left")
    at, n = F.coalesce("print_at", "feature_at"), F.coalesce("n_prints", F.lit(0))
    reason = (
        F.when(at.isNull(), "no_known_announcement")
        .when(at > cutoff, "feature_after_cutoff")
        .when(n < least_prints, "insufficient_price_history")
        .when(F.col("label").isNull(), "censored")
        .when(at >= F.col("resolved_at"), "feature_not_before_resolution")
    )
    kind = F.when(reason.isNull(), "eligible").when(reason == "censored", "censored").otherwise("excluded")
    return rows.select("deal_id", at.alias("feature_at"), n.alias("n_prints"), F.coalesce("n_delta", F.lit(0)).alias("n_delta"), "x.spread", "x.delta", "x.delta_vol", "label", kind.alias("disposition"), F.when(reason != "censored", reason).alias("reason"))


def panel_diagnostic(panel: DataFrame, least_of_class: int = 2) -> DataFrame:
    """Sizes of a panel and why it can't be used, if so: feature times at resolutions come before small classes."""
    fine = F.col("disposition") == "eligible"
    sizes = panel.agg(
        F.count_if(fine).alias("n"), F.count_if(fine & (F.col("label") == 1)).alias("n_pos"), F.count_if(fine & (F.col("label") == 0)).alias("n_neg"), F.count_if(F.col("disposition") == "censored").alias("n_censored"),
        F.count_if(F.col("reason") == "insufficient_price_history").alias("n_thin"), F.count_if(F.col("reason") == "feature_not_before_resolution").alias("n_collision"),
    )
    why = F.when(F.col("n_collision") > 0, "FEATURE_TIME_RESOLUTION_TIMESTAMP_COLLISION").when(F.least("n_pos", "n_neg") < least_of_class, "CLASS_BALANCE_BELOW_MIN_CLASS_N")
    return sizes.withColumns({"block_reason": why, "valid": why.isNull()})


STALE_PRINT = {"target_price": MAX_PRINT_AGE_DAYS}
