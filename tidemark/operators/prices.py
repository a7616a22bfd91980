"""Prices from several providers: identity, fallback, reconciliation, admission; snapshot policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import RECONCILE_RULES, SNAPSHOT_POLICIES
from tidemark.functions.finance import price_agreement
from tidemark.operators.ordering import BROADCAST_BYTES, measured, small
from tidemark.storage import checkpointed

MIN_PRINTS = 3
#: Statuses after which the next provider is asked; an ambiguous identity stops the chain.
FALLBACK = ("NO_HISTORY", "SYMBOL_NOT_FOUND", "DELISTED_UNAVAILABLE", "IDENTITY_UNRESOLVED", "CREDENTIALS_REQUIRED")
STOPS = ("IDENTITY_AMBIGUOUS",)


def reconcile(prints: DataFrame, rule: str = "price_reconcile_v2") -> DataFrame:
    """Sessions of two providers side by side, each as EXACT, TOLERABLE, CONFLICT, A_ONLY or B_ONLY; never averaged."""
    a = prints.where("provider = 'a'").select("deal_id", "session_date", F.col("close").alias("close_a"))
    b = prints.where("provider = 'b'").select("deal_id", "session_date", F.col("close").alias("close_b"))
    both = a.join(b, ["deal_id", "session_date"], "full_outer")
    agreed = price_agreement(F.col("close_a"), F.col("close_b"), *RECONCILE_RULES[rule])
    return both.withColumn("agreement", F.when(F.col("close_b").isNull(), "A_ONLY").when(F.col("close_a").isNull(), "B_ONLY").otherwise(agreed))


def reconcile_totals(sessions: DataFrame) -> DataFrame:
    kinds = ("EXACT", "TOLERABLE", "CONFLICT", "A_ONLY", "B_ONLY")
    return sessions.groupBy("deal_id").agg(F.count("*").alias("sessions"), *[F.count_if(F.col("agreement") == k).alias(k.lower()) for k in kinds])


def proofs() -> Column:
    """Affirmative proofs of identity."""
    return F.array_compact(
        F.array(
            F.when(F.col("openfigi_status") == "MATCHED", "A_OPENFIGI_MATCHED"),
            F.when(F.col("tiingo_identity_verified"), "B_TIINGO_NAME_AND_LISTING_WINDOW"),
            F.when(F.col("identity_basis") == "reviewed_sec_mapping", "C_REVIEWED_SEC_MAPPING"),
        )
    )


def admission(rows: DataFrame) -> DataFrame:
    """Each deal's admission status, the reason where it is deferred, and the proofs; the order of the rules is their meaning."""
    p = F.col("proofs")
    has = lambda x: F.array_contains(p, x)
    veto = F.when(F.col("openfigi_status").isin("AMBIGUOUS", "NAME_MISMATCH"), F.concat(F.lit("OPENFIGI_"), F.col("openfigi_status"))).when(F.col("tiingo_status") == "IDENTITY_AMBIGUOUS", "TIINGO_IDENTITY_AMBIGUOUS")
    vetoed = veto.isNotNull() & ~has("C_REVIEWED_SEC_MAPPING")
    reused = (F.col("tiingo_n") == 0) & (F.col("yahoo_n") > 0) & ~F.col("yahoo_identity_verified") & ~has("A_OPENFIGI_MATCHED") & ~has("B_TIINGO_NAME_AND_LISTING_WINDOW")
    status = (
        F.when(F.col("infrastructure_failed"), None)
        .when(vetoed, "DEFERRED_IDENTITY")
        .when(F.col("material_conflicts") > 0, "DEFERRED_PRICE_CONFLICT")
        .when((F.col("tiingo_n") == 0) & (F.col("yahoo_n") == 0), "NO_PRICE_HISTORY")
        .when(reused | (F.size(p) == 0), "DEFERRED_IDENTITY")
        .when(F.col("combined_n") >= MIN_PRINTS, "CANONICALLY_ADMITTED")
        .otherwise("INSUFFICIENT_CANONICAL_PRINTS")
    )
    reason = F.when(F.col("infrastructure_failed"), "UNRESOLVED_INFRASTRUCTURE").when(vetoed, veto).when(F.col("status") != "DEFERRED_IDENTITY", None).when(reused, "YAHOO_TICKER_REUSE_UNVALIDATED").otherwise("DEFER_IDENTITY_UNCONFIRMED")
    return rows.withColumn("proofs", proofs()).withColumn("status", status).withColumn("reason", F.when(F.col("infrastructure_failed") | (F.col("status") == "DEFERRED_IDENTITY"), reason))


def gap_class(admitted: DataFrame) -> DataFrame:
    """Why a deal has the coverage it has."""
    t, y = F.col("tiingo_n"), F.col("yahoo_n")
    mix = F.when((t >= MIN_PRINTS) & (y >= MIN_PRINTS), "MULTI_PROVIDER_CONFIRMED").when(t >= MIN_PRINTS, "TIINGO_COVERED").when((y >= MIN_PRINTS) & (t == 0), "YAHOO_ONLY").when((t == 0) & (y == 0), "NO_PUBLIC_PRICE_HISTORY").otherwise("OTHER")
    none = F.when(F.col("tiingo_status") == "SYMBOL_NOT_FOUND", "TIINGO_NO_SYMBOL").when(F.col("tiingo_status").isin("NO_HISTORY", "ok"), "TIINGO_NO_HISTORY").when(F.col("tiingo_status") == "TRANSIENT_FAILURE", "PROVIDER_TRANSIENT_FAILURE").otherwise("NO_PUBLIC_PRICE_HISTORY")
    kind = (
        F.when(F.col("status") == "CANONICALLY_ADMITTED", mix)
        .when(F.col("reason") == "YAHOO_TICKER_REUSE_UNVALIDATED", F.col("reason"))
        .when((F.col("status") == "DEFERRED_PRICE_CONFLICT") | (F.col("material_conflicts") > 0), "DEFER_PRICE_CONFLICT")
        .when(F.col("status") == "NO_PRICE_HISTORY", none)
        .when(F.col("openfigi_status") == "AMBIGUOUS", "SECURITY_IDENTITY_AMBIGUOUS")
        .when(F.col("openfigi_status") == "NAME_MISMATCH", "SECURITY_IDENTITY_NAME_MISMATCH")
        .when(F.col("tiingo_status") == "IDENTITY_AMBIGUOUS", "SECURITY_IDENTITY_AMBIGUOUS")
        .when(((t > 0) | (y > 0)) & (F.size("proofs") == 0), "DEFER_IDENTITY_UNCONFIRMED")
        .when(F.col("openfigi_status") == "NO_MATCH", "OPENFIGI_NO_MATCH")
        .otherwise(mix)
    )
    return admitted.withColumn("gap_class", kind)


def fallback_choice(attempts: DataFrame) -> DataFrame:
    """The provider that serves each deal: the first that is ok, unless one before it stops the chain."""
    stop = F.min(F.when(F.col("status").isin(*STOPS), F.col("place")))
    ok = F.min(F.when(F.col("status") == "ok", F.col("place")))
    rows = attempts.groupBy("deal_id").agg(stop.alias("stop"), ok.alias("ok"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "provider", "status"))), lambda x: F.concat(x["provider"], F.lit(":"), x["status"])), ",").alias("trace"))
    serves = F.col("ok").isNotNull() & (F.col("stop").isNull() | (F.col("ok") < F.col("stop")))
    return rows.select("deal_id", F.when(serves, F.col("ok")).alias("chosen_place"), F.when(serves, "OK").when(F.col("stop").isNotNull(), "IDENTITY_AMBIGUOUS").otherwise("NO_HISTORY").alias("result"), "trace")


def sessions_numbered(calendar: DataFrame) -> DataFrame:
    """Sessions with their ordinals; a calendar is small, one row per day."""
    return calendar.where("is_trading").select("obs_date", F.row_number().over(Window.orderBy("obs_date")).alias("ordinal"))


def snapshot_days(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """``announce_date`` (distinct) -> the same and ``found``, an array of policy, offset, feature date and the policy's place among all (from 1); days without any are left out."""
    sessions = sessions_numbered(calendar)
    passed = F.count("ordinal").over(Window.orderBy("obs_date"))  # a calendar is small, one row per day
    from_days = calendar.select("obs_date").join(sessions, "obs_date", "left").select(F.col("obs_date").alias("from_day"), passed.alias("passed"))
    each = [F.struct(F.lit(name).alias("policy"), F.lit(kind == "days").alias("in_days"), F.lit(n).alias("after"), F.lit(i).alias("place")) for i, (name, (kind, offsets)) in enumerate(SNAPSHOT_POLICIES.items(), 1) for n in offsets]
    rows = days.select("announce_date", F.explode(F.array(*each)).alias("p")).select("announce_date", "p.*")
    rows = rows.withColumn("from_day", F.when(F.col("in_days"), F.date_add("announce_date", F.col("after") - 1)).otherwise(F.col("announce_date")))
    placed = rows.join(small(from_days), "from_day").withColumn("ordinal", F.col("passed") + F.when(F.col("in_days"), 1).otherwise(F.col("after")))
    found = placed.join(small(sessions.withColumnRenamed("obs_date", "feature_date")), "ordinal")
    return found.groupBy("announce_date").agg(F.collect_list(F.struct("policy", "after", "feature_date", "place")).alias("found"))


def with_snapshots(deals: DataFrame, calendar: DataFrame) -> DataFrame:
    """``deals`` that have a snapshot, with ``found`` as in ``snapshot_days``: it depends on nothing but the announcement's day."""
    days = checkpointed(snapshot_days(deals.select("announce_date").distinct(), calendar))
    return deals.join(F.broadcast(days) if measured(days) <= BROADCAST_BYTES else days, "announce_date")


def snapshot_rows(deals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per deal, policy and offset its feature date, counted from the announcement day alone, and whether it is pending then.

    A session policy takes the nth session after the announcement's day; a calendar policy the first session at or after
    so many days. The resolution chooses no date: it only tells which snapshots are censored. Dates beyond the calendar
    are left out.
    """
    found = with_snapshots(deals, calendar).select("deal_id", "announce_date", "resolution_date", F.explode("found").alias("f")).select("*", "f.*")
    return found.select("deal_id", "policy", "after", "announce_date", "feature_date", (F.col("resolution_date").isNull() | (F.col("feature_date") < F.col("resolution_date"))).alias("pending"))


def deal_equal_weight(rows: DataFrame) -> DataFrame:
    """A weight per snapshot row such that in a policy every deal counts alike and all sum to one."""
    per = rows.groupBy("policy", "deal_id").agg(F.count("*").alias("k"))
    n = per.groupBy("policy").agg(F.count("*").alias("n_deals"))
    return rows.join(per, ["policy", "deal_id"]).join(small(n), "policy").withColumn("weight", 1.0 / (F.col("n_deals") * F.col("k"))).drop("k", "n_deals")


def _of_policy(name: str) -> Callable[[Column], Column]:
    return lambda x: x["policy"] == name


def snapshot_weights(deals: DataFrame, calendar: DataFrame) -> DataFrame:
    """``deal_id, policy, after, weight``: ``deal_equal_weight`` of ``snapshot_rows``, of which no row is moved or counted.

    What a row of ``deals`` has in a policy is counted for its day, and summed over the rows that repeat its deal; rows are
    made of it last. Only the deals are dealt out, by their id. Rows without one stay, and count as no deal.
    """
    own = [f"_k{i}" for i in range(len(SNAPSHOT_POLICIES))]
    deals = deals.select("deal_id", "announce_date")
    days = checkpointed(snapshot_days(deals.select("announce_date").distinct(), calendar))
    days = F.broadcast(days) if measured(days) <= BROADCAST_BYTES else days
    counts = days.select("announce_date", *[F.size(F.filter("found", _of_policy(p))).alias(k) for p, k in zip(SNAPSHOT_POLICIES, own)])
    counted = deals.join(counts, "announce_date")
    n = counted.where("deal_id is not null").groupBy("deal_id").agg(*[F.max(F.col(k) > 0).alias(k) for k in own]).agg(*[F.count_if(k).alias(f"_n{k}") for k in own])
    each = counted.withColumns({k: F.sum(k).over(Window.partitionBy("deal_id")) for k in own}).crossJoin(F.broadcast(n))
    weights = F.array(*[F.when(F.col(k) > 0, 1.0 / (F.col(f"_n{k}") * F.col(k))) for k in own])
    rows = each.select("deal_id", "announce_date", weights.alias("_w")).join(days, "announce_date").select("deal_id", "_w", F.explode("found").alias("f"))
    return rows.select("deal_id", "f.policy", "f.after", F.element_at("_w", F.col("f.place")).alias("weight"))


def grouped_split(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Train before the cut-off, test after, by the deal's announcement, so no deal is on both sides."""
    return rows.withColumn("split", F.when(F.col("announce_date") < cutoff, "train").otherwise("test"))
