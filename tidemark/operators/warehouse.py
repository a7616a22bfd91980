"""Warehouse projections: date dimension, deal state facts, satellites with versions, marts, invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.dates import date_key, quarter_label
from tidemark.operators.ordering import small

OPEN_END = "9999-12-31"


def dim_date(calendar: DataFrame) -> DataFrame:
    day = F.col("obs_date")
    return calendar.select(date_key(day).alias("date_key"), "obs_date", F.year(day).alias("year"), quarter_label(day).alias("quarter"), F.month(day).alias("month"), F.date_format(day, "EEEE").alias("day_name"), "is_trading")


def fact_deal_state(deals: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per deal: surrogate key, date key of the announcement (null if it isn't in the dimension), censoring flag."""
    days = small(dim.select(F.col("obs_date").alias("announce_date"), "date_key"))
    key = F.md5(F.concat(F.col("deal_id").cast("string"), F.lit("|"), F.coalesce(F.date_format("announce_date", "yyyy-MM-dd"), F.lit(""))))
    return deals.join(days, "announce_date", "left").select("deal_id", key.alias("deal_state_key"), "date_key", "status", (F.col("status") == "pending").alias("is_censored"), "p_break")


def mart_scorecard(deals: DataFrame) -> DataFrame:
    """Label and squared error per deal; both null while the deal is pending."""
    label = F.when(F.col("status") == "broken", 1).when(F.col("status") == "closed", 0)
    return deals.withColumn("label", label).select("deal_id", "status", "p_break", "label", ((F.col("p_break") - F.col("label")) * (F.col("p_break") - F.col("label"))).alias("squared_error"))


def scd2(snapshots: DataFrame, key: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """Versions of each key: a new one opens where the attributes' hash changes and closes the one before."""
    w = Window.partitionBy(key).orderBy(at)
    text = [F.coalesce(F.col(a).cast("string"), F.lit("__NULL__")) for a in attributes]
    hashed = snapshots.withColumn("hash_diff", F.md5(F.concat_ws("|", *text)))
    starts = hashed.withColumn("before", F.lag("hash_diff").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("hash_diff")))
    following = F.lead(at).over(w)
    return starts.select(key, *attributes, "hash_diff", F.col(at).alias("valid_from"), F.coalesce(following, F.lit(OPEN_END).cast(snapshots.schema[at].dataType)).alias("valid_to"), following.isNull().alias("is_current"))


def scd2_seen(snapshots: DataFrame, key: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """``scd2`` with ``last_seen``, a key's last snapshot, on its current version; null on closed ones."""
    return _seen(scd2(snapshots, key, at, attributes), snapshots.select(key, at), key, at)


def _seen(versions: DataFrame, times: DataFrame, key: str, at: str) -> DataFrame:
    last = times.groupBy(key).agg(F.max(at).alias("_last"))
    return versions.join(last, key).withColumn("last_seen", F.when(F.col("is_current"), F.col("_last"))).drop("_last")


def scd2_merged(versions: DataFrame, snapshots: DataFrame, key: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """``versions`` of ``scd2_seen`` after more snapshots: what ``scd2_seen`` makes of the old and the new ones together.

    Only a key's current version and its new snapshots meet; versions that are closed pass by. Snapshots up to a key's
    ``last_seen`` are left out, so a batch that is run again changes nothing; ``late_snapshots`` tells those that say
    something else. Keys aren't null and have one snapshot a time.
    """
    current = versions.where("is_current")
    seen = current.select(key, F.col("last_seen").alias("_seen"))
    later = snapshots.join(seen, key, "left").where(F.col("_seen").isNull() | (F.col(at) > F.col("_seen"))).select(key, at, *attributes)
    fresh = scd2(current.select(key, F.col("valid_from").alias(at), *attributes).unionByName(later), key, at, attributes)
    times = current.select(key, F.col("last_seen").alias(at)).unionByName(later.select(key, at))
    return versions.where("not is_current").unionByName(_seen(fresh, times, key, at))


def late_snapshots(versions: DataFrame, snapshots: DataFrame, key: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """Snapshots not after their key's ``last_seen`` that differ from the version of their time, or precede them all."""
    seen = versions.where("is_current").select(key, F.col("last_seen").alias("_seen"))
    text = [F.coalesce(F.col(a).cast("string"), F.lit("__NULL__")) for a in attributes]
    old = snapshots.join(seen, key).where(F.col(at) <= F.col("_seen")).withColumn("hash_diff", F.md5(F.concat_ws("|", *text)))
    known = versions.select(F.col(key).alias("_k"), F.col("hash_diff").alias("_h"), "valid_from", "valid_to")
    same = (F.col(key) == F.col("_k")) & (F.col("hash_diff") == F.col("_h")) & (F.col(at) >= F.col("valid_from")) & (F.col(at) < F.col("valid_to"))
    return old.join(known, same, "left_anti").select(*snapshots.columns)


def incremental_append(existing: DataFrame, batch: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """What a batch adds: the first row of each key that isn't there yet."""
    w = Window.partitionBy(*key).orderBy(tie)
    first = batch.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return first.join(existing.select(*key), list(key), "left_anti")


def data_quality(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and distinct values of each column, from one aggregation."""
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(F.col(c)).alias("distinct")).alias(c) for c in columns]
    one = rows.agg(F.count("*").alias("n_rows"), *parts)
    return one.select("n_rows", F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("x")).select("n_rows", "x.*")


def invariants(deals: DataFrame, gated: DataFrame, calendar: DataFrame, mart: DataFrame) -> dict[str, DataFrame]:
    """Rules as DataFrames that must be empty."""
    return {
        "no_prices_on_non_trading_days": gated.join(small(calendar.where("not is_trading").select("obs_date")), "obs_date", "left_semi").select("series_id", "obs_date"),
        "pending_deals_are_censored": mart.where("status = 'pending' and squared_error is not null").select("deal_id"),
        "pending_has_no_realized_label": mart.where("status = 'pending' and label is not null").select("deal_id"),
        "resolution_not_before_announce": deals.where("resolution_date < announce_date").select("deal_id"),
        "no_lookahead_order": deals.where("status = 'pending' and resolution_date is not null").select("deal_id"),
        "no_fabricated_prices": gated.where("close is not null and isnan(close)").select("series_id", "obs_date"),
    }
