"""Market features that were knowable at a cut-off: levels, returns, changes and a spread of two series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import MAX_PRINT_AGE_DAYS


def last_two_prints(vintages: DataFrame) -> DataFrame:
    """Per series the last two non-null values: v1, v2 and their days d1, d2 (v2 null if there is one only)."""
    w = Window.partitionBy("series_id").orderBy(F.col("obs_date").desc())
    rows = vintages.where("value is not null").withColumn("k", F.row_number().over(w)).where("k <= 2")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return rows.groupBy("series_id").agg(pick("value", 1).alias("v1"), pick("value", 2).alias("v2"), pick("obs_date", 1).alias("d1"), pick("obs_date", 2).alias("d2"))


def series_features(vintages: DataFrame) -> DataFrame:
    """level, simple_return and change per series as rows; null where a print is missing or the earlier one is 0."""
    two = last_two_prints(vintages)
    rows = F.array(
        F.struct(F.lit("level").alias("feature"), F.col("v1").alias("value")),
        F.struct(F.lit("simple_return").alias("feature"), (F.try_divide("v1", "v2") - 1).alias("value")),
        F.struct(F.lit("change").alias("feature"), (F.col("v1") - F.col("v2")).alias("value")),
    )
    return two.select("series_id", F.col("d1").alias("obs_date"), F.explode(rows).alias("x")).select("series_id", "obs_date", "x.*")


def common_spread(vintages: DataFrame, a: str, b: str) -> DataFrame:
    """b - a on the latest day on which both have a value."""
    side = lambda s, n: vintages.where((F.col("series_id") == s) & F.col("value").isNotNull()).select("obs_date", F.col("value").alias(n))
    both = side(a, "a").join(side(b, "b"), "obs_date")
    return both.agg(F.max_by(F.struct("obs_date", (F.col("b") - F.col("a")).alias("spread")), "obs_date").alias("r")).select("r.*").where("obs_date is not null")


def snapshot(context: DataFrame, cutoff: Column, max_age: float = MAX_PRINT_AGE_DAYS) -> DataFrame:
    """Per field the latest value at the cut-off, null if that is older than ``max_age`` days (an older, fresher one is not looked for)."""
    seen = context.where(F.col("at") <= cutoff)
    last = seen.groupBy("field").agg(F.max_by(F.struct("at", "value"), F.struct("at", "seq")).alias("r"))
    age = (F.unix_micros(cutoff.cast("timestamp")) - F.unix_micros(F.col("r.at").cast("timestamp"))) / 86400e6
    return last.select("field", F.col("r.at").alias("at"), F.when(age <= max_age, F.col("r.value")).alias("value"))


def first_knowable(pulls: DataFrame) -> DataFrame:
    """Of pulls of the same (field, at, source) the one knowable first."""
    return pulls.groupBy("field", "at", "source").agg(F.min_by("value", F.struct("known_at", "seq")).alias("value"), F.min("known_at").alias("known_at"))
