"""Filings, identities and evidence under review: reading order, windows, authorities, ledger rules; calibration and report charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import MIN_SAMPLE_N
from tidemark.functions.finance import logit, sigmoid
from tidemark.functions.text import url_host
from tidemark.operators import isotonic

#: Forms that a reviewer reads after the current reports.
PROXY_FORMS = ("DEFM14A", "PREM14A", "S-4", "S-4/A", "SC TO-T", "SC 13E-3", "SC 13E3")
LOOKBACK_DAYS = 365


def item_list(items: Column) -> Column:
    """The items of a filing as an array."""
    return F.filter(F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def preferred_filings(filings: DataFrame, key: str = "deal_id") -> DataFrame:
    """Reading order of a deal's filings: agreements in current reports, other current reports, proxies, the rest; then date and accession."""
    current = F.col("form").isin("8-K", "8-K/A")
    rank = F.when(current & F.array_contains(item_list(F.col("items")), "1.01"), 0).when(current, 1).when(F.col("form").isin(*PROXY_FORMS), 2).otherwise(3)
    w = Window.partitionBy(key).orderBy(rank, F.coalesce("filed", F.lit("0001-01-01").cast("date")), F.coalesce("accession", F.lit("")))
    return filings.withColumn("place", F.row_number().over(w))


def contemporaneous(filed: Column, announced: Column, resolved: Column) -> Column:
    """Whether a filing lies between a year before the announcement and the resolution (or the announcement, if later)."""
    return F.coalesce(filed.between(F.date_sub(announced, LOOKBACK_DAYS), F.greatest(announced, resolved)), F.lit(False))


def listing_covers(start: Column, end: Column, announced: Column) -> Column:
    """Whether a security was listed at the announcement; an unknown start is no proof, an unknown end is open."""
    return F.coalesce(start <= announced, F.lit(False)) & F.coalesce(end >= announced, F.lit(True))


def traded_close(flag: Column) -> Column:
    """Whether a price flag stands for a traded close; unknown flags don't."""
    return F.coalesce(flag, F.lit("")).isin("", " ", "T")


def in_window(at: Column, start: Column, end: Column) -> Column:
    """After ``start`` and at ``end`` at the latest."""
    return (at > start) & (at <= end)


def authorities(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """The registered authority of each row's ``url``: the entry that is its host or the longest that its host ends in.

    A host has few suffixes; they are joined by equality, so no row meets the whole registry.
    """
    parts = F.split(url_host(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    pairs = pages.withColumn("domain", F.explode(suffixes)).join(registry.select("domain", "authority"), "domain")
    best = pairs.groupBy("page_id").agg(F.max_by("authority", F.length("domain")).alias("authority"))
    return pages.select("page_id", "url").join(best, "page_id", "left")


def ledger_violations(records: DataFrame) -> DataFrame:
    """Every rule of the ledger that each record (evidence_id, event_id, source_url, stance, statement, publisher, revises) breaks.

    Ids are unique, and so are event, source, stance and what is revised together; a statement belongs to one cluster;
    a revision names a record of its own cluster and publisher. Counts are aggregated before they are joined, so a
    popular key is no group in one task.
    """
    same = ["event_id", "source_url", "stance", "revised"]
    rows = records.withColumn("revised", F.coalesce(F.col("revises").cast("string"), F.lit("")))
    ids = rows.groupBy("evidence_id").agg(F.count("*").alias("n_id"))
    keys = rows.groupBy(*same).agg(F.count("*").alias("n_key"))
    homes = rows.where("statement is not null").groupBy("statement").agg((F.min("event_id") != F.max("event_id")).alias("spread_out"))
    targets = rows.groupBy(F.col("evidence_id").alias("revises")).agg(F.min("event_id").alias("their_event"), F.min("publisher").alias("their_publisher"))
    rows = rows.join(ids, "evidence_id").join(keys, same).join(homes, "statement", "left").join(targets, "revises", "left")
    revision = F.col("revises").isNotNull()
    rules = {
        "duplicate_id": F.col("n_id") > 1,
        "duplicate_evidence": F.col("n_key") > 1,
        "statement_in_two_clusters": F.col("spread_out"),
        "unknown_revision_target": revision & F.col("their_event").isNull(),
        "revision_of_other_cluster": revision & (F.col("their_event") != F.col("event_id")),
        "revision_of_other_publisher": revision & (F.col("their_publisher") != F.col("publisher")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select("evidence_id", F.array_join(broken, ";").alias("violations")).where("violations <> ''")


def calibrated(sample: DataFrame, rows: DataFrame, score: str = "p_break") -> DataFrame:
    """``rows`` with ``p_calibrated`` and ``method``, learnt on an earlier ``sample`` with ``label``.

    Isotonic from 200 rows with 20 of each class (``isotonic.fitted``), a logit of the logit from the minimum sample with 5
    of each class, else the score itself. A null or NaN score has no calibrated one.
    """
    known = sample.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col("label").isNotNull()).select(F.col(score).cast("double").alias("s"), F.col("label").cast("double").alias("label"))
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    fewest = min(pos, n - pos)
    usable = rows.withColumn("s", F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double")))
    if n >= 200 and fewest >= 20:
        fit = isotonic.predicted(isotonic.fitted(known, "s", "label"), usable.where("s is not null"), "s", "p_iso")
        out = fit.withColumn("p_calibrated", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p_iso")))).drop("p_iso")
        method = "isotonic"
    elif n >= MIN_SAMPLE_N and fewest >= 5:
        features = VectorAssembler(inputCols=["z"], outputCol="zv")
        model = LogisticRegression(featuresCol="zv", labelCol="label", regParam=1 / (1e6 * n), standardization=False, maxIter=200).fit(features.transform(known.withColumn("z", logit(F.col("s")))))
        a, b = float(model.coefficients[0]), float(model.intercept)
        out, method = usable.where("s is not null").withColumn("p_calibrated", sigmoid(logit(F.col("s")) * a + b)), "platt"
    else:
        out, method = usable.where("s is not null").withColumn("p_calibrated", F.col("s")), "none"
    missing = usable.where("s is null").withColumn("p_calibrated", F.lit(None).cast("double"))
    return out.unionByName(missing).drop("s").withColumn("method", F.lit(method))


def report_charts(records: DataFrame, charts: Sequence[tuple[str, ...]]) -> DataFrame:
    """Counts of several charts, each over its own columns, in one pass: ``chart`` names the columns, ``bucket`` their values."""
    columns = sorted({c for chart in charts for c in chart})
    sets = [[F.col(c) for c in chart] for chart in charts]
    which = F.array_join(F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])), " x ")
    value = F.array_join(F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit("?"))) for c in columns])), " | ")
    return records.groupingSets(sets, *[F.col(c) for c in columns]).agg(which.alias("chart"), value.alias("bucket"), F.count("*").alias("n")).select("chart", "bucket", "n")
