"""Isotonic fit by ranges of the score: each range pools its own blocks, then only blocks that ranges dispute are pooled together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordering import running_max
from tidemark.operators.pit import as_of_join
from tidemark.storage import checkpointed

#: A block: its least and greatest score, the sum of its labels, its rows.
BLOCK = ["first", "last", "y", "n"]
KINDS = "first double, last double, y long, n long"


def pooled(rows: Iterable[tuple[float, float, int, int]], blocks: list[list]) -> None:
    """Adds ``rows``, in order of score, to ``blocks`` whose means rise; adjacent violators become one. Means are compared as whole numbers."""
    for first, last, y, n in rows:
        while blocks and blocks[-1][2] * n >= y * blocks[-1][3]:
            before = blocks.pop()
            first, y, n = before[0], before[2] + y, before[3] + n
        blocks.append([first, last, y, n])


def of_ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of a task's range, each with the one's mean before it."""
    blocks, here = [], None
    for part in parts:
        if len(part):
            here = int(part["range"].iloc[0])
        pooled(zip(*[part[c].tolist() for c in BLOCK]), blocks)
    if blocks:
        out = pd.DataFrame(blocks, columns=BLOCK).assign(range=here)
        yield out.assign(before=(out["y"] / out["n"]).shift().astype("Float64"))


def of_segment(part: pd.DataFrame) -> pd.DataFrame:
    blocks: list[list] = []
    part = part.sort_values("first")
    pooled(zip(*[part[c].tolist() for c in BLOCK]), blocks)
    return pd.DataFrame(blocks, columns=BLOCK)


def fitted(sample: DataFrame, score: str, label: str) -> DataFrame:
    """The steps of the least-squares fit that never falls with the score: first, last, y, n and value, one row a block.

    ``label`` is 0 or 1; rows with a null label or a null or NaN score take no part, equal scores are one point. No rows,
    no steps; steps of equal value may stay apart at the end of a range. Where no mean to the left of a place is above one to its right, the fit of the whole is that of both sides
    by themselves. Such places are found from each range's least and greatest mean, a row a range, and cut the blocks into
    segments; a segment of one block is done, others are pooled by themselves. So where labels rise with the score nearly
    every place is a cut, and where they don't the ranges have few blocks. What a task holds is the blocks of its range or
    segment, never rows.
    """
    known = sample.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    points = known.groupBy((F.col(score).cast("double") + F.lit(0.0)).alias("first")).agg(F.sum(F.col(label).cast("long")).alias("y"), F.count("*").alias("n"))
    ranged = points.withColumn("last", F.col("first")).repartitionByRange("first").sortWithinPartitions("first").withColumn("range", F.spark_partition_id())
    blocks = checkpointed(ranged.mapInPandas(of_ranges, f"{KINDS}, range int, before double"))
    mean = F.col("y") / F.col("n")
    spans = blocks.groupBy("range").agg(F.min(mean).alias("least"), F.max(mean).alias("most"))
    place = Window.orderBy("range")
    outside = spans.select(
        "range", F.max("most").over(place.rowsBetween(Window.unboundedPreceding, -1)).alias("most_left"), F.min("least").over(place.rowsBetween(1, Window.unboundedFollowing)).alias("least_right"),
    )
    cut = F.coalesce(F.greatest("most_left", "before") <= F.least(F.col("least_right"), mean), F.lit(True))
    marked = blocks.join(F.broadcast(outside), "range").withColumn("start", F.when(cut, F.col("first"))).select(*BLOCK, "start")
    segments = running_max(marked, [], ["first"], "start").withColumn("of", F.count("*").over(Window.partitionBy("start")))
    disputed = segments.where("of > 1").groupBy("start").applyInPandas(of_segment, KINDS)
    return checkpointed(segments.where("of = 1").select(*BLOCK).unionByName(disputed).withColumn("value", mean))


def predicted(steps: DataFrame, rows: DataFrame, score: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the value of ``steps`` (``fitted``) at their score: between two steps on the line that joins them, outside that of the nearest.

    Null where the score is null or NaN, or without steps. Rows meet steps by as-of joins over ranges of the score, so a
    score that many rows share is several tasks.
    """
    x = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double") + F.lit(0.0))
    left = rows.select(F.struct("*").alias("own"), x.alias("x"), F.lit(0).alias("all"), (F.lit(0.0) - x).alias("down"))
    both = steps.select(F.lit(0).alias("all"), "first", "last", "value", (F.lit(0.0) - F.col("last")).alias("down_from"))
    at_or_below = both.select("all", "first", F.col("last").alias("below_last"), F.col("value").alias("below"))
    at_or_above = both.select("all", "down_from", F.col("first").alias("above_first"), F.col("value").alias("above"))
    met = as_of_join(left.where("x is not null"), at_or_below, "all", "x", "first", ["below_last", "below"], "first")
    met = as_of_join(met, at_or_above, "all", "down", "down_from", ["above_first", "above"], "down_from")
    share = (F.col("x") - F.col("below_last")) / (F.col("above_first") - F.col("below_last"))
    between = F.col("below") + share * (F.col("above") - F.col("below"))
    value = F.when((F.col("below") == F.col("above")) | F.col("above").isNull(), F.col("below")).when(F.col("below").isNull(), F.col("above")).otherwise(between)
    return met.select("own.*", value.alias(name)).unionByName(left.where("x is null").select("own.*", F.lit(None).cast("double").alias(name)))
