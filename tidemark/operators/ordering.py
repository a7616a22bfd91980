"""Places and counts in the order of a key's rows, without a task that holds a key; broadcasts of a checked size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import checkpointed

#: Bytes that a side may have at most, as the planner estimates it, to be broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of a block of ``below_so_far``, or the number of a key's rows to the power of two thirds, if that is more.
BLOCK = 4_096


#: The planner has no estimate for tables made on the driver; what it says then is a share of the greatest long.
NO_ESTIMATE = 1 << 50
#: Rows up to which a table without an estimate is measured.
MEASURED_ROWS = 1_000_000


def measured(df: DataFrame) -> int:
    """Bytes of a table's rows as JSON; ``NO_ESTIMATE`` if it has more than ``MEASURED_ROWS``."""
    n, size = df.limit(MEASURED_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return NO_ESTIMATE if n > MEASURED_ROWS else size + 16 * n * max(1, len(df.columns))


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if the planner's upper estimate of its size allows that, else as it is.

    Tables made on the driver (calendars, cut-offs, vocabularies) have no estimate; a job measures them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= NO_ESTIMATE:
        size = measured(df)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the place (from 0) of each row among its key's in ``order``; keys aren't null, ties go either way.

    Rows are dealt out by ranges of key and order, so a key with very many rows is many ranges; they are numbered in each
    and moved on by the sizes of the ranges before. Only the sizes, a row for each key and range, are summed in one place.
    """
    ranged = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_range")
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_size")).drop("_size")
    placed = ranged.withColumn("_place", F.row_number().over(own.orderBy(*order)))
    return placed.join(before, [*keys, "_range"]).select(*rows.columns, (F.col("_place") - 1 + F.col("_before")).alias(name))


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str], totals: dict[str, str] = {}) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its column (never null) over the key's rows up to and with this
    one, and for each of ``totals`` the sum of the column of that name in ``sums`` over all the key's rows.

    Ranges of key and order are summed by themselves and moved on by what the ranges before hold, as in ``numbered``. Rows
    of a key have an order of their own; keys may be null.
    """
    ranged = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    so_far = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    moved = [F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums]
    in_all = [F.sum(f"_{name}").over(Window.partitionBy(*keys)).alias(total) for total, name in totals.items()]
    before = whole.select(F.struct(*keys, "_range").alias("_at"), *moved, *in_all)
    summed = ranged.withColumns({name: F.sum(c).over(so_far) for name, c in sums.items()})
    both = summed.join(small(before), F.struct(*keys, "_range").eqNullSafe(F.col("_at")))
    return both.select(*rows.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums], *totals)


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with column ``name`` replaced by its greatest value over the key's rows up to and with this one in ``order``.

    Ranges of key and order each carry their own; the greatest of the ranges before is handed on. Only a range's first key
    goes on from one before it, so what is handed on is a row for each range at most, which is what bounds its broadcast.
    Ties in order go either way; keys may be null.
    """
    spread = rows.withColumn("_n", F.monotonically_increasing_id())  # so that equal places can be several ranges
    ranged = checkpointed(spread.repartitionByRange(*keys, *order, "_n").withColumn("_range", F.spark_partition_id()))
    so_far = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*keys, "_range").agg(F.max(name).alias("_max"))
    before = whole.select(F.struct(*keys, "_range").alias("_at"), F.max("_max").over(earlier).alias("_before")).where("_before is not null")
    carried = ranged.withColumn(name, F.max(name).over(so_far)).join(F.broadcast(before), F.struct(*keys, "_range").eqNullSafe(F.col("_at")), "left")
    return carried.withColumn(name, F.greatest(name, "_before")).select(*rows.columns)


def earlier_below(values: np.ndarray) -> np.ndarray:
    """For each of distinct numbers, how many before it are less. Halves the numbers' range again and again, all at once."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    found, at, place = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    for bit in reversed(range(max(n - 1, 1).bit_length())):
        half = rank[at] >> bit
        upper = half & 1 == 1
        lower_so_far = np.concatenate([[0], np.cumsum(~upper)])
        opens = np.diff(half >> 1, prepend=-1) != 0
        start = np.maximum.accumulate(np.where(opens, place, 0))
        found[at[upper]] += (lower_so_far[1:] - lower_so_far[start])[upper]
        at = at[np.argsort(half, kind="stable")]
    return found


def below_so_far(rows: DataFrame, key: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """``key, order, n_before, n_below``: for each row of a key, the earlier rows and those of them at or below its value.

    ``order`` is unique within a key. Rows get their place in time and in (value, time); both are cut into blocks. Earlier
    rows below are those of the same time block, counted there; those of earlier time blocks in the same value block,
    counted there; and whole cells of a grid of blocks, summed up. So a task holds a block, whatever a key has.
    """
    placed = numbered(numbered(rows.select(key, order, value), [key], [order], "x"), [key], [value, "x"], "y")
    sizes = placed.groupBy(key).agg(F.count("*").alias("n"))
    side = F.greatest(F.lit(block), F.ceil(F.pow("n", F.lit(2 / 3)))).cast("long")
    cut = checkpointed(placed.join(sizes.withColumn("side", side), key).withColumns({"bx": F.expr("x div side"), "by": F.expr("y div side")}).select(key, order, "x", "y", "bx", "by"))

    def in_time(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        return part.assign(near=earlier_below(part["y"].to_numpy()))

    def in_value(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bx", "y"], ascending=[True, False])  # rows of one time block don't count one another
        return part.assign(far=earlier_below(part["y"].to_numpy()))

    kinds = f"{cut.schema[key].dataType.simpleString()} {cut.schema[order].dataType.simpleString()}".split()
    schema = f"`{key}` {kinds[0]}, `{order}` {kinds[1]}, x long, y long, bx long, by long, near long"
    near = cut.groupBy(key, "bx").applyInPandas(in_time, schema)
    both = near.groupBy(key, "by").applyInPandas(in_value, schema + ", far long")
    cells = cut.groupBy(key, "bx", "by").agg(F.count("*").alias("n"))
    widths = cut.groupBy(key).agg(F.max("bx").alias("w"), F.max("by").alias("h"))
    grid = widths.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "w")).alias("bx"), "h").select(key, "bx", F.explode(F.sequence(F.lit(0).cast("long"), "h")).alias("by"))
    full = grid.join(cells, [key, "bx", "by"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = lambda by, order_by: Window.partitionBy(key, by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    whole = full.withColumn("n", F.sum("n").over(before("bx", "by"))).withColumn("whole", F.sum("n").over(before("by", "bx"))).select(key, "bx", "by", "whole")
    out = both.join(whole, [key, "bx", "by"])
    return out.select(key, order, F.col("x").alias("n_before"), (F.col("near") + F.col("far") + F.coalesce("whole", F.lit(0))).alias("n_below"))
