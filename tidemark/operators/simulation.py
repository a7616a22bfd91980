"""Monte-Carlo loss distribution of a book under a one-factor Gaussian copula, and its risk report."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SIMULATION_PATHS, SIMULATION_RHO
from tidemark.storage import checkpointed

#: Paths that are drawn together, and positions whose sum is looked up at once.
BLOCK, TOGETHER = 20_000, 8
#: Positions of a slice, and slices of one width of p at most; a larger book has larger slices, so that its sums per path stay bounded.
SLICE, MOST_SLICES = 2_048, 4_096
#: Positions of a slice have chances that differ by no more than one of so many parts.
WIDTHS = 512
#: A draw's first bits, which decide nearly all; what they leave open is decided by more.
FIRST = 1 << 16


def draws(seed: int, block: int, part: int) -> np.random.Generator:
    """A stream of its own for each block of paths and each slice of positions; -1 is the common factor's."""
    return np.random.Generator(np.random.SFC64([seed, block, part + 1]))


def chance(bars: np.ndarray) -> np.ndarray:
    """How likely a normal draw is below each of ``bars`` (never below one that isn't a number)."""
    return np.nan_to_num(0.5 * np.fromiter(map(math.erfc, (-bars / math.sqrt(2.0)).tolist()), float, len(bars)))


def subset_sums(amounts: np.ndarray) -> np.ndarray:
    """For each ``TOGETHER`` amounts, their sum over each subset: the amount at j counts where bit j is set."""
    rows = np.pad(amounts, (0, -len(amounts) % TOGETHER)).reshape(-1, TOGETHER)
    sums = np.zeros((len(rows), 1))
    for j in range(TOGETHER):
        sums = np.hstack([sums, sums + rows[:, j : j + 1]])
    return sums


def broken(noise: np.random.Generator, bars: np.ndarray, shift: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which of some positions (rows) break on which paths (columns).

    Given the common factor a position breaks with chance ``chance(bar - shift)``, so a uniform number is drawn in place of
    its noise. 16 bits are drawn first: below ``low`` all of the slice's positions break, above ``low + width`` none; only
    between them a position's own chance and the number's other bits are asked for.
    """
    m = len(shift)
    first = noise.bit_generator.random_raw(-(-len(bars) * m // 4)).view(np.uint16)[: len(bars) * m].reshape(-1, m)
    found = first < low
    first -= low  # what is below goes round to far above
    unsure = first <= width
    paths = np.flatnonzero(unsure.any(axis=0))
    if len(paths):
        i, at = np.nonzero(unsure[:, paths])
        at = paths[at]
        found[i, at] = (0.0 + first[i, at] + low[at] + noise.random(len(i))) / FIRST < chance(bars[i] - shift[at])
    return found


def simulate(positions: DataFrame, paths: int = SIMULATION_PATHS, rho: float = SIMULATION_RHO, seed: int = 1, slices: int | None = None) -> DataFrame:
    """``path, pnl, breaks`` of each path for positions (deal_id, p_break, downside_notional, upside_notional).

    A position breaks where sqrt(rho) * factor + sqrt(1 - rho) * own noise is below its quantile; each position has a draw
    of its own on each path. Positions of nearly equal chance are dealt to about ``slices`` by a hash of their id, as many as
    their number asks for; a task holds one slice's positions at a time, meets the blocks of paths one after the other and
    gives sums per path over all of its slices, which one aggregation adds up.
    Tasks are four times the cores at most, so what is added up doesn't grow with the book. Draws depend
    on seed, block and slice alone, so partitions don't change the result (beyond the order of the sums).
    """
    p = F.greatest(F.least(F.col("p_break").cast("double"), F.lit(1 - 1e-9)), F.lit(1e-9))
    held = checkpointed(positions.select("deal_id", "p_break", "downside_notional", "upside_notional").withColumn("width", F.floor(p * WIDTHS).cast("int")))
    sizes = [0] * WIDTHS
    for width, n in held.groupBy("width").count().collect():
        sizes[width] = n
    size = max(1, -(-sum(sizes) // (slices or MOST_SLICES)), 0 if slices else SLICE)
    parts = [-(-n // size) for n in sizes]
    before = [0, *itertools.accumulate(parts)]
    tasks = max(1, min(before[-1], 4 * positions.sparkSession.sparkContext.defaultParallelism))
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("width") + 1)
    dealt = held.withColumn("slice", (of(before[:-1]) + F.pmod(F.xxhash64("deal_id"), of([max(1, n) for n in parts]))).cast("int")).repartitionById(tasks, F.col("slice") % tasks).sortWithinPartitions("slice")
    starts = range(0, paths, BLOCK)

    def add(rows: pa.Table, shifts: list[np.ndarray], pnl: np.ndarray, hits: np.ndarray) -> None:
        """A slice's share of each path, added to the sums."""
        rows = rows.sort_by([(c, "ascending") for c in ("deal_id", "p_break", "downside_notional", "upside_notional")])
        part = rows["slice"][0].as_py()
        down, up = (rows[c].to_numpy() for c in ("downside_notional", "upside_notional"))
        quantile = NormalDist().inv_cdf
        known = {p: quantile(min(max(p, 1e-9), 1 - 1e-9)) for p in set(rows["p_break"].to_pylist())}
        bars = np.array([known[p] for p in rows["p_break"].to_pylist()]) / np.sqrt(1 - rho)
        sums = subset_sums(down + up)
        for block, (start, shift) in enumerate(zip(starts, shifts)):
            here, noise = slice(start, start + len(shift)), draws(seed, block, part)
            ends = [chance(bar - shift) for bar in dict.fromkeys((np.nanmin(bars), np.nanmax(bars)))]
            low, high = (np.minimum(end * FIRST, FIRST - 1).astype(np.uint16) for end in (ends[0], ends[-1]))
            own_pnl, own_hits = np.full(len(shift), up.sum()), np.zeros(len(shift), np.int64)
            for k, of_subset in enumerate(sums):
                found = broken(noise, bars[k * TOGETHER : (k + 1) * TOGETHER], shift, low, high - low).view(np.uint8)
                subset = found[-1].copy()
                for bit in found[-2::-1]:
                    subset += subset
                    subset |= bit
                own_pnl -= of_subset.take(subset)
                own_hits += np.bitwise_count(subset)
            pnl[here] += own_pnl
            hits[here] += own_hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pnl, hits, held, shifts = np.zeros(paths), np.zeros(paths, np.int64), [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not shifts:
                shifts = [np.sqrt(rho / (1 - rho)) * draws(seed, block, -1).standard_normal(min(BLOCK, paths - start)) for block, start in enumerate(starts)]
            ids = batch.column("slice").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if held and held[-1].column("slice")[0].as_py() != ids[a]:
                    add(pa.Table.from_batches(held), shifts, pnl, hits)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            add(pa.Table.from_batches(held), shifts, pnl, hits)
            for start in starts:
                here = slice(start, min(start + BLOCK, paths))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(here.start, here.stop)), pa.array(pnl[here]), pa.array(hits[here])], names=["path", "pnl", "breaks"])

    cast = dealt.select(F.col("deal_id").cast("long"), *[F.col(c).cast("double") for c in ("p_break", "downside_notional", "upside_notional")], "slice")
    return cast.mapInArrow(run, "path long, pnl double, breaks long").groupBy("path").agg(F.sum("pnl").alias("pnl"), F.sum("breaks").alias("breaks"))


def risk_report(paths: DataFrame, levels: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Value at risk (a loss, 0 at least) and expected shortfall per level, with mean and deviation of the P&L."""
    cuts = paths.agg(F.percentile("pnl", F.array(*[F.lit(round(1 - x, 10)) for x in levels])).alias("q"), F.avg("pnl").alias("mean_pnl"), F.stddev_samp("pnl").alias("std_pnl"))
    table = cuts.select("mean_pnl", "std_pnl", F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("q").alias("q"))).alias("z")).select("mean_pnl", "std_pnl", F.col("z.level").alias("level"), F.col("z.q").alias("q"))
    tails = paths.join(F.broadcast(table), F.col("pnl") <= F.col("q")).groupBy("level").agg(F.avg("pnl").alias("tail"))
    return table.join(tails, "level").select("level", "mean_pnl", "std_pnl", F.greatest(F.lit(0.0), -F.col("q")).alias("value_at_risk"), F.greatest(F.lit(0.0), -F.col("tail")).alias("expected_shortfall"))
