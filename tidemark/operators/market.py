"""Calendar-gated series: returns, averages, scores, signals, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import BUY_THRESHOLD, MA_WINDOW, MIN_SAMPLE_N, SELL_THRESHOLD, SWEEP_BUY, SWEEP_SELL, SWEEP_WINDOWS
from tidemark.operators.ordering import below_so_far, small


def calendar_gated(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Prints on sessions only; a print on any other day is dropped, never moved."""
    return prices.join(small(calendar.where("is_trading").select("obs_date")), "obs_date")


def calendar_anchored(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every session of every series; no print leaves a null close. Days and series are dimensions, so the grid is small."""
    grid = prices.select("series_id").distinct().crossJoin(small(calendar.where("is_trading").select("obs_date")))
    return grid.join(prices, ["series_id", "obs_date"], "left")


def two_legs(series: DataFrame, a: str, b: str) -> DataFrame:
    """Two series side by side: leg_a, leg_b, spread (b - a) and ratio (b / a); null if a leg is missing."""
    wide = series.where(F.col("series_id").isin(a, b)).groupBy("obs_date").pivot("series_id", [a, b]).agg(F.first("close"))
    return wide.select("obs_date", F.col(f"`{a}`").alias("leg_a"), F.col(f"`{b}`").alias("leg_b")).withColumns(
        {"spread": F.col("leg_b") - F.col("leg_a"), "ratio": F.try_divide("leg_b", "leg_a")}
    )


def by_series(rows: int | None = None) -> Window:
    w = Window.partitionBy("series_id").orderBy("obs_date")
    return w.rowsBetween(-(rows - 1), 0) if rows else w


def daily_return() -> Column:
    """Against the session before; null if either close is missing (gaps are never padded)."""
    return F.try_divide(F.col("close"), F.lag("close").over(by_series())) - 1


def add_metrics(series: DataFrame, window: int = MA_WINDOW) -> DataFrame:
    """daily_return, ma, n_window, window_complete, mtd_return."""
    month = Window.partitionBy("series_id", F.trunc("obs_date", "month")).orderBy("obs_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = F.first("close", ignorenulls=True).over(month)
    return series.withColumns(
        {
            "daily_return": daily_return(),
            "ma": F.avg("close").over(by_series(window)),
            "n_window": F.count("close").over(by_series(window)),
            "mtd_return": F.try_divide(F.col("close"), anchor) - 1,
        }
    ).withColumn("window_complete", F.col("n_window") >= window)


def classify(buy: Column | float = BUY_THRESHOLD, sell: Column | float = SELL_THRESHOLD) -> Column:
    """NO_DATA unless close, average and return are there; BUY and SELL need both the trend and the move."""
    c, m, r = F.col("close"), F.col("ma"), F.col("daily_return")
    missing = c.isNull() | m.isNull() | r.isNull()
    return F.when(missing, "NO_DATA").when((c > m) & (r > buy), "BUY").when((c < m) & (r < sell), "SELL").otherwise("HOLD")


def forward_return() -> Column:
    return F.try_divide(F.lead("close").over(by_series()), F.col("close")) - 1


def signal_stats(series: DataFrame) -> DataFrame:
    """Forward returns by signal, and over all days: n, mean, hit rate."""
    rows = add_metrics(series).withColumns({"signal": classify(), "fwd": forward_return()}).where("fwd is not null")
    stats = rows.groupingSets([["series_id", "signal"], ["series_id"]], "series_id", "signal").agg(
        F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"), F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)).alias("hit_rate")
    )
    return stats.withColumn("signal", F.coalesce("signal", F.lit("_ALL_DAYS")))


def sweep(series: DataFrame, windows: Sequence[int] = SWEEP_WINDOWS, buys: Sequence[float] = SWEEP_BUY, sells: Sequence[float] = SWEEP_SELL, min_n: int = MIN_SAMPLE_N) -> DataFrame:
    """The grid of thresholds and windows: n, mean forward return, hit rate, baseline, edge, thin; for BUY and SELL.

    One window function per distinct window length; thresholds meet the rows as a small broadcast table.
    """
    base = series.withColumns({"daily_return": daily_return(), "fwd": forward_return()} | {f"ma_{w}": F.avg("close").over(by_series(w)) for w in windows})
    long = base.select("series_id", "close", "daily_return", "fwd", F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"ma_{w}").alias("ma")) for w in windows])).alias("x"))
    rows = long.select("series_id", "close", "daily_return", "fwd", "x.window", "x.ma").where("fwd is not null")
    spark = series.sparkSession
    grid = spark.createDataFrame([(float(b), float(s)) for b in buys for s in sells], "buy double, sell double")
    marked = rows.crossJoin(F.broadcast(grid)).withColumn("signal", classify(F.col("buy"), F.col("sell")))
    base_of = base.where("fwd is not null").groupBy("series_id").agg(F.avg("fwd").alias("baseline"))
    cells = marked.groupBy("series_id", "window", "buy", "sell").agg(
        *[F.count_if(F.col("signal") == s).alias(f"n_{s}") for s in ("BUY", "SELL")],
        *[F.avg(F.when(F.col("signal") == s, F.col("fwd"))).alias(f"mean_{s}") for s in ("BUY", "SELL")],
        *[F.avg(F.when(F.col("signal") == s, F.when(F.col("fwd") > 0, 1.0).otherwise(0.0))).alias(f"hit_{s}") for s in ("BUY", "SELL")],
    )
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"n_{s}").alias("n"), F.col(f"mean_{s}").alias("mean_fwd"), F.col(f"hit_{s}").alias("hit_rate")) for s in ("BUY", "SELL")]))
    out = cells.select("series_id", "window", "buy", "sell", sides.alias("x")).select("series_id", "window", "buy", "sell", "x.*").join(small(base_of), "series_id")
    return out.withColumns({"edge": F.col("mean_fwd") - F.col("baseline"), "thin": F.col("n") < min_n})


def top_cells(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k best cells per series and signal: full samples before thin ones, then by edge."""
    better = F.when(F.col("signal") == "BUY", F.col("edge")).otherwise(-F.col("edge"))
    w = Window.partitionBy("series_id", "signal").orderBy(F.col("thin"), better.desc_nulls_last(), "window", "buy", "sell")
    return cells.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def zscore(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rolling z-score per series that needs all n values of the last n rows; a flat window gives null."""
    w = by_series(n)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))
    return df.withColumn("z", F.when((F.count(value).over(w) == n) & F.col(value).isNotNull(), z))


def entry_signal(z: Column, band: float) -> Column:
    return F.when(z.isNull(), "NO_DATA").when(z <= -band, "LONG").when(z >= band, "SHORT").otherwise("FLAT")


def expanding_percentile(df: DataFrame, value: str) -> DataFrame:
    """Share of a series' values up to now that are at or below this one; null on a gap. A series has one row a day.

    Counted by blocks of time and of value, so no row meets its past one by one and no task holds a series.
    """
    known = df.where(F.col(value).isNotNull()).select("series_id", "obs_date", F.col(value).alias("v"))
    seen = below_so_far(known, "series_id", "obs_date", "v")
    share = seen.select("series_id", "obs_date", ((F.col("n_below") + 1) / (F.col("n_before") + 1)).alias("pctile"))
    return df.join(share, ["series_id", "obs_date"], "left")


def coverage(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions, prints and missing sessions per series, most missing first."""
    rows = calendar_anchored(prices, calendar)
    return rows.groupBy("series_id").agg(F.count("*").alias("trading_days"), F.count("close").alias("prints"), F.count_if(F.col("close").isNull()).alias("missing"))


def upsert_coalesce(old: DataFrame, new: DataFrame) -> DataFrame:
    """New prints over old ones: a null never erases a value, and provenance follows the value."""
    o = old.select("series_id", "obs_date", F.col("close").alias("c0"), F.col("provenance").alias("p0"))
    n = new.select("series_id", "obs_date", F.col("close").alias("c1"), F.col("provenance").alias("p1"))
    both = o.join(n, ["series_id", "obs_date"], "full_outer")
    return both.select("series_id", "obs_date", F.coalesce("c1", "c0").alias("close"), F.when(F.col("c1").isNotNull() | F.col("p0").isNull(), F.col("p1")).otherwise(F.col("p0")).alias("provenance"))


def append_if_changed(vintages: DataFrame) -> DataFrame:
    """Of pulls (series_id, obs_date, value, known_at), those whose value differs from the pull before; nulls compare equal."""
    w = Window.partitionBy("series_id", "obs_date").orderBy("known_at")
    return vintages.withColumns({"n": F.row_number().over(w), "before": F.lag("value").over(w)}).where((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("before"))).drop("n", "before")
