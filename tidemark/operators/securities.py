"""Securities of deals out of a whole name history: ranked by what agrees, unique or ambiguous, never guessed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import significant_tokens
from tidemark.operators.intervals import around, day_number, days_of, pieces
from tidemark.operators.ordering import BROADCAST_BYTES, measured, small
from tidemark.storage import checkpointed

#: Statuses of a mapping.
MATCHED, AMBIGUOUS, NO_MATCH, CREDENTIALS = "MATCHED", "DEFER_CRSP_IDENTITY_AMBIGUOUS", "CRSP_NO_SECURITY_MATCH", "CREDENTIALS_REQUIRED"
#: Stands for every day in place of a piece of days.
EVER = -1
#: Spans of a ticker or name that meet its questions within their rows; those of others are met piece by piece.
HELD = 512
#: Parts that the questions of a key are dealt into when they learn whether it has more.
PARTS = 16
_SAID = "struct<dated: boolean, said: struct<permno: bigint, permco: bigint, namedt: date, nameendt: date, method: string>>"
_BEST = ["namedt", "nameendt", "comnam", "ncusip", "exchcd", "permno", "permco"]


def plain_name(name: Column) -> Column:
    """Upper case, letters and digits only, single spaces; empty for null."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def containing_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``want, name``: asked names (``want``) and the ``names`` whose telling words include all of theirs; both distinct.

    Names are indexed by their words. An asked name looks only under the one of its words that the fewest names have; one
    with a word that no name has looks nowhere. Names without telling words take no part. So pairs looked at are at most
    the asked names times the names under their rarest word.
    """
    indexed = names.select("name", significant_tokens(F.col("name")).alias("words"))
    posted = indexed.select("name", "words", F.explode("words").alias("word"))
    often = posted.groupBy("word").agg(F.count("*").alias("often"))
    wanted = asked.select("want", significant_tokens(F.col("want")).alias("all_words")).where(F.size("all_words") > 0)
    rarest = wanted.select("want", "all_words", F.explode("all_words").alias("word")).join(often, "word", "left")
    rarest = rarest.groupBy("want").agg(F.first("all_words").alias("all_words"), F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))["word"].alias("word"))
    cores = asked.sparkSession.sparkContext.defaultParallelism  # few rows go in and many are compared
    return rarest.repartition(4 * cores, "want").join(small(posted), "word").where(F.size(F.array_except("all_words", "words")) == 0).select("want", "name")


def resolve(asked: DataFrame, history: DataFrame | None, committed: DataFrame | None = None, by_words: bool = False, access: bool = False, today: str | None = None) -> DataFrame:
    """One row for each row of ``asked`` (deal_id, ticker, target_name, as_of) with the security it stands for.

    ``history``: permno, permco, ticker, comnam, ncusip, exchcd, namedt, nameendt (days; open where null, both ends in). A
    deal's rows are those with its ticker or its name; where some of them cover the day, only these count. Then, in order:
    ticker and a name that contains the asked one, ticker alone, the same name, and with ``by_words`` a name that has all
    telling words of the asked one. The first of these that any row meets decides: one security matches, several are
    ambiguous. Of a security's rows the one that begins first is shown. ``committed`` (deal_id, status, permno,
    mapping_method) goes before, the smallest row of a deal where it repeats. Without a history all others lack
    credentials, or with ``access`` have no match. A null day is ``today``; null and empty tickers and names match nothing.

    No deal is copied: it meets the rows of its ticker, then what is left of those of its names, as an array in its own row.
    Names' rows are summed up to the smallest and greatest security per dyadic piece of days, without the pieces inside one
    that is ambiguous. Tickers and names with more than HELD of these are met piece by piece: a distinct question there is
    put under the 23 pieces around its day. So a ticker that many deals and rows share costs its distinct names, not its rows.
    """
    day = F.coalesce("as_of", F.lit(today).cast("date") if today else F.current_date())
    rows = asked.select("deal_id", F.upper(F.coalesce("ticker", F.lit(""))).alias("ticker"), plain_name(F.col("target_name")).alias("want"), day.alias("as_of"))
    if history is None:
        status = NO_MATCH if access else CREDENTIALS
        found = rows.select("deal_id", F.lit(status).alias("status"), F.lit(None).cast("string").alias("mapping_method"), F.lit(None).cast("long").alias("permno"), F.lit(None).cast("long").alias("permco"), F.lit(None).cast("date").alias("effective_start"), F.lit(None).cast("date").alias("effective_end"), F.lit(None).cast("string").alias("confidence"))
    else:
        found = _searched(rows, history, by_words)
    if committed is None:
        return found
    first = F.min(F.struct(F.col("status"), "permno", "mapping_method"))
    settled = F.col("status").isin(AMBIGUOUS, NO_MATCH) | ((F.col("status") == MATCHED) & F.col("permno").isNotNull())
    kept = committed.groupBy("deal_id").agg(first.alias("c")).select("deal_id", "c.*").where(settled).select("deal_id", F.struct("status", "permno", "mapping_method").alias("kept"))
    own = {c: F.when(F.col("kept").isNotNull(), F.col(f"kept.{c}")).otherwise(F.col(c)) for c in ("status", "permno", "mapping_method")}
    gone = {c: F.when(F.col("kept").isNull(), F.col(c)) for c in ("permco", "effective_start", "effective_end", "confidence")}
    return found.join(kept, "deal_id", "left").withColumns(own | gone).drop("kept")


def _searched(rows: DataFrame, history: DataFrame, by_words: bool) -> DataFrame:
    start, end = F.coalesce("namedt", F.lit("0001-01-01").cast("date")), F.coalesce("nameendt", F.lit("9999-12-31").cast("date"))
    # a row's place among all says which of several is shown, in eight bytes; it is written down, as it is used again and again
    cores = rows.sparkSession.sparkContext.defaultParallelism
    placed = checkpointed(history.orderBy(*_BEST).select(
        F.upper(F.coalesce("ticker", F.lit(""))).alias("ticker"), plain_name(F.col("comnam")).alias("name"), F.col("permno").cast("long").alias("low"), F.col("permno").cast("long").alias("high"), F.monotonically_increasing_id().alias("place"),
        day_number(start).alias("first"), day_number(end).alias("last"), F.struct(F.monotonically_increasing_id().alias("place"), F.col("permco").cast("long").alias("permco"), "namedt", "nameendt").alias("best"),
    ))
    asked = rows.select("deal_id", "ticker", "want", "as_of", day_number(F.col("as_of")).alias("day"))

    listed = placed.where("ticker <> ''").select("ticker", "name", "low", "high", "first", "last", "best")
    fits = lambda x: (F.col("want") != "") & F.contains(x["name"], F.col("want"))
    tickers = [(fits, "ticker+name+asof", "ticker+name+asof"), (lambda x: F.lit(True), "ticker+asof", "ticker_only")]
    asked = _looked_up(asked, F.nullif("ticker", F.lit("")), listed, "ticker", tickers, "by_ticker")

    # a day that a security of the ticker covers is decided, others go on to the names
    named = checkpointed(_pruned(placed.where("name <> ''").repartition(4 * cores, "name"), "name"))
    kinds = named.select(F.col("name").alias("want"), F.lit(2).alias("kind"), "first", "last", "low", "high", "place")
    if by_words:
        pairs = containing_names(rows.where("want <> ''").select("want").distinct(), placed.where("name <> ''").select("name").distinct())
        under = _pruned(pairs.join(named, "name"), "want")
        kinds = kinds.unionByName(under.select("want", F.lit(3).alias("kind"), "first", "last", "low", "high", "place"))
    named_spans = checkpointed(kinds.join(placed.select("place", "best"), "place", "left").select("want", "kind", "first", "last", "low", "high", "best"))
    rungs = [(lambda x: x["kind"] == 2, "exact_name+asof", "exact_name+asof"), (lambda x: x["kind"] == 3, "name_words+asof", "name_words+asof")]
    decided = F.coalesce(F.col("by_ticker.dated") & F.col("by_ticker.said").isNotNull(), F.lit(False))
    asked = _looked_up(asked, F.when(~decided & (F.col("want") != ""), F.col("want")), named_spans, "want", rungs, "by_name")

    # what covers the day goes before what doesn't, and then the ticker before the name
    on_ticker, on_name = (F.coalesce(F.col(f"{c}.dated"), F.lit(False)) for c in ("by_ticker", "by_name"))
    s = F.coalesce(F.when(on_ticker | ~on_name, F.col("by_ticker.said")), F.when(on_name | ~on_ticker, F.col("by_name.said")))
    found = asked.select("deal_id", s.alias("s"))
    one, method = F.col("s.permno").isNotNull(), F.col("s.method")
    none, several = F.lit(NO_MATCH), F.lit(AMBIGUOUS)
    trust = F.when(method == "ticker+name+asof", "high").when(method.isin("ticker+asof", "exact_name+asof"), "medium").otherwise("low")
    return found.select(
        "deal_id", F.when(F.col("s").isNull(), none).when(one, MATCHED).otherwise(several).alias("status"), F.when(F.col("s").isNull(), none).when(one, method).otherwise(several).alias("mapping_method"), F.col("s.permno").alias("permno"),
        F.col("s.permco").alias("permco"), F.col("s.namedt").alias("effective_start"), F.col("s.nameendt").alias("effective_end"), F.when(F.col("s").isNotNull(), F.when(one, trust).otherwise("low")).alias("confidence"),
    )


def _pruned(spans: DataFrame, key: str) -> DataFrame:
    """Spans (``first, last``, or a piece of those before) of each ``key`` -> ``key, first, last, low, high, place``: dyadic pieces,
    and one without days for all rows; none inside a piece that several securities share, whose days are ambiguous anyhow."""
    if "piece" not in spans.columns:
        spans = spans.select(key, "low", "high", "place", F.explode(F.array_append(pieces(F.col("first"), F.col("last")), F.lit(EVER).cast("long"))).alias("piece"))
    summed = spans.groupBy(key, "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("place").alias("place"))
    first, last = days_of(F.col("piece"))
    dated = summed.withColumns({"first": F.when(F.col("piece") != EVER, first), "last": F.when(F.col("piece") != EVER, last)})
    outer = Window.partitionBy(key).orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)  # pieces are nested or apart
    inside = F.max(F.when(F.col("low") < F.col("high"), F.col("last"))).over(outer)
    return dated.withColumn("inside", inside).where("last is null or inside is null or inside < last").select(key, "piece", "first", "last", "low", "high", "place")


def _looked_up(asked: DataFrame, key: Column, spans: DataFrame, by: str, rungs: list[tuple[Callable[[Column], Column], str, str]], name: str) -> DataFrame:
    """``asked`` with ``name``, a struct of whether any of the spans of its ``key`` covers its day (``dated``) and what the first
    rung that they meet says (``said``; without a permno where several do). A rung is its condition and its methods, dated and not.

    Up to HELD spans of a key go along with its name, so each question meets them in its row. Those of other keys are cut into
    dyadic pieces, and only their own questions, each once, meet the pieces around their day.
    """
    parts = [c for c in spans.columns if c != by]
    many = checkpointed(spans.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > HELD).select(F.col(by).alias("_key"), F.lit(True).alias("_many")))
    some = not many.isEmpty()
    rows = asked.withColumn("_key", key)
    few = spans.withColumnRenamed(by, "_key")
    if some:
        few = few.join(many, "_key", "left_anti")
        dealt = many.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # so that a key that all ask for isn't one task
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("deal_id", "day"), F.lit(PARTS)).cast("int"))
        rows = rows.join(F.broadcast(dealt) if measured(dealt) <= BROADCAST_BYTES else dealt, ["_key", "_part"], "left").drop("_part")
    else:
        rows = rows.withColumn("_many", F.lit(None).cast("boolean"))
    held = few.groupBy("_key").agg(F.collect_list(F.struct(*parts)).alias("held")).select("_key", F.lit("").alias("_of"), F.lit(-1).alias("_at"), "held", F.lit(None).cast(_SAID).alias("met"))
    # questions without a key are dealt out by their deals; the others of a key with many spans by what is asked and its day
    away = F.when(F.col("_key").isNull(), F.pmod(F.xxhash64("deal_id", "day"), F.lit(4096)).cast("int"))
    rows = rows.withColumns({"_of": F.when(F.col("_many"), F.col("want")).otherwise(""), "_at": F.coalesce(away, F.when(F.col("_many"), F.col("day")).otherwise(-1))})
    if some:
        wide = spans.withColumnRenamed(by, "_key").join(many, "_key", "left_semi")
        days = rows.where("_many").select("_key", "want", "day").distinct()
        pieced = wide.withColumn("piece", F.explode(F.array_append(pieces(F.coalesce("first", F.lit(1)), F.coalesce("last", F.lit(0))), F.lit(EVER).cast("long"))))
        names = [c for c in parts if c in ("name", "kind")]
        pieced = pieced.groupBy("_key", *names, "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("best").alias("best"))
        on_days = days.withColumn("piece", F.explode(F.array_append(around(F.col("day")), F.lit(EVER).cast("long"))))
        hits = on_days.join(pieced, ["_key", "piece"]).withColumn("x", F.struct(*names, "low", "high", "best"))
        dated = F.col("piece") != EVER
        sums = {f"{when}_{i}": F.struct(*[of(F.when(here & rung(F.col("x")), F.col(c))).alias(c) for of, c in ((F.min, "low"), (F.max, "high"), (F.min, "best"))]) for when, here in (("on", dated), ("ever", ~dated)) for i, (rung, _, _) in enumerate(rungs)}
        summed = hits.groupBy("_key", "want", "day").agg(F.bool_or(dated).alias("dated"), *[e.alias(c) for c, e in sums.items()])
        of_rung = [F.when(F.col("dated"), F.col(f"on_{i}")).otherwise(F.col(f"ever_{i}")) for i in range(len(rungs))]
        met = summed.select("_key", F.col("want").alias("_of"), F.col("day").alias("_at"), F.lit(None).cast(held.schema["held"].dataType).alias("held"), _said(F.col("dated"), of_rung, rungs).alias("met"))
        held = held.unionByName(met)
    both = rows.join(held, ["_key", "_of", "_at"], "left")
    both = both.withColumn("_on", F.filter("held", lambda x: F.col("day").between(x["first"], x["last"]))).withColumn("_dated", F.size("_on") > 0)
    both = both.withColumn("_pool", F.when(F.col("_dated"), F.col("_on")).otherwise(F.col("held")))
    both = both.withColumns({f"_met{i}": F.filter("_pool", rung) for i, (rung, _, _) in enumerate(rungs)})
    both = both.withColumns({f"_extent{i}": F.struct(*[of(F.col(f"_met{i}.{c}")).alias(c) for of, c in ((F.array_min, "low"), (F.array_max, "high"), (F.array_min, "best"))]) for i in range(len(rungs))})
    own = F.when(F.col("held").isNotNull(), _said(F.col("_dated"), [F.col(f"_extent{i}") for i in range(len(rungs))], rungs))
    return both.select(*asked.columns, F.coalesce("met", own).alias(name))


def _said(dated: Column, extents: list[Column], rungs: list[tuple[Callable[[Column], Column], str, str]]) -> Column:
    """What the first rung that any row meets says."""
    steps = []
    for e, (_, on_day, ever) in zip(extents, rungs):
        shown = {"permno": e["low"], "permco": e["best"]["permco"], "namedt": e["best"]["namedt"], "nameendt": e["best"]["nameendt"]}
        one = e["low"] == e["high"]
        steps.append(F.when(e["low"].isNotNull(), F.struct(*[F.when(one, c).alias(n) for n, c in shown.items()], F.when(dated, on_day).otherwise(ever).alias("method"))))
    return F.struct(dated.alias("dated"), F.coalesce(*steps).alias("said"))
