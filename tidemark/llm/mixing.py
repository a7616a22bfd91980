"""Mixing sources to target weights.

Tokens are summed per source, targets are filled up by weight under a cap, and a source's repetition rate is
its target over its size. A document is emitted floor(rate) times, plus once more if a draw that depends on
its id and the seed alone falls below the rate's fraction. Reruns therefore agree, whatever the partitions.

Defined cases: a null or empty text has size 0; a null source is a source of its own, last in order; a source
of size 0 has target 0 and rate 0; a text of any length counts whole; rows that repeat an id share its draw, so they
come out alike; sources are distinct, so their order has no ties; an empty table gives an empty mix; extra columns
stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WORD, checkpointed, fresh

#: Source tables of up to this many rows are broadcast; larger ones are joined by a salted key.
BROADCAST_SOURCES = 50_000
SALTS = 32


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size`` -> the same plus ``target`` and ``rate``; one row per source.

    The sources, in code point order with null last, weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``cap`` times the source's size; what is over goes to the others by weight, in rounds of
    one aggregation each, until no target is above its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source, not per document
    place = (F.row_number().over(order) - 1) % len(weights)
    known = checkpointed(sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")))
    limit = cap * F.col("source_size")
    total, capped, open_weight = *known.agg(F.sum("source_size"), F.lit(0), F.sum("w")).first(),
    total = total or 0
    full = F.lit(False)
    while open_weight:
        full = F.lit((total - capped) / open_weight) * F.col("w") >= limit
        now = known.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        if tuple(now) == (capped, open_weight):
            break
        capped, open_weight = now
    shared = (F.lit(total - capped).cast("double") * F.col("w") / F.lit(open_weight or 1)) if open_weight else F.lit(0.0)
    out = known.withColumn("target", F.when(full | F.lit(not open_weight), limit.cast("double")).otherwise(shared))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: int = 42) -> Column:
    """floor(rate), and one more if the id's draw in [0, 1) is below the fraction."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_sources(docs: DataFrame, by_source: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` with the columns of ``by_source``; a source that holds a large part of all rows doesn't meet in one task."""
    mark, salt = fresh(docs, "source_mark", "source_salt")
    key = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))
    right = by_source.withColumn(mark, key("source")).drop("source")
    if right.count() <= BROADCAST_SOURCES:
        return docs.withColumn(mark, key(source)).join(F.broadcast(right), mark).drop(mark)
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = docs.withColumn(mark, key(source)).withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(SALTS)).cast("int"))
    return left.join(right, [mark, salt]).drop(mark, salt)


def mix_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    sized = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    by_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    n = copies(F.col("rate"), F.col("doc_id"), seed)
    return with_sources(sized, by_source).select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    sized = docs.select("source", n_words(F.col("text")).alias("size"))
    by_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate, copy = fresh(docs, "mix_rate", "mix_copy")
    rated = with_sources(docs, by_source.select("source", F.col("rate").alias(rate)))
    again = F.array_repeat(F.lit(1), copies(F.col(rate), F.col("doc_id"), seed).cast("int"))
    repeated = rated.withColumn(copy, F.explode(again))
    return repeated.select(*docs.columns)


#: The same plan in DuckDB.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM src),
total AS (SELECT sum(source_size)::BIGINT AS t FROM src),
steps AS (
  SELECT source, source_size, w, t,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_cap,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS from_w,
    row_number() OVER o AS k
  FROM placed, total WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
firstopen AS (
  SELECT min(k) AS k FROM steps WHERE NOT ((t - before_cap)::DOUBLE / from_w * w >= 3 * source_size)),
lvl AS (SELECT t - before_cap AS rest, from_w FROM steps, firstopen WHERE steps.k = firstopen.k),
targets AS (
  SELECT source, source_size,
    CASE WHEN (SELECT k FROM firstopen) IS NULL OR steps.k < (SELECT k FROM firstopen) THEN (3 * source_size)::DOUBLE
         ELSE (SELECT rest FROM lvl)::DOUBLE * w / (SELECT from_w FROM lvl) END AS target
  FROM steps),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM counted
"""
