"""Filter interaction audit: what each of five filters removes, in each order in which they can be applied.

Each document gets a 32-bit survival word: bit S says whether it survives the subset S of the filters. The word is read
from a truth table by the set of filters that the document fails. A positional popcount of the words gives the survivors
of all 32 subsets at once: words are added in carry-save form, three words of one weight becoming one word of that weight
and one of twice the weight, until two at most are left of each weight. Survivors of subsets, per part and label, are all
that the table of the 120 orders needs.

Spark computes the failures in one projection. Documents that agree in text, part, labels and failures are counted before
they are shuffled, so a text that a third of all rows hold is a few rows; the word of such a row is added once for each
binary digit of its count. No row is joined with all orders: the orders are a constant that each part explodes.

Defined cases: a null or empty text has no words (A fails, B to D pass) and equals other such texts in E; in E a row with a
null id has no smaller id and is nobody's smaller one, and rows that repeat a text's smallest id all pass; rows that
repeat an id each count; a null source is the part of empty name; labels that repeat an id count as 1 if any of them is;
null labels and ids without labels count as neither; long texts are one row like any other; an empty table gives no
rows; other columns than doc_id, text and source are not looked at, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: By the set of failed filters: bit S is 1 if no filter of S is among them.
SURVIVAL = np.array([sum(1 << s for s in range(ALL + 1) if not s & failed) for failed in range(ALL + 1)], np.uint32)
#: Parts whose counts a task holds before it gives them out.
HELD = 20_000
COUNTS = "part string, subset int, n long, good long, toxic long"


def positional_popcount(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each of the 32 bits, how many words have it; word i counts ``times[i]`` times."""
    counts, carried, weight = np.zeros(32, np.int64), np.zeros(0, np.uint32), 0
    while carried.size or (times >> weight).any():
        here = np.concatenate([words[(times >> weight) & 1 > 0], carried])
        carries = []
        while here.size > 2:
            m = here.size // 3
            a, b, c = here[:m], here[m : 2 * m], here[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            here = np.concatenate([half ^ c, here[3 * m :]])
        bits = (here[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        counts += bits.sum(axis=0, dtype=np.int64) << weight
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight += 1
    return counts


def failed_by_text(text: Column) -> Column:
    """The failures among A to D as a bit set."""
    words = F.array_remove(F.split(text, GAP), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, failed, times: documents by the set of filters they fail, alike ones counted."""
    text = F.coalesce("text", F.lit(""))
    alike = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), failed_by_text(text).alias("failed"))
        .groupBy("doc_id", "part", "same", "failed")
        .agg(F.count("*").alias("times"))
    )
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    # rows without an id have no labels and are dealt out by their text
    keyed = alike.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("same"))))
    joined = keyed.join(marked, "id", "left").select("doc_id", "part", "same", "failed", "times", *(F.coalesce(n, F.lit(False)).alias(n) for n in ("good", "toxic")))
    groups = joined.groupBy("same", "part", "failed", "good", "toxic").agg(
        F.sum("times").alias("times"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("without_id"),
    )
    # a text has at most as many groups as there are parts and labels
    smallest = F.min("first.doc_id").over(Window.partitionBy("same"))
    passing = F.col("without_id") + F.when(F.col("first.doc_id") == smallest, F.col("first.times")).otherwise(0)
    both = groups.withColumn("passing", passing)
    split = F.explode(F.array(F.struct(F.col("failed").alias("failed"), F.col("passing").alias("times")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("times") - F.col("passing")).alias("times"))))
    return both.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.failed", "x.times").where("times > 0")


def survivors(failed: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: documents that no filter of the subset removes."""

    def out(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in held for _ in range(32)]
        columns = [np.concatenate([held[p][i] for p in held]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.tile(np.arange(32, dtype=np.int32), len(held))), *map(pa.array, columns)], names=["part", "subset", "n", "good", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            part = coded.indices.to_numpy()
            words, times = SURVIVAL[batch.column("failed").to_numpy()], batch.column("times").to_numpy()
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
            order = np.argsort(part, kind="stable")
            for name, rows in zip(coded.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(part))[:-1])):
                total = held.setdefault(name, np.zeros((3, 32), np.int64))
                for i, of in enumerate((rows, rows[good[rows]], rows[toxic[rows]])):
                    total[i] += positional_popcount(words[of], times[of])
            if len(held) >= HELD:
                yield from out(held)
                held = {}
        if held:
            yield from out(held)

    return failed.mapInArrow(run, COUNTS).groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def steps() -> Column:
    """All orders and steps: the subset applied before, with the step, and the filter's number."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            rows.append({"filter_order": "".join(FILTERS[x] for x in order), "step": i + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>")


def shapley() -> Column:
    """By filter: documents it removes, summed over all orders. A subset S stands right before a filter in |S|! (4 - |S|)! of them."""

    def of(f: int) -> str:
        subsets = [s for s in range(ALL + 1) if not s >> f & 1]
        return " + ".join(f"{factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())} * (n[{s}] - n[{s | 1 << f}])" for s in subsets)

    return F.expr(f"array({', '.join(of(f) for f in range(len(FILTERS)))})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    by_part = survivors(failures(docs, labels)).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    wide = by_part.select("part", *(F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic"))).withColumn("shapley", shapley())
    rows = wide.withColumn("x", F.explode(steps())).select("part", "x.*", "n", "good", "toxic", "shapley")
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.expr("n[after]").alias("kept"),
        F.expr("n[before] - n[after]").alias("removed"),
        F.expr("n[0] - n[shiftleft(1, f)] - (n[before] - n[after])").alias("redundant"),
        F.expr(f"n[{ALL} - shiftleft(1, f)] - n[{ALL}]").alias("unique_fails"),
        F.expr("good[before] - good[after]").alias("good_lost"),
        F.expr("toxic[before] - toxic[after]").alias("toxic_lost"),
        F.expr("shapley[f]").alias("shapley"),
    )


#: The query in DuckDB: each document against each order, without survival words.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS i FROM orders),
hits AS (SELECT part, o AS filter_order, i AS step, o[i] AS x, n, good, toxic, fails,
    contains(fails, o[i]) AS own, i > 1 AND regexp_matches(fails, '[' || o[1:i - 1] || '~]') AS before FROM g, steps),
sums AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT before), 0)::BIGINT AS toxic_lost FROM hits GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM sums
"""
