"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Each rule compares two whole-number counts of a document, ``scale * count > bound * base`` or the reverse, so the
verdict needs no division. Defined cases: a null text has no words and fails the base rule; an empty table gives
an empty result; repeated rows are judged alike; a count that equals its bound passes; a text of any length is
judged whole, in one row of a task; other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, WORD

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from or an at not have "
    "le la les de des du et un une que qui en dans pour par sur est pas au avec "
    "der die das und den dem von zu mit sich ist nicht ein eine auf für als auch im "
    "el los las y se una no con su al lo como más del"
).split()

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """The document fails if ``100 * count`` is above (``over``) or below ``bound * base``."""

    name: str
    count: str
    over: bool
    bound: int
    base: str


#: The threshold table. Counts and bases are columns of ``measures``.
RULES = (
    Rule("symbols_to_words", "n_symbols", True, 30, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", True, 60, "n_lines"),
    Rule("stop_words", "n_stop_words", False, 5, "n_words"),
    Rule("short_words", "word_chars", False, 200, "n_words"),
    Rule("long_words", "word_chars", True, 1500, "n_words"),
)
BASE_RULES = ("n_words < 50", "100 * n_repeat_words > 50 * n_words")


def measures(docs: DataFrame) -> DataFrame:
    """The counts that rules are about, one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(text, GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))).alias("lines"),
    )
    at = lambda i: F.get(F.col("words"), i)
    grams = split.withColumn(
        "grams",
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    ranked = grams.withColumn(
        "ranked",
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<g:bigint,i:int>>")
        ),
    )
    starts = ranked.withColumn("starts", F.when(F.size("ranked") > 0, F.sort_array(F.filter(F.transform("ranked", _start_if_repeated), lambda s: s.isNotNull()))).otherwise(F.array().cast("array<int>")))
    long = lambda c: c.cast("long")
    return starts.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.char_length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(_covered(F.col("starts"))).alias("n_repeat_words"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
    )


def _start_if_repeated(row: Column, k: Column) -> Column:
    """The start of a window whose neighbour in hash order has the same words, else null."""
    before, after = F.get(F.col("ranked"), k - 1), F.get(F.col("ranked"), k + 1)
    same = lambda x: F.coalesce(x["g"] == row["g"], F.lit(False))
    return F.when(same(before) | same(after), row["i"])


def _covered(starts: Column) -> Column:
    """Words in the union of the 3-word windows that begin at ``starts`` (ascending)."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.lit(3) - F.greatest(F.lit(0), a["end"] - s)).alias("n"), (s + F.lit(3)).alias("end")),
        lambda a: a["n"],
    )


def fails(rule: Rule) -> Column:
    left, right = 100 * F.col(rule.count), rule.bound * F.col(rule.base)
    return left > right if rule.over else left < right


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, ``base_failed``, the names of the rules that failed, and ``kept``."""
    base = F.expr(" OR ".join(BASE_RULES))
    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))
    found = measures(docs).withColumns({"base_failed": base, "failed_rules": failed})
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def oracle_sql() -> str:
    """The query's columns in DuckDB."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    verdict = " OR ".join(f"100 * {r.count} {'>' if r.over else '<'} {r.bound} * {r.base}" for r in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
hits AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '{GAP}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({stop})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, ({" OR ".join(BASE_RULES)}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({verdict})) AS kept FROM b
"""
