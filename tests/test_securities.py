"""Dyadic pieces, and securities out of a name history against a slow ladder."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.functions.text import NAME_FILLER
from tidemark.operators import intervals, securities

HISTORY = "permno long, permco long, ticker string, comnam string, ncusip string, exchcd int, namedt date, nameendt date"
ASKED = "deal_id string, ticker string, target_name string, as_of date"


def test_a_point_shares_one_piece_with_each_interval_that_holds_it(spark):
    rng = random.Random(3)
    spans = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(200))] + [(0, (1 << intervals.LEVELS) - 1), (5, 5), (6, 5)]
    points = [*range(62), (1 << intervals.LEVELS) - 1]
    left = spark.createDataFrame(list(enumerate(spans)), "i int, s struct<a: long, b: long>").select("i", "s.*", F.explode(intervals.pieces(F.col("s.a"), F.col("s.b"))).alias("piece"))
    right = spark.createDataFrame([(p,) for p in points], "p long").select("p", F.explode(intervals.around(F.col("p"))).alias("piece"))
    got = sorted((r["i"], r["p"]) for r in left.join(right, "piece").collect())
    assert got == sorted((i, p) for i, (a, b) in enumerate(spans) for p in points if a <= p <= b)


def words(name):
    plain = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    return {w for w in plain if w not in NAME_FILLER}


def slow(asked, history):
    """The ladder for one deal, row by row."""
    _, ticker, name, day = asked
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in (x or "").upper()).split())
    ticker, want = (ticker or "").upper(), plain(name)
    kinds = []
    for h in history:
        if ticker and (h[2] or "").upper() == ticker:
            kinds.append((0 if want and want in plain(h[3]) else 1, h))
        if want and want == plain(h[3]):
            kinds.append((2, h))
        if words(want) and words(want) <= words(plain(h[3])):
            kinds.append((3, h))
    on = [(k, h) for k, h in kinds if (h[6] or date.min) <= day <= (h[7] or date.max)]
    pool = on or kinds
    if not pool:
        return securities.NO_MATCH, None
    first = min(k for k, _ in pool)
    found = {h[0] for k, h in pool if k == first}
    return (securities.MATCHED, found.pop()) if len(found) == 1 else (securities.AMBIGUOUS, None)


def test_the_ladder_agrees_with_a_slow_one(spark):
    rng = random.Random(11)
    names = ["Acme Steel Corp", "ACME STEEL HOLDINGS", "Borea, Energy", "Borea Energy & Gas Inc.", "Ünal Çelik", "Inc", "", None]
    day = lambda: date(2000, 1, 1) + timedelta(rng.randrange(400))
    history = [(rng.randrange(12), rng.randrange(4), rng.choice(["AA", "bb", "CC", "", None]), rng.choice(names), None, None, rng.choice([None, day()]), rng.choice([None, day()])) for _ in range(60)]
    asked = [(str(i), rng.choice(["aa", "BB", "ZZ", "", None]), rng.choice([*names, "Steel", "Energy Borea", "Nobody"]), day()) for i in range(150)]
    for rows in (history, history[:4], []):
        got = {r["deal_id"]: (r["status"], r["permno"]) for r in securities.resolve(spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, HISTORY), by_words=True).collect()}
        assert got == {a[0]: slow(a, rows) for a in asked}


def test_what_is_committed_goes_before_and_no_history_lacks_credentials(spark):
    asked = spark.createDataFrame([("d1", "AA", None, None), ("d2", "AA", None, None), ("d2", "AA", None, None), ("d3", "AA", None, None)], ASKED)
    committed = spark.createDataFrame([("d1", securities.MATCHED, 7, "manual"), ("d2", securities.AMBIGUOUS, None, None), ("d3", securities.MATCHED, None, None)], "deal_id string, status string, permno long, mapping_method string")
    got = sorted((r["deal_id"], r["status"], r["permno"]) for r in securities.resolve(asked, None, committed).collect())
    assert got == [("d1", securities.MATCHED, 7), ("d2", securities.AMBIGUOUS, None), ("d2", securities.AMBIGUOUS, None), ("d3", securities.CREDENTIALS, None)]
    history = spark.createDataFrame([(5, 50, "aa", "X", None, None, date(1990, 1, 1), date(1991, 1, 1))], HISTORY)
    row = securities.resolve(asked.where("deal_id = 'd3'"), history, committed, today="2020-05-01").first()
    assert (row["permno"], row["mapping_method"], row["confidence"], row["effective_end"]) == (5, "ticker_only", "low", date(1991, 1, 1))


def test_a_ticker_that_all_share_is_not_paired_row_by_row(spark):
    history = spark.range(4000).selectExpr("id as permno", "id as permco", "'HOT' as ticker", "'Same Name' as comnam", "cast(null as string) as ncusip", "cast(null as int) as exchcd", "date_add(date'2000-01-01', int(id)) as namedt", "date_add(date'2000-01-01', int(id)) as nameendt")
    asked = spark.range(4000).selectExpr("cast(id as string) as deal_id", "'HOT' as ticker", "'same name' as target_name", "date_add(date'2000-01-01', int(id)) as as_of")
    got = securities.resolve(asked, history)
    assert got.where("status = 'MATCHED' and permno = cast(deal_id as long)").count() == 4000
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
