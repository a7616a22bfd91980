"""What the review of round 3 found still open, each as a small case."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

from tests.test_securities import ASKED, HISTORY, slow
from tidemark.llm import near_copies
from tidemark.operators import prices, securities


def test_a_question_about_securities_is_not_copied_for_each_piece_of_days(spark, monkeypatch):
    """Whether its ticker and names have few spans or many, it is answered as by the slow ladder."""
    rng = random.Random(5)
    names = ["Acme Steel Corp", "ACME STEEL HOLDINGS", "Borea, Energy", "Borea Energy & Gas Inc.", "Inc", "", None]
    day = lambda: date(2000, 1, 1) + timedelta(rng.randrange(200))
    history = [(rng.choice([*range(8), None]), 1, rng.choice(["AA", "bb", "CC", "", None]), rng.choice(names), None, None, rng.choice([None, day()]), rng.choice([None, day()])) for _ in range(40)]
    history = [h for h in history if h[0] is not None]
    asked = [(str(i), rng.choice(["aa", "BB", "ZZ", "", None]), rng.choice([*names, "Steel", "Energy Borea", "Nobody"]), day()) for i in range(100)]
    a, h = spark.createDataFrame(asked, ASKED), spark.createDataFrame(history, HISTORY)
    expected = {x[0]: slow(x, history) for x in asked}
    for held in (512, 2):
        monkeypatch.setattr(securities, "HELD", held)
        found = securities.resolve(a, h, by_words=True)
        assert {r["deal_id"]: (r["status"], r["permno"]) for r in found.collect()} == expected
        if held == 512:
            assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_snapshot_weights_move_deals_and_no_snapshot(spark):
    """Deals that repeat weigh as their rows say, one by one; rows without an id are no deal, and stay as in the SQL."""
    calendar = spark.sql("select d as obs_date, weekday(d) < 5 as is_trading from (select explode(sequence(date'2000-01-01', date'2000-06-30')) as d)")
    deals = spark.range(300).selectExpr("if(id % 50 = 7, null, id % 250) as deal_id", "date_add(date'1999-12-20', int(id)) as announce_date", "cast(null as date) as resolution_date")
    found = prices.snapshot_weights(deals, calendar)
    rows = prices.deal_equal_weight(prices.snapshot_rows(deals.where("deal_id is not null"), calendar)).select(*found.columns)
    got = [tuple(r) for r in found.collect()]
    assert Counter(r for r in got if r[0] is not None) == Counter(map(tuple, rows.collect())) and len(got) > 1000
    assert any(r[0] is None for r in got)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("policy" in line for line in dealt)


def test_near_copies_are_linked_by_simhash(spark, monkeypatch):
    """What differs by few bits is one class without the min-wise groups, and is not compared in them again."""
    rng, rows = random.Random(8), []
    for b in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
        rows += [(10 * b + k, " ".join([*words[:k], "edit", *words[k + 1 :]] if k else words)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared, own = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda members, sets, threshold, block, before: compared.append(before.count()) or own(members.limit(0), sets, threshold, block, before))
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == {10 * b for b in range(10)} and compared[0] >= 20
