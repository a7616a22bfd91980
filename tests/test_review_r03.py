"""What the review of round 3 found, each as a small case."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import scan
from tidemark.functions.text import names_agree
from tidemark.operators import audit, model, simulation
from tidemark.sources import formulas


def test_sixty_months_from_the_end_of_february_end_on_the_same_day(spark):
    """The 28th of February and 60 months is the 28th, in a leap year too, so a break on the 29th is too late."""
    rows = [("a", date(1995, 2, 28), date(2000, 2, 28), 1, "close"), ("a", date(1995, 2, 28), date(2000, 2, 29), 2, "break"), ("b", date(1996, 2, 29), date(2001, 2, 28), 1, "close"), ("b", date(1996, 2, 29), date(2001, 3, 1), 2, "break")]
    timeline = spark.createDataFrame(rows, "deal_id string, announce_date date, event_date date, seq int, kind string")
    got = sorted(map(tuple, audit.pick_resolution(timeline).collect()))
    assert got == [("a", "closed", date(2000, 2, 28)), ("b", "closed", date(2001, 2, 28))]


def test_identifiers_agree_with_a_pairwise_search_and_pair_nothing(spark):
    rng = random.Random(4)
    day = lambda: date(2000, 1, 1) + timedelta(rng.randrange(60))
    names = ["Acme Steel Inc", "ACME Holdings", "Borea", "", None]
    history = [(rng.choice(["A", "B", None]), rng.choice([1, 2, 3, None]), rng.choice([None, day()]), rng.choice([None, day()]), rng.choice(names)) for _ in range(25)]
    history += [("HOT", 9, date(2001, 1, 1) + timedelta(i), date(2001, 1, 1) + timedelta(i), "Acme Steel") for i in range(300)]
    asked = [(i // 2 if i < 60 else i, rng.choice(["A", "B", "Z", None]), rng.choice([day(), day(), None]), rng.choice(names)) for i in range(200)]
    asked += [(1000 + i, "HOT", date(2001, 1, 1) + timedelta(i), "acme steel corp") for i in range(300)]
    a = spark.createDataFrame(asked, "deal_id int, ticker string, as_of date, asked_name string")
    h = spark.createDataFrame(history, "ticker string, security int, valid_from date, valid_to date, issuer_name string")
    covers = F.col("as_of").between(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    pairs = a.join(h, "ticker").where(covers).groupBy("deal_id").agg(F.count_distinct("security").alias("n"), F.min("security").alias("s"), F.bool_or(names_agree(F.col("asked_name"), F.col("issuer_name"))).alias("ok"))
    status = F.expr("case when n is null then 'UNRESOLVED' when n > 1 then 'AMBIGUOUS' when not ok then 'NAME_MISMATCH' else 'MATCHED' end")
    expected = a.join(pairs, "deal_id", "left").select("deal_id", status.alias("status"), F.when(status == "MATCHED", F.col("s")))
    found = audit.identifier_candidates(a, h)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "valid_from" not in plan and "valid_to" not in plan  # no join under a condition on days


def test_walk_forward_works_its_rows_out_once(spark):
    """However many passes the fits take over them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = spark.range(400).selectExpr("id", "date_add(date'2000-01-01', int(id)) as announce_date", "date_add(date'2000-01-01', int(id) + 5) as resolution_date", "cast(id % 3 = 0 as double) as label", "cast(pmod(hash(id), 50) as double) as gap")
    scored = model.walk_forward(rows.mapInPandas(counted, rows.schema), ("gap",), ("2000-06-01", "2000-10-01", "2001-01-01"), spread="gap")
    assert scored.count() == 214
    assert seen.value == 400


def test_formulas_of_one_kind_are_parsed_once(monkeypatch):
    calls = []
    own = formulas.parsed
    monkeypatch.setattr(formulas, "parsed", lambda f: calls.append(f) or own(f))
    formulas.kind.cache_clear()
    for i in range(5, 500):
        f = f'IF(COUNT(A{i - 4}:$A{i})>10,AVERAGE(A{i - 4}:$A{i}),Log2!B{i}&"A7")'
        assert formulas.read_once(f) == own(f)
    assert len(calls) == 1
    for f in ("A5:A3+A5+A10", "A1:A1048576+B:B", "ROUND(A12,12)+1.5", "12+A9*2", "A0", "A1+A٢", "1 A55", "LOG10(A3)", "'S 2'!A7:B9", "=A3", "A10:A9+A9"):
        try:
            expected = own(f)
        except formulas.Unreadable as e:
            expected = str(e)
        try:
            got = formulas.read_once(f)
        except formulas.Unreadable as e:
            got = str(e)
        assert got == expected, f


def test_equal_texts_are_read_once():
    read = []

    def letters(text, least):
        read.append(text)
        return None if text is None else [float(len(text) + least)]

    texts = ["ab", "c", None, "ab", "x" * 5000, "x" * 5000, None]
    got = scan.column(letters, scan.NUMBERS, pa.array(texts), least=1)
    assert got.to_pylist() == [[3.0], [2.0], None, [3.0], [5001.0], [5001.0], None]
    scan.column(letters, scan.NUMBERS, pa.array(["ab", "c"]), least=1)
    assert read == ["ab", "c", None, "x" * 5000]
    assert scan.column(letters, scan.NUMBERS, pa.array([], pa.string()), least=1).to_pylist() == []


def test_sums_of_paths_are_one_a_task_and_not_one_a_slice(spark):
    book = spark.range(3000).selectExpr("id as deal_id", "(id % 7 + 1) / 10.0D as p_break", "100.0D + id as downside_notional", "10.0D as upside_notional")
    many = simulation.simulate(book, paths=50, slices=300)
    partial = [line for line in many._jdf.queryExecution().toString().splitlines() if "RepartitionByExpression" in line]
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert partial and all(line.rstrip().endswith(str(tasks)) for line in partial), partial
    rows = many.toPandas()
    assert sorted(rows.path) == list(range(50)) and abs(rows.breaks.mean() / 3000 - 0.4) < 0.15
