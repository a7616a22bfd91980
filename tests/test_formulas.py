"""Formulas read, worked out and checked; ranges against a slow sum."""

from __future__ import annotations

import random

import pytest

from tidemark.sources import formulas, workbook


def value(formula, **cells):
    tree, refs = formulas.parsed(formula)
    read, size = [], []
    for _, c1, r1, c2, r2 in refs:
        got = [cells.get(f"{workbook.column_name(c)}{r}") for c in range(c1, c2 + 1) for r in range(r1, min(r2, 20) + 1)]
        numbers = [float(x) for x in got if isinstance(x, (int, float))]
        read.append({"n": len(numbers), "total": sum(numbers) if numbers else None, "least": min(numbers, default=None), "most": max(numbers, default=None), "filled": 0, "text": next((x for x in got if isinstance(x, str)), None)})
        size.append((c2 - c1 + 1) * (r2 - r1 + 1))
    try:
        return formulas.worked_out(tree, read, size)
    except formulas.Wrong as e:
        return str(e)


@pytest.mark.parametrize(("formula", "expected"), [
    ("=1+2*3^2-4/2", 17.0), ("-2^2", 4.0), ("2^-1", 0.5), ("(1+2)*50%", 1.5), ("1<2", True), ('"a"&1&"b"', "a1b"), ('"A"="a"', True), ("A1+$B$1", 5.0), ("A1/B2", "#DIV/0!"), ("A1+A3", "#VALUE!"),
    ('IF(COUNT(A1:A3)>0,AVERAGE(A1:A3),"n/d")', 2.0), ('IF(COUNT(A3:A3)>0,AVERAGE(A3:A3),"n/d")', "n/d"), ('IF(AND(ISNUMBER(A1),ISNUMBER(A3)),A1/A3-1,"n/d")', "n/d"), ("SUM(A1:B3,10)", 15.0), ("MIN(A:A)", 2.0),
    ("IFERROR(1/0,7)", 7.0), ("ROUND(-2.5,0)", -3.0), ("ISBLANK(C9)", True), ("MAX(C1:C2)", 0.0), ("NOT(FALSE)", True), ("AVERAGE(C1:C2)", "#DIV/0!"), ("SQRT(-1)", "#NUM!"), ('"say ""x"""', 'say "x"'),
])
def test_formulas_are_worked_out(formula, expected):
    assert value(formula, A1=2, B1=3, A3="n/d") == expected


@pytest.mark.parametrize("formula", ["", "1+", "FOO(1)", "IF(1)", "(1", "1 2", "A1:B", "{1}", "'x"])
def test_what_is_not_known_is_unreadable(formula):
    with pytest.raises(formulas.Unreadable):
        formulas.parsed(formula)


def test_places_name_sheets_and_whole_columns():
    assert formulas.parsed("'Other ''s'''!$B2+Log!A1:AB3+C:A")[1] == [("Other 's'", 2, 2, 2, 2), ("Log", 1, 1, 28, 3), (None, 1, 1, 3, formulas.LAST_ROW)]


def sheet(spark, *cells):
    rows = []
    for at, text, formula in cells:
        number = float(text) if isinstance(text, (int, float)) else None
        rows.append(("f", "S", int(at[1:]), workbook.column_number(at), None if text is None else str(text), number, formula))
    return spark.createDataFrame(rows, workbook.CELLS)


def test_each_cell_gets_its_status(spark):
    cells = sheet(
        spark, ("A1", 1.0, None), ("A2", "n/d", None), ("A3", 3.0, None), ("B1", 2.0, "AVERAGE(A1:A3)"), ("B2", 9.0, "SUM(A1:A3)"), ("B3", "n/d", 'IF(ISNUMBER(A2),A2,"n/d")'), ("C1", None, "C2*2"), ("C2", None, "C3+1"), ("C3", None, "SUM(A1:A3)"),
        ("D1", None, "D2"), ("D2", None, "SUM(D1:D1)"), ("E1", 1.0, "VLOOKUP(A1,A1:A3,1)"), ("E2", None, "1/0"), ("E3", "#DIV/0!", "1/0"), ("E4", "1", "A1=1"),
    )
    checked = formulas.gate(cells)
    got = {workbook.column_name(r["col"]) + str(r["row"]): (r["status"], r["expected"] if r["expected"] is not None else r["expected_text"]) for r in checked.collect()}
    assert got == {
        "B1": ("ok", 2.0), "B2": ("wrong", 4.0), "B3": ("ok", "n/d"), "C1": ("computed", 10.0), "C2": ("computed", 5.0), "C3": ("computed", 4.0), "D1": ("unsettled", None), "D2": ("unsettled", None),
        "E1": ("unreadable", None), "E2": ("error", "#DIV/0!"), "E3": ("ok", "#DIV/0!"), "E4": ("ok", "1"),
    }
    assert formulas.gate_totals(checked).first()[2:] == (12, 5)
    assert formulas.gate(cells.limit(0)).count() == 0


def test_ranges_sum_what_they_hold(spark):
    rng = random.Random(5)
    column = [rng.choice([None, "x", float(rng.randrange(100))]) for _ in range(300)]
    cells = [(f"A{i}", v, None) for i, v in enumerate(column, 1) if v is not None]
    spans = [tuple(sorted((rng.randrange(1, 301), rng.randrange(1, 301)))) for _ in range(60)] + [(1, 300), (7, 7)]
    cells += [(f"C{i}", None, f"SUM(A{a}:A{b})+COUNT(A{a}:A{b})/1000") for i, (a, b) in enumerate(spans, 1)]
    got = {r["row"]: r["expected"] for r in formulas.gate(sheet(spark, *cells)).collect()}
    for i, (a, b) in enumerate(spans, 1):
        numbers = [v for v in column[a - 1 : b] if isinstance(v, float)]
        assert got[i] == pytest.approx(sum(numbers) + len(numbers) / 1000)


def test_a_written_workbook_passes_its_gate(spark, tmp_path):
    df = spark.createDataFrame([("z", 4.0, 5.0), ("y", 4.0, 6.5)], "name string, price double, offer double")
    path = str(tmp_path / "report.xlsx")
    workbook.write_workbook(path, {"Deals": df}, {"Deals": {"spread": "{offer} - {price}"}})
    assert {r["status"] for r in formulas.gate(workbook.cells(spark, path)).collect()} == {"ok"}


def test_repeated_formulas_and_places_without_a_row(spark):
    cells = sheet(spark, ("A1", 1.0, None), ("A2", 2.0, None), ("B1", 3.0, "SUM(A1:A2)"), ("B1", 3.0, "SUM(A1:A2)"), ("C1", None, "A1+1"))
    odd = spark.createDataFrame([("f", "S", None, 1, "5", 5.0, None), ("f", "S", None, 2, None, None, "A1*10"), (None, "S", 1, 3, None, None, "A1*10"), ("f", None, 1, 4, "x", None, "2+2")], workbook.CELLS)
    got = sorted((r["col"], r["row"] or 0, r["status"], r["expected"]) for r in formulas.gate(cells.unionByName(odd)).collect())
    assert got == [(2, 0, "computed", 10.0), (2, 1, "ok", 3.0), (2, 1, "ok", 3.0), (3, 1, "computed", 0.0), (3, 1, "computed", 2.0), (4, 1, "wrong", 4.0)]


def test_a_chain_takes_a_round_a_step(spark, monkeypatch):
    monkeypatch.setattr(formulas, "COLLAPSE", 2)
    cells = sheet(spark, ("A1", 1.0, None), *[(f"A{i}", None, f"A{i - 1}*2") for i in range(2, 7)], ("B1", None, "SUM(A:A)"))
    got = {(r["col"], r["row"]): (r["status"], r["expected"]) for r in formulas.gate(cells).collect()}
    assert got == {(1, i): ("computed", 2.0 ** (i - 1)) for i in range(2, 7)} | {(2, 1): ("computed", 63.0)}


def test_pieces_of_a_point_and_levels_asked(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.intervals import around, level_of, pieces

    rows = spark.createDataFrame([(a, b) for a in range(1, 20) for b in range(a, 20)], "a int, b int").withColumn("p", pieces(F.col("a"), F.col("b")))
    held = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(21)))).withColumn("own", around(F.col("x"), F.array_distinct(F.transform("p", level_of))))
    shared = F.size(F.array_intersect("p", "own"))
    assert held.where(shared != F.when(F.col("x").between(F.col("a"), F.col("b")), 1).otherwise(0)).count() == 0
