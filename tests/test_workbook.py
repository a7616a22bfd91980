"""Workbooks, SQLite tables, locks, seeds, migrations."""

from __future__ import annotations

import sqlite3
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks, sqlite, workbook


def sheet_rows(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c double")


def test_written_workbooks_read_back_with_true_formulas(spark, tmp_path):
    df = spark.createDataFrame([("x & <y>", 10.0, 12.5), ("z", 4.0, None)], "name string, price double, offer double")
    path = str(tmp_path / "report.xlsx")
    formulas = {"spread": "{offer} - {price}"}
    workbook.write_workbook(path, {"Deals": df, "Other \"s\"": df.select("name")}, {"Deals": formulas})
    cells = workbook.cells(spark, path)
    assert {(r["sheet"], r["row"], r["col"], r["text"], r["number"]) for r in cells.where("row = 2").collect()} == {("Deals", 2, 1, "x & <y>", None), ("Deals", 2, 2, "10.0", 10.0), ("Deals", 2, 3, "12.5", 12.5), ("Deals", 2, 4, "2.5", 2.5), ('Other "s"', 2, 1, "x & <y>", None)}
    assert {r["formula"] for r in cells.where("col = 4 and row > 1").collect()} == {"C2 - B2", "C3 - B3"}
    assert workbook.formula_errors(cells, "Deals", formulas).count() == 0
    assert [tuple(r) for r in workbook.formula_errors(cells, "Deals", {"spread": "{offer} + {price}"}).collect()] == [(2, "spread")]
    assert {(r["sheet"], r["formulas"]) for r in workbook.formula_counts(cells).collect()} == {("Deals", 2), ('Other "s"', 0)}
    with pytest.raises(Exception, match="exist"):
        workbook.write_workbook(path, {"Deals": df})


def tracked(spark):
    def row(n, *texts):
        return [("f", "Market Log", n, i, str(t), float(t) if isinstance(t, float) else None, None) for i, t in enumerate(texts, 1) if t is not None]

    rows = [*row(4, "Date", "S&P 500 close", "NASDAQ"), *row(5, "Apr 20", 100.0, 200.0), *row(6, "Apr 21 2026", "n/d", 201.0), *row(7, "Apr 25", 1.0, 1.0), *row(8, "Total", 5.0), *row(9, "Apr 26", "CLOSED")]
    return spark.createDataFrame(rows, workbook.CELLS)


def test_tracked_prices_are_gated_and_missing_ones_counted(spark):
    days = sinks.calendar_rows(spark, "2026-04-01", "2026-04-30", {"2026-04-03": "Good Friday"})
    got = {(r["series_id"], r["obs_date"]): r["close"] for r in workbook.tracked_prices(tracked(spark), days).collect()}
    assert got == {("SP500", date(2026, 4, 20)): 100.0, ("NASDAQCOM", date(2026, 4, 20)): 200.0, ("SP500", date(2026, 4, 21)): None, ("NASDAQCOM", date(2026, 4, 21)): 201.0}
    assert {(r["row"], r["carries_a_price"]) for r in workbook.phantom_rows(tracked(spark), days).collect()} == {(7, True), (9, False)}
    assert workbook.column_number("AB7") == 28 and workbook.column_name(28) == "AB"


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "od d" (id INTEGER PRIMARY KEY, name TEXT, price REAL)')
        c.executemany('INSERT INTO "od d" VALUES (?, ?, ?)', [(i, f"n{i}" if i % 2 else None, i / 4) for i in range(1, 251)])
    monkeypatch.setattr(sqlite, "ROWS_PER_PARTITION", 100)
    got = sqlite.attached(spark, path, "od d")
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double")]
    assert got.count() == 250 and got.where("name is null").count() == 125 and got.agg(F.sum("price")).first()[0] == sum(range(1, 251)) / 4
    assert sqlite.attached(spark, str(tmp_path / "none.db"), "t", [(1,)], "id long").collect()[0]["id"] == 1


def test_a_held_lock_keeps_writers_out(spark, tmp_path):
    path, rows = str(tmp_path / "store"), spark.createDataFrame([(1, "a")], "k long, v string")
    with sinks.locked(spark, path), pytest.raises(sinks.Rejected, match="another writer"):
        sinks.append(spark, path, rows, ["k"])
    sinks.append(spark, path, rows, ["k"])
    with pytest.raises(sinks.Rejected, match="taken"):
        sinks.append(spark, path, rows, ["k"])
    sinks.append(spark, path, rows.withColumn("k", F.lit(2).cast("long")), ["k"])
    assert spark.read.parquet(path).count() == 2


def test_a_bad_record_keeps_its_whole_batch_out(spark, tmp_path):
    kind = "evidence_id string, event_id string, source_url string, stance string, statement string, publisher string, revises string"
    good, bad = ("e1", "v", "u", "supports", "s", "p", None), ("e2", "v", "u2", "supports", "t", "p", "nowhere")
    path = str(tmp_path / "ledger")
    with pytest.raises(sinks.Rejected, match="unknown_revision_target"):
        sinks.append_evidence(spark, path, spark.createDataFrame([good, bad], kind))
    sinks.append_evidence(spark, path, spark.createDataFrame([good], kind))
    with pytest.raises(sinks.Rejected, match="duplicate"):
        sinks.append_evidence(spark, path, spark.createDataFrame([good], kind))
    assert spark.read.parquet(path).count() == 1


def test_columns_with_values_are_not_dropped(spark):
    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(sinks.Rejected, match="values"):
        sinks.migrated(rows, "a int")
    assert sinks.migrated(rows.withColumn("b", F.lit(None).cast("string")), "a bigint, c int", {"c": 7}).collect()[0].asDict() == {"a": 1, "c": 7}


def test_requests_refuse_unknown_vintages(spark):
    rows = spark.createDataFrame([("A", None, None, "newest")], "series_id string, start string, end string, vintage string")
    with pytest.raises(Exception, match="vintage"):
        readers.series_requests(rows).collect()
