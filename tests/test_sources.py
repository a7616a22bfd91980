"""Readers, writers, streams."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tidemark.sources import readers, sinks
from tidemark.streaming import ingest


def put(path, payload):
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return str(path)


def test_observations(spark, tmp_path):
    rows = [{"date": "2026-04-20", "value": "1.5", "realtime_start": "2026-04-21", "realtime_end": "9999-12-31"}, {"date": "2026-04-21", "value": ".", "realtime_start": "2026-04-22", "realtime_end": "9999-12-31"}]
    got = readers.series_observations(spark, put(tmp_path / "a.json", {"observations": rows})).orderBy("obs_date").collect()
    assert [r["value"] for r in got] == [1.5, None]
    bad = readers.series_observations(spark, put(tmp_path / "b.json", {"observations": [rows[0] | {"value": "n/a"}]}))
    with pytest.raises(Exception, match="not a number"):
        bad.collect()


def test_filings(spark, tmp_path):
    recent = {"accessionNumber": ["a", "b", "c"], "form": ["8-K", "15-12G", "8-K"], "filingDate": ["2026-01-01", "2026-02-01", "2026-03-01"], "items": ["1.01,9.01", "", "1.02,2.01"]}
    rows = readers.filing_events(readers.filings(spark, put(tmp_path / "s.json", {"cik": "7", "filings": {"recent": recent}})))
    assert {(r["accession"], r["event"]) for r in rows.collect()} == {("a", "announcement"), ("b", "closed"), ("c", "closed"), ("c", "terminated"), ("c", "withdrawn")}
    assert {r["accession"]: r["resolution"] for r in readers.resolution(rows).collect()} == {"a": None, "b": "closed", "c": None}


def test_chart(spark, tmp_path):
    got = readers.chart_series(spark, put(tmp_path / "c.json", {"symbol": "X", "timestamp": [1767398400, 1767484800, 1767571200], "close": [10.0, None, -1.0]})).collect()
    assert [(r["session_date"], r["close"]) for r in got] == [(date(2026, 1, 2), 10.0)]


def test_refused_row_does_not_take_its_day(spark):
    rows = spark.createDataFrame([("d", date(2026, 1, 2), None, "", 1), ("d", date(2026, 1, 2), 5.0, "A", 2), ("d", date(2026, 1, 2), 6.0, "T", 3), ("d", date(2026, 1, 2), 7.0, None, 4)], "deal_id string, session_date date, price double, flag string, line int")
    got = readers.daily_rows(rows)
    assert [r["line"] for r in got.accepted.collect()] == [3]
    assert {r["line"]: r["reason"] for r in got.rejected.collect()} == {1: "missing_price", 2: "unusable_flag", 4: "duplicate_date"}


def test_feed(spark, tmp_path):
    good = dict.fromkeys(readers.FEED_REQUIRED, "x")
    path = put(tmp_path / "f.jsonl", "\n".join([json.dumps(good), "{oops", json.dumps(good | {"publisher": ""})]))
    got = readers.brief_feed(spark, path)
    assert got.accepted.count() == 1 and {r["reason"] for r in got.rejected.collect()} == {"invalid_json", "missing:publisher"}


def test_csv_empty_is_null(spark, tmp_path):
    assert readers.text_table(spark, put(tmp_path / "t.csv", "a,b\n1,\n")).collect()[0].asDict() == {"a": "1", "b": None}


def test_candidates(spark):
    hits = spark.createDataFrame([(1, "x", "c1", "2026-01-02", ["1.01"]), (2, "x", "c1", "2026-01-02", ["1.01"]), (1, "y", "c2", "2026-01-01", ["1.01"]), (1, "z", "c3", "2026-01-01", ["2.02"]), (1, "k", "c4", "2026-01-01", ["1.01"])], "query_no int, accession string, cik string, filed string, items array<string>")
    known = spark.createDataFrame([("k", "other")], "accession string, cik string")
    assert [(r["accession"], r["rank"]) for r in readers.candidate_queue(hits, known).orderBy("rank").collect()] == [("y", 1), ("x", 2)]


def test_unconfigured_provider_refuses():
    with pytest.raises(readers.Unconfigured):
        readers.unconfigured("prices")


def test_append_only_store(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    parents = spark.createDataFrame([("a",), ("b",)], "v string")
    sinks.append(spark, path, batch, ["k"], parents, "v")
    before = spark_rows(sinks.ledger_digest(spark.read.parquet(path)))
    with pytest.raises(sinks.Rejected, match="taken"):
        sinks.append(spark, path, batch, ["k"])
    with pytest.raises(sinks.Rejected, match="parent"):
        sinks.append(spark, path, batch.withColumn("k", F.col("k") + 10), ["k"], parents.limit(0), "v")
    assert spark_rows(sinks.ledger_digest(spark.read.parquet(path))) == before


def test_quarantine_names_every_fault(spark):
    rows = spark.createDataFrame([(1, None), (-1, None), (2, "x")], "n int, s string")
    got = sinks.validated(rows, {"negative": F.col("n") < 0, "no_source": F.col("s").isNull()})
    assert got.accepted.count() == 1 and {r["n"]: r["reason"] for r in got.rejected.collect()} == {1: "no_source", -1: "negative;no_source"}


def test_rulesets_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "signals")
    sinks.overwrite_ruleset(spark.createDataFrame([(1, "a"), (2, "b")], "x int, ruleset string"), path)
    sinks.overwrite_ruleset(spark.createDataFrame([(9, "a")], "x int, ruleset string"), path)
    assert {(r["x"], r["ruleset"]) for r in spark.read.parquet(path).collect()} == {(9, "a"), (2, "b")}


def test_stream_of_vintages_is_idempotent(spark, tmp_path):
    kind = "series_id string, obs_date date, value double, known_at timestamp_ntz"
    source, store = str(tmp_path / "in"), str(tmp_path / "out")
    d = date(2026, 1, 1)
    first = [("s", d, 1.0, datetime(2026, 1, 2)), ("s", d, 1.0, datetime(2026, 1, 3))]
    for i, rows in enumerate([first, [("s", d, 1.0, datetime(2026, 1, 4)), ("s", d, None, datetime(2026, 1, 5))]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        ingest.vintages_into(ingest.read_stream(spark, source, kind), store, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(store).count() == i + 1
    ingest.vintages_into(ingest.read_stream(spark, source, kind), store, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(store).count() == 2


def test_daily_closes_of_a_stream(spark, tmp_path):
    kind = "series_id string, ts timestamp, price double"
    source = str(tmp_path / "in")
    rows = [("s", datetime(2026, 1, 1, 9), 1.0), ("s", datetime(2026, 1, 1, 17), 3.0), ("s", datetime(2026, 1, 9), 5.0)]
    spark.createDataFrame(rows, kind).write.parquet(source)
    q = ingest.daily_closes(ingest.read_stream(spark, source, kind)).writeStream.outputMode("append").format("memory").queryName("closes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r["obs_date"], r["close"], r["n"]) for r in spark.sql("select * from closes").collect()] == [(date(2026, 1, 1), 2.0, 2)]


def test_price_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "m", date(2026, 1, 5), 2.0, datetime(2026, 1, 6)), ("d", "m", date(2026, 1, 2), 1.0, datetime(2026, 1, 3))], "deal_id string, source string, session_date date, price double, known_at timestamp_ntz")
    sinks.write_price_manifest(rows, str(tmp_path / "m"))
    got = readers.price_manifest(spark, str(tmp_path / "m" / "*.json")).orderBy("line")
    assert [(r["line"], r["session_date"], r["price"], r["known_at"]) for r in got.collect()] == [(0, date(2026, 1, 2), 1.0, datetime(2026, 1, 3)), (1, date(2026, 1, 5), 2.0, datetime(2026, 1, 6))]


def test_brief_items_are_untrusted(spark, tmp_path):
    path = put(tmp_path / "b.json", {"url": "https://x.example/b", "published_at": "2026-01-02T00:00:00", "items": [{"statement": "s", "claim_type": "occurred"}, {"statement": "t", "claim_type": "prediction"}]})
    got = readers.brief_items(spark, path).orderBy("source_url").collect()
    assert [r["source_url"] for r in got] == ["https://x.example/b#item-0", "https://x.example/b#item-1"] and {r["source_type"] for r in got} == {"ai_brief"}


def test_tampered_evidence_is_refused(spark, tmp_path):
    content = dict.fromkeys(readers.EVIDENCE_PARTS, "x")
    own = spark.range(1).select(readers.short_hash(*[F.lit("x")] * len(content), n=16)).first()[0]
    path = put(tmp_path / "e.jsonl", "\n".join([json.dumps(content | {"evidence_id": own}), json.dumps(content | {"evidence_id": own, "stance": "y"})]))
    got = readers.evidence_ledger(spark, path)
    assert got.accepted.count() == 1 and got.rejected.first()["stance"] == "y"
