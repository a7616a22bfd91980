"""Stores with several writers, killed writers, merges that touch some buckets."""

from __future__ import annotations

import random
import threading
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import warehouse
from tidemark.sources import commits
from tidemark.sources.sinks import Rejected

ROWS = "k long, v string"


def test_two_writers_at_once_both_count_and_check_each_other(spark, tmp_path):
    path, outcome = str(tmp_path / "store"), []

    def write(name, keys):
        try:
            outcome.append((name, commits.append_keyed(spark, path, spark.createDataFrame([(k, name) for k in keys], ROWS), ["k"])))
        except Rejected:
            outcome.append((name, None))

    writers = [threading.Thread(target=write, args=a) for a in (("a", [1, 2]), ("b", [3, 4]), ("c", [4, 5]))]
    [w.start() for w in writers]
    [w.join() for w in writers]
    got = sorted(tuple(r) for r in commits.stored(spark, path, ROWS).collect())
    done = {n: number for n, number in outcome}
    assert (done["b"] is None) != (done["c"] is None) and sorted(n for n in done.values() if n) == [1, 2]
    assert got == sorted([(1, "a"), (2, "a"), *([(3, "b"), (4, "b")] if done["b"] else [(4, "c"), (5, "c")])])
    with pytest.raises(Rejected, match="parent"):
        commits.append_keyed(spark, path, spark.createDataFrame([(9, "x")], ROWS), ["k"], spark.createDataFrame([("y",)], "v string"), "v")
    assert len(list(Path(path, "data").iterdir())) == 2


def test_a_writer_that_another_overtakes_checks_again(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []

    def check(existing, rows):
        calls.append(existing.count())
        if len(calls) == 1:
            commits.append_keyed(spark, path, spark.createDataFrame([(1, "first")], ROWS), ["k"])

    assert commits.append(spark, path, spark.createDataFrame([(2, "second")], ROWS), check) == 2
    assert calls == [0, 1] and not commits.put(spark, path, 2, [])
    assert commits.stored(spark, path, ROWS).count() == 2


def test_a_killed_writer_blocks_nobody_and_is_swept(spark, tmp_path):
    path, row = str(tmp_path / "store"), spark.createDataFrame([(1, "a")], ROWS)
    row.write.parquet(f"{path}/data/dead")
    Path(path, "_commits").mkdir()
    Path(path, "_commits", "half.draft").write_text("[[")
    assert commits.stored(spark, path, ROWS).count() == 0
    commits.append_keyed(spark, path, row, ["k"])
    assert commits.swept(spark, path) == 0 and commits.swept(spark, path, hours=-1) == 1
    assert commits.stored(spark, path, ROWS).count() == 1


def test_evidence_keeps_its_ledgers_rules(spark, tmp_path):
    kind = "evidence_id string, event_id string, source_url string, stance string, statement string, publisher string, revises string"
    path, good = str(tmp_path / "ledger"), ("e1", "v", "u", "supports", "s", "p", None)
    with pytest.raises(Rejected, match="unknown_revision_target"):
        commits.append_evidence(spark, path, spark.createDataFrame([good, ("e2", "v", "u2", "supports", "t", "p", "nowhere")], kind))
    assert commits.append_evidence(spark, path, spark.createDataFrame([good], kind)) == 1
    with pytest.raises(Rejected, match="duplicate"):
        commits.append_evidence(spark, path, spark.createDataFrame([good], kind))


def test_merged_versions_are_those_of_all_snapshots(spark, tmp_path):
    rng, start = random.Random(9), date(2024, 1, 1)
    kind = "k long, day date, a string, b int"
    rows = [(k, start + timedelta(d), rng.choice(["x", "y", None]), rng.randrange(2)) for k in range(12) for d in range(12) if rng.random() < 0.7]
    path = str(tmp_path / "versions")
    frame = lambda some: spark.createDataFrame(some, kind)
    for first, last in ((0, 5), (5, 9), (5, 9), (9, 12)):  # the second batch comes twice
        part = [r for r in rows if start + timedelta(first) <= r[1] < start + timedelta(last)]
        commits.merge_versions(spark, path, frame(part), "k", "day", ["a", "b"], buckets=4)
    expected = warehouse.scd2_seen(frame(rows), "k", "day", ["a", "b"])
    schema = ", ".join(f"`{n}` {t}" for n, t in expected.dtypes)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(commits.stored(spark, path, schema)) == order(expected)
    late = [(0, start - timedelta(1), "x", 0)]
    with pytest.raises(Rejected, match="earlier"):
        commits.merge_versions(spark, path, frame(late), "k", "day", ["a", "b"], buckets=4)
    assert commits.merge_versions(spark, path, frame([]), "k", "day", ["a", "b"], buckets=4) == 5


def test_a_merge_reads_and_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    path, read = str(tmp_path / "store"), []

    def combine(old, batch):
        read.append(old.count())
        return batch.unionByName(old.join(batch.select("k"), "k", "left_anti"))

    base = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    commits.merge(spark, path, base, ["k"], ROWS, combine, buckets=64)
    before = dict(commits.snapshot(spark, path)[1])
    commits.merge(spark, path, base.where("k = 7").withColumn("v", F.lit("new")), ["k"], ROWS, combine, buckets=64)
    after = dict(commits.snapshot(spark, path)[1])
    assert read[0] == 0 and 0 < read[1] < 2000 / 64 * 2
    assert len(before) == len(after) == 64 and sum(before[b] != after[b] for b in before) == 1
    got = commits.stored(spark, path, ROWS)
    assert got.count() == 2000 and [tuple(r) for r in got.where("v = 'new'").collect()] == [(7, "new")]
