"""A replayed stream of evidence gives the batch's status history after each batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from tidemark.operators.evidence import status_history
from tidemark.streaming import clusters

KIND = "evidence_id long, event_id string, publisher string, stance string, claim_type string, source_type string, retrieved boolean, known_at timestamp_ntz, revises long, revision_kind string"


def records(n):
    rng, out = random.Random(17), []
    for i in range(n):
        revises = rng.randrange(n) if rng.random() < 0.35 else None
        out.append((
            i, rng.choice(["a", "b", "b", "b", None]), rng.choice(["p", "q", "r", None]), rng.choice(["supports", "supports", "contradicts", None]), rng.choice(["occurred", "occurred", "attributed_statement", "prediction"]),
            rng.choice(["reputable_secondary", "reputable_secondary", "primary_official", "ai_brief", None]), rng.choice([True, True, False]), rng.choice([None, *[datetime(2026, 1, 1) + timedelta(hours=rng.randrange(40)) for _ in range(6)]]),
            revises, rng.choice(["correction", "retraction"]) if revises is not None else None,
        ))
    return out


def test_a_replayed_stream_equals_the_batch_history(spark, tmp_path):
    rows = records(160)
    random.Random(2).shuffle(rows)  # late records, and revisions before what they revise
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    seen = []
    for part in (rows[:60], rows[60:110], rows[60:110], rows[110:]):  # the second batch comes twice
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        clusters.statuses_into(stream, out, checkpoint).awaitTermination()
        seen += [r for r in part if r not in seen]
        expected = status_history(spark.createDataFrame([r for r in seen if r[1] is not None], KIND))
        emitted = spark.read.parquet(out)
        assert sorted(map(tuple, clusters.current_history(emitted).collect())) == sorted(map(tuple, expected.collect()))
    assert emitted.where("status is null").count() > 0 and {r["status"] for r in expected.collect()} >= {"DISPUTED", "RETRACTED"}
    assert emitted.groupBy("event_id", "as_of_utc", "version").count().where("count > 1").count() == 0


def test_statuses_follow_the_first_rule_that_fits():
    steps = {5: [1, 0, 0, 0, 1, 0], 3: [0, 0, 0, 0, 0, 0], 9: [-1, 0, 0, 0, -1, 1]}
    assert clusters.history(steps, {}) == {3: "UNCONFIRMED", 5: "ATTRIBUTED_CLAIM", 9: "RETRACTED"}
    assert clusters.history({1: [2, 0, 0, 0, 2, 0], 2: [0] * 6}, {"p": {1: 1}, "q": {1: 1, 2: -1}}) == {1: "CORROBORATED_SECONDARY", 2: "ATTRIBUTED_CLAIM"}
