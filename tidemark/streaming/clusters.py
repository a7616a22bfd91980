"""Evidence as a stream: each cluster's status history is kept up as records, revisions and late records arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.evidence import UNTRUSTED

#: Counts of a cluster, in the order in which they are kept; publishers are counted from their own records.
COUNTS = ("support", "against", "primary_for", "primary_against", "attributable", "withdrawn")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(n: dict[str, int]) -> str:
    """The first rule that fits a cluster's counts, as ``evidence.ladder`` has it."""
    if n["withdrawn"] > 0 and n["support"] == 0:
        return "RETRACTED"
    if n["primary_against"] > 0 or (n["against"] > 0 and n["primary_for"] == 0):
        return "DISPUTED"
    if n["primary_for"] > 0:
        return "VERIFIED_PRIMARY"
    if n["publishers"] >= 2:
        return "CORROBORATED_SECONDARY"
    return "ATTRIBUTED_CLAIM" if n["attributable"] > 0 else "UNCONFIRMED"


def history(steps: dict[int, list[int]], voices: dict[str, dict[int, int]]) -> dict[int, str]:
    """Statuses by the time they begin, from the changes of counts by time and of records by publisher and time."""
    publishers: dict[int, int] = {}
    for changes in voices.values():
        records = 0
        for at in sorted(changes):
            before, records = records, records + changes[at]
            publishers[at] = publishers.get(at, 0) + (records > 0) - (before > 0)
    n, out, last = dict.fromkeys((*COUNTS, "publishers"), 0), {}, None
    for at in sorted(steps):
        for c, change in zip(COUNTS, steps[at]):
            n[c] += change
        n["publishers"] += publishers.get(at, 0)
        if (now := decided(n)) != last:
            out[at] = last = now
    return out


def parts(record: tuple, until: int | None, retracted: int | None) -> Iterator[tuple[int, list[int], int]]:
    """When and how a record changes its cluster's counts, and the records of its publisher that speak for it."""
    known, publisher, trusted_kind, secondary, *flags = record
    live = until is None or until > known
    flags, secondary = ([*flags, 0], secondary) if live else ([0] * len(COUNTS), 0)
    yield known, flags, secondary
    if until is not None:
        yield until, [-f for f in flags], -secondary
    if retracted is not None:
        yield max(known, retracted), [0] * (len(COUNTS) - 1) + [trusted_kind], 0


class Cluster(StatefulProcessor):
    """What a cluster keeps: its records' flags, when each is first revised and retracted, changes by time, what was emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        flags = ", ".join(f"{c} long" for c in COUNTS[:-1])
        self.records = handle.getMapState("records", "evidence_id string", f"known long, publisher string, trusted_kind long, secondary long, {flags}")
        self.revisions = handle.getMapState("revisions", "evidence_id string", "until long, retracted long")
        self.steps = handle.getMapState("steps", "at long", ", ".join(f"{c} long" for c in COUNTS))
        self.voices = handle.getMapState("voices", "publisher string, at long", "change long")
        self.shown = handle.getMapState("shown", "at long", "status string")
        self.version = handle.getValueState("version", "n long")

    def _count(self, record: tuple, revised: tuple, sign: int) -> None:
        for at, flags, secondary in parts(record, *revised):
            old = self.steps.getValue((at,)) if self.steps.containsKey((at,)) else (0,) * len(COUNTS)
            self.steps.updateValue((at,), tuple(a + sign * b for a, b in zip(old, flags)))
            if secondary and record[1] is not None:
                place = (record[1], at)
                now = (self.voices.getValue(place)[0] if self.voices.containsKey(place) else 0) + sign * secondary
                self.voices.updateValue(place, (now,))

    def _revised(self, evidence_id: str) -> tuple:
        return tuple(self.revisions.getValue((evidence_id,))) if self.revisions.containsKey((evidence_id,)) else (None, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed = False
        for part in rows:
            for r in part.astype(object).where(part.notna(), None).to_dict("records"):
                if self.records.containsKey((r["evidence_id"],)):
                    continue
                changed = True
                record = (int(r["known"]), r["publisher"], *[int(r[c]) for c in ("trusted_kind", "secondary", *COUNTS[:-1])])
                self.records.updateValue((r["evidence_id"],), record)
                self._count(record, self._revised(r["evidence_id"]), 1)
                if (target := r["revises"]) is not None:
                    before = self._revised(target)
                    first = lambda old, new: new if old is None else min(old, new)
                    after = (first(before[0], record[0]), first(before[1], record[0]) if r["retracts"] else before[1])
                    if after != before:
                        self.revisions.updateValue((target,), after)
                        if self.records.containsKey((target,)):
                            held = tuple(self.records.getValue((target,)))
                            self._count(held, before, -1)
                            self._count(held, after, 1)
        if not changed:
            return
        voices: dict[str, dict[int, int]] = {}
        for (publisher, at), (change,) in self.voices.iterator():
            voices.setdefault(publisher, {})[at] = change
        now = history({k[0]: list(v) for k, v in self.steps.iterator()}, voices)
        shown = {k[0]: v[0] for k, v in self.shown.iterator()}
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        self.version.update((version,))
        out = []
        for at in sorted(now.keys() | shown.keys()):
            if now.get(at) != shown.get(at):
                out.append((key[0], at, now.get(at), version))
                if at in now:
                    self.shown.updateValue((at,), (now[at],))
                else:
                    self.shown.removeKey((at,))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "at", "status", "version"])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame) -> DataFrame:
    """event_id, as_of_utc, status, version from a stream of evidence (the columns that ``evidence.status_history`` reads).

    A row says that from a time on a cluster has a status, or with a null status that the change said for that time is
    none any more, as a late record moved it; ``current_history`` folds them. Records may come in any order, revisions
    before what they revise. A record whose id the cluster has is left out, so a batch may come twice; records without a
    cluster, an id or a known time are never known. State holds a row for each record, and a task at most the distinct
    times and publishers' times of a cluster that a batch touches. The session's state store must be the one of ``ROCKS``; it is
    set where the session has no other.
    """
    conf = stream.sparkSession.conf
    if ROCKS != conf.get(PROVIDER, "") and "HDFSBacked" in conf.get(PROVIDER, "HDFSBacked"):
        conf.set(PROVIDER, ROCKS)
    trusted_kind, occurred = ~F.col("source_type").isin(*UNTRUSTED), F.col("claim_type") == "occurred"
    trusted = trusted_kind & F.col("retrieved") & (F.coalesce("revision_kind", F.lit("")) != "retraction")
    supports, contradicts, primary = trusted & (F.col("stance") == "supports"), trusted & (F.col("stance") == "contradicts"), F.col("source_type") == "primary_official"
    flags: dict[str, Column] = {
        "trusted_kind": trusted_kind, "secondary": supports & (F.col("source_type") == "reputable_secondary") & occurred, "support": supports, "against": contradicts, "primary_for": supports & primary & occurred,
        "primary_against": contradicts & primary, "attributable": supports & F.col("claim_type").isin("attributed_statement", "scheduled", "occurred"),
    }
    rows = stream.where("known_at is not null and event_id is not null and evidence_id is not null").select(
        "event_id", F.col("evidence_id").cast("string").alias("evidence_id"), F.unix_micros(F.col("known_at").cast("timestamp")).alias("known"), F.col("publisher").cast("string").alias("publisher"),
        F.col("revises").cast("string").alias("revises"), F.coalesce(F.col("revision_kind") == "retraction", F.lit(False)).alias("retracts"), *[F.coalesce(x, F.lit(False)).cast("long").alias(c) for c, x in flags.items()],
    )
    kind = stream.schema["event_id"].dataType.simpleString()
    out = rows.groupBy("event_id").transformWithStateInPandas(Cluster(), f"event_id {kind}, at long, status string, version long", "Append", "None")
    return out.select("event_id", F.timestamp_micros("at").cast(stream.schema["known_at"].dataType).alias("as_of_utc"), "status", "version")


def statuses_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what changes to a Parquet store, each change once; ``checkpoint`` also holds the state."""
    return status_changes(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_history(emitted: DataFrame) -> DataFrame:
    """The status history that all changes emitted so far amount to: ``evidence.status_history`` of the records so far."""
    last = emitted.groupBy("event_id", "as_of_utc").agg(F.max(F.struct("version", "status")).alias("x"))
    return last.where("x.status is not null").select("event_id", "as_of_utc", F.col("x.status").alias("status"))
