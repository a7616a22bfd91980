"""Stores with several writers: data goes to folders of its own, and a numbered file names the folders that count.

A writer first writes its data, then puts the next number's file only if nobody did so before; if somebody did, it checks
again against what is there now. So nobody waits for anybody: what a killed writer leaves is folders that no file names,
which ``swept`` removes. Readers follow the last file and never see half a batch.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import Rejected, clashes, orphans
from tidemark.storage import removed

#: The bucket of what isn't in buckets.
WHOLE = -1
#: How often a writer tries to be next.
TRIES = 100


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = _files(spark, f"{path}/_commits")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _commit(spark: SparkSession, path: str, number: int) -> list[list]:
    where, files = _files(spark, f"{path}/_commits/{number:020}.json")
    stream = files.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def snapshot(spark: SparkSession, path: str) -> tuple[int, list[list]]:
    """The last commit's number (0 if there is none) and the pairs of bucket and folder that count."""
    numbers = _numbers(spark, path)
    return (numbers[-1], _commit(spark, path, numbers[-1])) if numbers else (0, [])


def put(spark: SparkSession, path: str, number: int, folders: list[list]) -> bool:
    """Makes ``folders`` the commit of that number, or says that there is one.

    The file appears whole or not at all: a local one by a hard link, others by a rename that doesn't overwrite, which the
    file system must do in one step, as HDFS does.
    """
    target, files = _files(spark, f"{path}/_commits/{number:020}.json")
    draft, _ = _files(spark, f"{path}/_commits/{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(folders).encode()))
    stream.close()
    jvm = spark._jvm
    try:
        if files.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, plain)
    except Exception:
        if not files.exists(target):
            raise
        return False
    finally:
        files.delete(draft, False)
    return True


def stored(spark: SparkSession, path: str, schema: str, folders: list[list] | None = None) -> DataFrame:
    """The rows of the last commit, or of the given pairs of bucket and folder."""
    found = snapshot(spark, path)[1] if folders is None else folders
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for _, f in found]) if found else spark.createDataFrame([], schema)


def _next(spark: SparkSession, path: str, attempt: Callable[[list[list]], list[list]]) -> int:
    """Commits what ``attempt`` makes of the folders that count, again for as long as another writer comes first."""
    for _ in range(TRIES):
        number, folders = snapshot(spark, path)
        if put(spark, path, number + 1, attempt(folders)):
            return number + 1
    raise Rejected(f"{TRIES} other commits came first")


def append(spark: SparkSession, path: str, batch: DataFrame, check: Callable[[DataFrame, DataFrame], None]) -> int:
    """Adds a batch; ``check(existing, batch)`` raises if it may not be added, then nothing of it counts. Returns the commit's number."""
    folder, schema = f"data/{uuid.uuid4().hex}", batch.schema
    batch.write.parquet(f"{path}/{folder}")
    written = spark.read.schema(schema).parquet(f"{path}/{folder}")

    def attempt(folders: list[list]) -> list[list]:
        check(stored(spark, path, schema, folders), written)
        return [*folders, [WHOLE, folder]]

    try:
        return _next(spark, path, attempt)
    except Rejected:
        removed(spark, f"{path}/{folder}")
        raise


def append_keyed(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], parents: DataFrame | None = None, parent_key: str | None = None) -> int:
    """Adds a batch whose keys are new, in the store and in the batch, and whose parents exist."""

    def check(existing: DataFrame, rows: DataFrame) -> None:
        if not clashes(existing, rows, key).isEmpty():
            raise Rejected(f"key {tuple(key)} is taken")
        if parents is not None and not orphans(rows, parents, parent_key).isEmpty():
            raise Rejected(f"no parent for {parent_key}")

    return append(spark, path, batch, check)


def append_evidence(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """Adds a batch to an evidence ledger whose rules hold for both together; all or nothing."""
    from tidemark.operators.review import ledger_violations

    def check(existing: DataFrame, rows: DataFrame) -> None:
        found = ledger_violations(existing.unionByName(rows)).join(rows.select("evidence_id").distinct(), "evidence_id", "left_semi")
        if broken := found.select("violations").distinct().take(5):
            raise Rejected("; ".join(r["violations"] for r in broken))

    return append(spark, path, batch, check)


def merge(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], schema: str, combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 256) -> int:
    """Puts ``combine(stored rows, batch)`` in place of the stored rows, in those of ``buckets`` only that the batch's keys fall in.

    ``combine`` treats each key by itself, and its result has the columns of ``schema``. The number of buckets is the
    store's for good. Other buckets are neither read nor written; a bucket that one key fills is written by several tasks.
    When another writer comes first, the work is done again only if it touched one of the same buckets.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = {r[0] for r in batch.select(bucket).distinct().collect()}
    made: dict[str, list] = {}

    def attempt(folders: list[list]) -> list[list]:
        mine = [f for f in folders if f[0] in touched]
        if made.get("of") != mine:
            if "folder" in made:
                removed(spark, f"{path}/{made['folder']}")
            made["of"], made["folder"] = mine, f"data/{uuid.uuid4().hex}"
            out = combine(stored(spark, path, schema, mine), batch).withColumn("_bucket", bucket)
            out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{made['folder']}")
            where, files = _files(spark, f"{path}/{made['folder']}")
            names = [s.getPath().getName() for s in files.listStatus(where)]
            made["new"] = sorted([int(n.removeprefix("_bucket=")), f"{made['folder']}/{n}"] for n in names if n.startswith("_bucket="))
        return [f for f in folders if f[0] not in touched] + made["new"]

    return _next(spark, path, attempt)


def merge_versions(spark: SparkSession, path: str, snapshots: DataFrame, key: str, at: str, attributes: Sequence[str], buckets: int = 256) -> int:
    """Takes snapshots into a store of versions (``scd2_seen``), or raises if one is late and differs from what is there."""
    from tidemark.operators.warehouse import late_snapshots, scd2_merged, scd2_seen

    like = scd2_seen(snapshots.limit(0), key, at, attributes)
    schema = ", ".join(f"`{n}` {t}" for n, t in like.dtypes)

    def combine(versions: DataFrame, batch: DataFrame) -> DataFrame:
        if not late_snapshots(versions, batch, key, at, attributes).isEmpty():
            raise Rejected("a snapshot is earlier than the last one of its key and differs from it")
        return scd2_merged(versions, batch, key, at, attributes).select(*like.columns)

    return merge(spark, path, snapshots, [key], schema, combine, buckets)


def swept(spark: SparkSession, path: str, hours: float = 24.0, keep: int = 10) -> int:
    """Removes all but the last ``keep`` commits, then folders that none of these names and that are older than ``hours``,
    which must be longer than any write or read takes. Returns how many folders went."""
    numbers = _numbers(spark, path)
    for n in numbers[:-keep]:
        removed(spark, f"{path}/_commits/{n:020}.json")
    named = {f for n in numbers[-keep:] for _, f in _commit(spark, path, n)}
    in_use = {"/".join(f.split("/")[:2]) for f in named}
    folder, files = _files(spark, f"{path}/data")
    gone, limit = 0, time.time() - hours * 3600
    for s in files.listStatus(folder) if files.exists(folder) else []:
        name = f"data/{s.getPath().getName()}"
        parts = [name] if name not in in_use else [f"{name}/{p.getPath().getName()}" for p in files.listStatus(s.getPath()) if p.isDirectory()]
        for part in parts:
            if part not in named and s.getModificationTime() / 1000 < limit:
                removed(spark, f"{path}/{part}")
                gone += 1
    return gone
