"""What is kept in the shared folder, and for how long."""

from __future__ import annotations

import gc
import time
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import evidence, ordering
from tidemark.storage import shared_folder


def left(spark) -> set[str]:
    """Files of checkpoints in the shared folder, once the cleaner has had a chance."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return {str(p) for p in folder.rglob("part-*") if ".crc" not in p.name}


def settled(spark, before: set[str], seconds: int = 40) -> set[str]:
    for _ in range(seconds * 2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not (new := left(spark) - before):
            return new
        time.sleep(0.5)
    return new


def test_checkpoints_go_with_the_tables_made_of_them(spark):
    before = left(spark)
    chain = evidence.revision_chain(spark.createDataFrame([(i, i - 1 if i % 9 else None) for i in range(90)], "evidence_id long, revises long"))
    placed = ordering.numbered(spark.range(1000).select(F.lit(1).alias("k"), "id"), ["k"], ["id"], "n")
    assert left(spark) - before
    assert chain.count() == 90 and placed.agg(F.max("n")).first()[0] == 999  # still readable
    del chain, placed
    assert not settled(spark, before)
