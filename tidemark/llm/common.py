"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import checkpointed, shared_folder  # noqa: F401

#: A word of most contracts: a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The complement, to split at.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path stays a string that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have yet, whatever extra columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that stand for a document in joins; rows that repeat both id and text share them."""
    return [
        F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("key_id"),
        F.xxhash64(F.col(text), F.col(doc_id).isNull(), F.col(text).isNull()).alias("key_hash"),
    ]


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % n


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def repeated_groups(df: DataFrame, by: list[str], stands_for: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``by`` columns (longs, no nulls) another row shares.

    One shuffle, a sort and a pass that holds one row back, so a group of any size streams through. The column
    ``stands_for`` tells how many rows a row stands for; other numbers than 1 pass by themselves.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last row so far, whether it was given out, and its key
        given = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            keys = [rows.column(c).to_numpy() for c in by]
            same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys]) if rows.num_rows > 1 else np.zeros(0, bool)
            after = np.append(same, False)  # its successor is like it
            before = np.insert(same, 0, False)
            keep = after | before
            if stands_for:
                keep |= rows.column(stands_for).to_numpy() != 1
            last_given = bool(keep[-1]) if rows.num_rows > 1 else given
            if held is not None and given:
                keep[0] = False
                if rows.num_rows == 1:
                    last_given = True
            out = rows.filter(pa.array(keep))
            if out.num_rows:
                yield from out.combine_chunks().to_batches()
            held, given = rows.slice(rows.num_rows - 1).combine_chunks(), last_given
        return

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, df.select(*names).schema)
