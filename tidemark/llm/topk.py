"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of top lists.

Vectors are packed into blocks: candidate shards, and from the shards' query rows, query tiles. A row's place in the
shards is its identity. Blocks are numbered without gaps and dealt in turn to a grid of cells, so that a cell gets
``CELL_TILES`` tiles and ``CELL_SHARDS`` shards at most. It multiplies every tile by every shard and keeps the best k
of each query across its shards. The cells' lists of a tile are then merged, ``FAN_IN`` at a time, until one is left.
No pair of vectors is ever a row.

Components are floor(64 * x). Defined cases: a vector that is null, or holds a null or non-finite component, takes
no part; a null vec_id takes no part; vectors of different lengths don't meet, and empty ones score 0; only the
query's own row is no candidate of it, so rows that repeat an id find each other, and each repeated query row gets its
own list; ties go to the smaller vec_id, then to any of the equal rows; an empty table gives an empty result; other
columns than vec_id and embedding are not looked at, whatever their names; a vector of any length is one row, and a
block holds at most ``BLOCK_BYTES`` of components or one vector. Scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Vectors in a query tile and in a candidate shard; tiles and shards in a cell; lists merged at once.
TILE, SHARD, CELL_TILES, CELL_SHARDS, FAN_IN = 512, 2048, 4, 8, 8
#: Bytes of components in a block, unless one vector alone has more.
BLOCK_BYTES = 1 << 25

#: ``part`` is the task that made a block, ``at`` its number there; ``rows`` are the identities of its vectors.
BLOCK = "part long, at long, dim int, n int, ids binary, rows binary, asks binary, vectors binary"
LISTS = "tile long, dim int, part long, n int, query_ids binary, ids binary, scores binary"


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """``vec_id, asks, v`` with v = floor(64 * x) as doubles, for vectors without null or non-finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def floor(x: Column) -> Column:  # beyond 2^53 a double is whole, and may not fit into a long
        scaled = x.cast("double") * 64
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    known = vectors.select(F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("asks"), "embedding")
    return known.where("vec_id is not null and embedding is not null").where(good).select("vec_id", "asks", F.transform("embedding", floor).alias("v"))


class Blocks:
    """Gathers vectors of equal length into blocks of at most ``size``."""

    names = [c.split()[0] for c in BLOCK.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def __init__(self, size: int):
        self.size, self.part, self.made = size, TaskContext.get().partitionId(), 0
        self.held: dict[int, list[tuple]] = {}

    def add(self, key: int, row: int | None, asks: bool, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = self.held.setdefault(len(vector), [])
        held.append((key, row, asks, vector))
        if len(held) >= self.size or len(held) * len(vector) * 8 >= BLOCK_BYTES:
            yield self.out(len(vector))

    def out(self, dim: int) -> pa.RecordBatch:
        ids, rows, asks, vectors = zip(*self.held.pop(dim))
        own = (self.part << 43) + (self.made << 11) + np.arange(len(ids)) if rows[0] is None else np.array(rows)
        values = [self.part, self.made, dim, len(ids), np.array(ids, "<i8").tobytes(), own.astype("<i8").tobytes(), np.array(asks, bool).tobytes(), np.concatenate(vectors).astype("<f8").tobytes()]
        self.made += 1
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, self.kinds)], names=self.names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for dim in [*self.held]:
            yield self.out(dim)


def shard(ready: DataFrame, size: int) -> DataFrame:
    """The vectors in blocks, each with an identity of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(min(size, 1 << 11))
        for batch in batches:
            lists = batch.column("v")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (key, asks) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("asks").to_pylist())):
                yield from blocks.add(key, None, asks, flat[offsets[i] : offsets[i + 1]])
        yield from blocks.rest()

    return ready.mapInArrow(run, BLOCK)


def tile(shards: DataFrame, size: int) -> DataFrame:
    """The query rows of the shards in blocks, with the identities that they have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(size)
        for batch in batches:
            for r in batch.to_pylist():
                ids, rows, asks = (np.frombuffer(r[c], t) for c, t in (("ids", "<i8"), ("rows", "<i8"), ("asks", bool)))
                vectors = np.frombuffer(r["vectors"], "<f8").reshape(r["n"], r["dim"])
                for i in np.flatnonzero(asks):
                    yield from blocks.add(int(ids[i]), int(rows[i]), True, vectors[i])
        yield from blocks.rest()

    return shards.mapInArrow(run, BLOCK)


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """``blocks`` with ``block``, a number from 0 without gaps, and how many there are.

    One count for each task that made blocks passes the driver, nothing of the vectors.
    """
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = blocks.sparkSession.createDataFrame(before, "part long, before long")
    return blocks.join(starts, "part").withColumn("block", F.col("before") + F.col("at")).drop("part", "at", "before", "asks"), total


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products as longs, exact."""
    top = (np.abs(queries).max(initial=0) or 1) * (np.abs(candidates).max(initial=0) or 1) * max(queries.shape[1], 1)
    if top < 2**53:  # every sum is a whole number that a double holds
        return (queries @ candidates.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    found = exact(queries) @ exact(candidates).T if queries.shape[1] else np.zeros((len(queries), len(candidates)), object)
    return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to smaller ids: ids, scores, validity, each rows x (k at most).

    ``ids`` is one row for all, or of the shape of ``scores``.
    """
    ids = np.broadcast_to(ids, scores.shape)
    width = scores.shape[1]
    if width > k:
        low = np.iinfo(np.int64).min
        masked = np.where(valid, scores, low)
        bar = np.partition(masked, width - k, axis=1)[:, width - k]
        rows, cols = np.nonzero(valid & (masked >= bar[:, None]))
    else:
        rows, cols = np.nonzero(valid)
    s, i = scores[rows, cols], ids[rows, cols]
    order = np.lexsort((i, -s.astype(object) if s.size and s.min() == np.iinfo(np.int64).min else -s, rows))
    rows, s, i = rows[order], s[order], i[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    place = np.arange(len(rows)) - first[rows]
    take = place < k
    out_ids, out_scores, out_valid = np.zeros((len(scores), k), np.int64), np.zeros((len(scores), k), np.int64), np.zeros((len(scores), k), bool)
    at = rows[take], place[take]
    out_ids[at], out_scores[at], out_valid[at] = i[take], s[take], True
    return out_ids, out_scores, out_valid


#: Padding of a list shorter than k: a validity byte would do, but an id column of its own keeps lists plain.
def packed(ids: np.ndarray, scores: np.ndarray, valid: np.ndarray) -> tuple[bytes, bytes]:
    return np.stack([ids, valid.astype(np.int64)]).astype("<i8").tobytes(), scores.astype("<i8").tobytes()


def unpacked(ids: bytes, scores: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.frombuffer(ids, "<i8").reshape(2, n, -1)
    return both[0], np.frombuffer(scores, "<i8").reshape(n, -1), both[1] > 0


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query row."""
    made = checkpointed(shard(usable(vectors, is_query), SHARD))
    shards, n_shards = numbered(made)
    tiles, n_tiles = numbered(checkpointed(tile(made, TILE)))
    rows, cols = max(1, -(-n_tiles // CELL_TILES)), max(1, -(-n_shards // CELL_SHARDS))
    dealt = lambda n: (F.col("block") % n).cast("int")
    tiles_at = tiles.withColumn("row", dealt(rows)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    shards_at = shards.withColumn("col", dealt(cols)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def cross(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tile in left.itertuples():
            q = np.frombuffer(tile.vectors, "<f8").reshape(tile.n, tile.dim)
            q_rows = np.frombuffer(tile.rows, "<i8")
            kept = None
            for shard in right[right.dim == tile.dim].itertuples():
                c_ids = np.frombuffer(shard.ids, "<i8")
                s = products(q, np.frombuffer(shard.vectors, "<f8").reshape(shard.n, shard.dim))
                here = best(s, c_ids, q_rows[:, None] != np.frombuffer(shard.rows, "<i8")[None, :], k)
                kept = here if kept is None else merged([kept, here], k)
            if kept is not None:
                out.append((tile.block, tile.dim, int(key[1]), tile.n, tile.ids, *packed(*kept)))
        return pd.DataFrame(out, columns=["tile", "dim", "part", "n", "query_ids", "ids", "scores"])

    lists = tiles_at.groupBy("row", "col").cogroup(shards_at.groupBy("row", "col")).applyInPandas(cross, LISTS)
    parts = cols
    while parts > 1:
        parts = -(-parts // FAN_IN)

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            kept = merged([unpacked(r.ids, r.scores, r.n) for r in pdf.itertuples()], k)
            return pd.DataFrame([(first.tile, first.dim, int(key[2]), first.n, first.query_ids, *packed(*kept))], columns=pdf.columns)

        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("tile", "dim", "part").applyInPandas(merge, LISTS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, scores, valid = unpacked(r["ids"], r["scores"], r["n"])
                at, place = np.nonzero(valid)
                q = np.frombuffer(r["query_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array((place + 1).astype(np.int32)), pa.array(ids[at, place]), pa.array(scores[at, place])], names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows_of, "query_id long, rank int, vec_id long, score long")


def merged(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of several lists of the same queries."""
    ids, scores, valid = (np.concatenate([x[i] for x in lists], axis=1) for i in range(3))
    return best(scores, ids, valid, k)


#: The query's rows in DuckDB.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
