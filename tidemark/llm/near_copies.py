"""Near-dedup at a Jaccard similarity of shingle sets, each link verified on the sets themselves.

Texts of equal shingle sets are one node. First nodes link by SimHash: fingerprints of their shingles within BITS bits are
found by their one-wildcard variants (simhash.links), and the links verified. At a similarity of 0.8 about 10 of 64 bits
differ, 17 for 99 % of pairs, which leaves segments of 7 bits that select nothing, so what SimHash leaves apart is looked
for by min-wise minima: each node is put under BANDS hashes of ROWS minima each, so that a pair of similarity 0.8 shares
none with probability (1 - 0.8^ROWS)^BANDS = 7e-6. Nodes that share a hash and are several components after SimHash are
verified in two rounds: against the least node of their group, pair by pair in a join; then groups that hold several
components yet are cut into blocks along the components, and a task compares two blocks of which not all is one
component, by the rarest shingles of their members. So whatever two nodes share a hash and are similar end in one
component, a group of near copies makes no pairs, and no task holds a group. Components are Spark rounds.

Defined cases are those of simhash: A-Z count as a-z; null, empty and blank texts are one class; fewer words than a
shingle: the whole sequence is the one shingle; a text of any length is read whole; repeated rows are one class; a pair
of exactly the threshold is similar; a null doc_id names a class only if nothing else is in it; an empty table gives an
empty result; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import arrow_map, checkpointed, fresh, repeated_groups, row_key, texts
from tidemark.llm.graph import components

BANDS, ROWS = 30, 5
#: Bits in which the fingerprints of a SimHash link differ at most.
BITS = 3
#: Shingles that meet the permutations at once.
SLICE = 4096
#: Shingles of a block of a group's members; a task holds two blocks, or what a single text has, if that is more.
BLOCK = 2_000_000


def shingle_set(text: str, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, n))


def bands(hashes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """One hash for each band of minima; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        x = (hashes[None, at : at + SLICE] ^ masks[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, BANDS)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if over half of the hashes have it."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def sketches(keyed: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``key_id, key_hash, doc_id, text`` -> the same without the text, ``node`` (a hash of the set), ``fp`` (its SimHash) and ``bands``."""
    masks = np.random.default_rng(seed).integers(0, 1 << 64, BANDS * ROWS, np.uint64)
    rest = ["key_id", "key_hash", "doc_id"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name in rest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle, seed) for t in texts(batch)]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 17) for s in sets], np.uint64).view(np.int64)
        fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
        found = pa.array([bands(s, masks).view(np.int64) for s in sets], pa.list_(pa.int64()))
        names = [f.split()[0] for f in fields.split(", ")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(nodes), pa.array(fps), found], names=[*names, "node", "fp", "bands"])

    return arrow_map(keyed, run, f"{fields}, node long, fp long, bands array<long>")


def sets_of(rows: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``node, text`` -> ``node, shingles``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingle_set(t, shingle, seed).view(np.int64) for t in texts(batch)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "shingles"])

    return arrow_map(rows.select("node", "text"), run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``a, b`` whose sets are as similar as ``threshold``."""
    both = pairs.join(sets.toDF("b", "of_b"), "b").join(sets.toDF("a", "of_a"), "a")
    shared = both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return shared.where(F.col("shared") / (F.size("of_a") + F.size("of_b") - F.col("shared")) >= threshold).select("a", "b")


def group_links(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links of similar members, one of side 0 and one of the last side, that connect their components as far as they are
    similar. Similar sets share one of their rarest shingles, as many of each as it could miss and one more."""
    _, own = np.unique(roots, return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rarity[token]
    tokens = [token[e - n : e] for e, n in zip(ends, sizes)]
    missed = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    rarest = [np.sort(t)[:k] for t, k in zip(tokens, missed)]
    others = np.flatnonzero(sides == sides.max())
    listed = np.concatenate([rarest[j] for j in others])
    order = np.argsort(listed, kind="stable")
    holders = np.repeat(others, missed[others])[order]
    starts = np.searchsorted(listed[order], np.arange(len(count) + 1))
    mine, out = np.zeros(len(count), bool), []
    for i in np.flatnonzero(sides == 0):
        near = np.unique(np.concatenate([holders[starts[t] : starts[t + 1]] for t in rarest[i]]))
        near = near[own[near] != own[i]]
        if not len(near):
            continue
        mine[tokens[i]] = True
        shared = np.add.reduceat(mine[np.concatenate([tokens[j] for j in near])].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        mine[tokens[i]] = False
        for j in near[shared / (sizes[i] + sizes[near] - shared) >= threshold]:
            if own[i] != own[j]:
                out.append((int(nodes[i]), int(nodes[j])))
                own[own == own[j]] = own[i]
    return out


def blocks(rows: DataFrame, limit: int) -> DataFrame:
    """``value, node, root, size`` -> ``value, node, root, block``: a value's nodes in the order of their roots, cut into blocks
    of about ``limit`` shingles. Rows are dealt out by ranges, so a value of any number of nodes is many tasks."""
    by = ["value", "root", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, filled = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            value, size = (batch.column(c).to_numpy() for c in ("value", "size"))
            before = np.cumsum(size) - size
            first = np.insert(value[1:] != value[:-1], 0, True)
            filling = before - before[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))]
            if value[0] == last:
                filling[value == last] += filled
            last, filled = value[-1], int(filling[-1] + size[-1])
            block = (batch.column("part").to_numpy() << 32) + filling // limit
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("value", "node", "root")), pa.array(block)], names=["value", "node", "root", "block"])

    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id().cast("long"))
    return checkpointed(ranged.mapInArrow(run, "value long, node long, root long, block long"))


def simhash_pairs(nodes: DataFrame, max_bits: int = BITS) -> DataFrame:
    """``node, fp`` -> ``a, b``: nodes of one fingerprint with the least of them, and the least of linked fingerprints."""
    least = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("a")))
    same = nodes.join(least, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = simhash.links(least.select("fp"), max_bits).toDF("x", "y")
    return same.union(near.join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y").select("a", "b"))


def links(members: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK, before: DataFrame | None = None) -> DataFrame:
    """``value, node`` (nodes under hashes that they share) -> ``a, b`` (links that connect all that are similar); ``before``
    holds links that are known, and groups that are one component by them are left out."""
    if before is not None:
        roots = checkpointed(components(before)).withColumnRenamed("root", "known")
        by_now = checkpointed(members.join(roots, "node", "left").select("value", "node", F.coalesce("known", "node").alias("known")))
        several = by_now.groupBy("value").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("value")
        members = checkpointed(by_now.join(several, "value", "left_semi").select("value", "node"))
    least = members.groupBy("value").agg(F.min("node").alias("a"))
    pairs = members.join(least, "value").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = checkpointed(verified(pairs, sets, threshold))
    first = first if before is None else first.union(before)
    known = checkpointed(components(first)).withColumnRenamed("root", "known")
    rooted = checkpointed(members.join(known, "node", "left").select("value", "node", F.coalesce("known", "node").alias("root")))
    open_ = rooted.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value")
    sized = rooted.join(open_, "value", "left_semi").join(sets.select("node", F.size("shingles").cast("long").alias("size")), "node")
    cut = blocks(sized.select("value", "node", "root", "size"), block)
    spans = cut.groupBy("value", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    both = spans.toDF("value", "p", "p_lo", "p_hi").join(spans.toDF("value", "q", "q_lo", "q_hi"), "value")
    tiles = both.where("p <= q and least(p_lo, q_lo) <> greatest(p_hi, q_hi)")
    sides = tiles.selectExpr("value", "p", "q", "explode(if(p = q, array(p), array(p, q))) AS block").withColumn("side", (F.col("block") != F.col("p")).cast("int"))
    rows = sides.join(cut, ["value", "block"]).join(sets, "node").select("value", "p", "q", "side", "node", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        tile = None

        def close() -> Iterator[pa.RecordBatch]:
            found = group_links(*(np.array([h[k] for h in held], np.int64) for k in (0, 1, 2)), [h[3] for h in held], threshold) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=["a", "b"])
            held.clear()

        for batch in batches:
            lists = batch.column("shingles")
            columns = [batch.column(c).to_pylist() for c in ("value", "p", "q", "node", "root", "side")]
            for i, (*own, node, root, side) in enumerate(zip(*columns)):
                if own != tile:
                    yield from close()
                    tile = own
                held.append((node, root, side, lists[i].values.to_numpy().copy()))
        yield from close()

    second = rows.repartition("value", "p", "q").sortWithinPartitions("value", "p", "q").mapInArrow(run, "a long, b long")
    return first.union(checkpointed(second))


def drop_near_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs``, one row of each class of what pairs of at least ``threshold`` connect: that of its smallest
    doc_id; of rows that repeat it, the one of the smallest text hash, and of equal rows one.
    """
    kid, khash = fresh(docs, "key_id", "key_hash")
    keyed = docs.select(*docs.columns, *(c.alias(a) for c, a in zip(row_key(), (kid, khash))))
    plain = keyed.select(F.col(kid).alias("key_id"), F.col(khash).alias("key_hash"), "doc_id", "text")
    known = checkpointed(sketches(plain, shingle, seed))
    order = F.struct(F.col("doc_id").isNull(), F.col("key_id"), F.col("key_hash"))
    per_node = checkpointed(known.groupBy("node").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    members = checkpointed(repeated_groups(per_node.select(F.explode("bands").alias("value"), "node"), ["value"]))
    pairs = checkpointed(simhash_pairs(per_node.select("node", "fp")))
    compared = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    stands = per_node.join(compared, "node").select("node", F.col("least")["key_id"].alias("key_id"), F.col("least")["key_hash"].alias("key_hash"))
    sets = checkpointed(sets_of(plain.join(stands, ["key_id", "key_hash"]).dropDuplicates(["node"]), shingle, seed))
    by_simhash = checkpointed(verified(pairs, sets, threshold))
    found = checkpointed(components(links(members, sets, threshold, block, by_simhash))).select("node", "root")
    rooted = per_node.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least")["key_id"].alias(kid), F.col("least")["key_hash"].alias(khash))
    return keyed.join(stay, [kid, khash], "left_semi").dropDuplicates([kid, khash]).select(*docs.columns)
