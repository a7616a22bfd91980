"""SimHash near-dedup by deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. Two fingerprints link
if at most ``max_bits`` bits differ. With (max_bits + 2) // 2 segments, one segment of a linked pair differs by one
bit at most, so both share a variant of that segment with one position wild. Every distinct fingerprint is put
under all such variants; rows with equal variants meet in a sorted stream, are verified on all 64 bits, and give
spanning links of what they form, never all pairs. Components over the links are Spark rounds (graph.components).

Segments that very many fingerprints share are counted first. What stands under a variant of such a segment is put
under the variants of the other bits as well, so that a group of one variant is dealt out by Spark over the groups of
all pairs of variants. A linked pair still shares one: as its segment differs by a bit at most, the other bits, cut
again, have a part that differs by a bit at most.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other;
fewer words than a shingle: the whole sequence is the one shingle; a text of any length is read whole in one row of a
task; a bit that exactly half of the shingles have is 0; repeated rows share a fingerprint, so a class; a null doc_id
takes part, but names a class only if nothing else is in it; an empty table gives an empty result; other columns than
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, checkpointed, fresh, row_key, texts
from tidemark.llm.graph import components

BITS = 64
#: Members of one variant that are compared pair by pair; more are dealt out by the variants of the other bits first.
DIRECT = 512
#: Fingerprints that share a segment before its variants are dealt out by the other bits: so many, or this part of all,
#: whichever is more; of such segments there are at most ``segments x HOT_PART``, so they may be known to every task.
HOT, HOT_PART = 65_536, 100_000


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):  # a long text's bits in slices
        part = hashes[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, text`` and whatever else but the text -> the same columns and ``fp`` (long, the same bits)."""
    rest = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle, seed) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps)], names=[*rest, "fp"])

    return arrow_map(docs, run, f"{fields}, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, one of which differs by at most one bit."""
    n = (max_bits + 2) // 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: np.ndarray, cuts: list[tuple[int, int]], hot: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(variant number, its value, variant number and value of the other bits, which fingerprints) for each fingerprint
    under each one-wildcard variant of each segment; the other bits count only where the segment, or that with the
    wildcard bit flipped, is ``hot``."""
    number = 0
    for (first, width), often in zip(cuts, hot):
        part = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        others = [b for b in range(BITS) if not first <= b < first + width]
        rest = [np.array(own, np.uint64) for own in np.array_split(others, len(cuts)) if len(own)]
        for bit in range(width):
            value = (part & ~np.uint64(1 << bit)).view(np.int64)
            split = np.isin(part, often) | np.isin(part ^ np.uint64(1 << bit), often) if len(often) and rest else np.zeros(len(fps), bool)
            at = np.flatnonzero(~split)
            yield np.full(len(at), number), value[at], np.full(len(at), -1), np.zeros(len(at), np.int64), at
            at, second = np.flatnonzero(split), 0
            for own in rest if len(at) else []:
                mask = np.bitwise_or.reduce(np.uint64(1) << own)
                for b in own:
                    yield np.full(len(at), number), value[at], np.full(len(at), second), (fps[at] & mask & ~(np.uint64(1) << b)).view(np.int64), at
                    second += 1
            number += 1


def near_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the classes that distinct fingerprints form where they differ in at most ``max_bits`` bits."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join_pairs(idx: np.ndarray) -> None:
        part = fps[idx]
        for at in range(0, len(idx), DIRECT):
            near = np.bitwise_count(part[at : at + DIRECT, None] ^ part[None, :]) <= max_bits
            for i, j in zip(*np.nonzero(np.triu(near, at + 1))):
                a, b = find(idx[at + i]), find(idx[j])
                if a != b:
                    root[max(a, b)] = min(a, b)

    if n <= DIRECT:
        join_pairs(np.arange(n))
    else:  # deal them out by variants of the bits in which they differ at all
        varying = [b for b in range(BITS) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> b & 1]
        parts = max(1, min((max_bits + 2) // 2, len(varying)))
        for own in np.array_split(np.array(varying, np.uint64), parts):
            mask = np.bitwise_or.reduce(np.uint64(1) << own)
            for bit in own:
                values = fps & mask & ~(np.uint64(1) << bit)
                order = np.argsort(values, kind="stable")
                for idx in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
                    if len(idx) > 1 and len({find(i) for i in idx.tolist()}) > 1:
                        join_pairs(idx)
    roots = np.array([find(i) for i in range(n)])
    linked = np.flatnonzero(roots != np.arange(n))
    return fps[linked], fps[roots[linked]]


def hot_segments(distinct: DataFrame, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each segment the values that very many fingerprints have, at most ``HOT_PART`` of them."""
    if len(cuts) == 1:  # distinct fingerprints share none
        return [np.zeros(0, np.uint64)]
    part = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    each = distinct.select(F.posexplode(F.array(*(part(*c) for c in cuts))).alias("segment", "value"))
    least = max(HOT, distinct.count() // HOT_PART)
    found = each.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()
    return [np.array(sorted(r["value"] for r in found if r["segment"] == i), np.uint64) for i in range(len(cuts))]


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """``fp`` (long, distinct) -> ``a, b``: links that connect exactly what fingerprints within ``max_bits`` bits connect."""
    cuts = segments(max_bits)
    hot = hot_segments(distinct, cuts)
    by = ["variant", "value", "second", "other"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for number, value, second, other, at in variants(fps, cuts, hot):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(value), pa.array(second.astype(np.int32)), pa.array(other), pa.array(fps[at].view(np.int64))], names=[*by, "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])], axis=1)
            last = np.flatnonzero((held[:4, :-1] != held[:4, 1:]).any(axis=0))
            if len(last):  # all but the last group are complete
                yield from links_of(held[:, : last[-1] + 1])
                held = held[:, last[-1] + 1 :]
        yield from links_of(held)

    def links_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = (rows[:4, :-1] == rows[:4, 1:]).all(axis=0)
        edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
        found = [near_links(rows[4, a : b + 1].view(np.uint64), max_bits) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        if found and (a := np.concatenate([x for x, _ in found])).size:
            b = np.concatenate([y for _, y in found])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    indexed = distinct.mapInArrow(index, "variant int, value long, second int, other long, fp long")
    return indexed.repartition(*by).sortWithinPartitions(*by).mapInArrow(join, "a long, b long").distinct()


def classes(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``fp, least`` (one row per fingerprint) -> ``fp, component`` (the smallest ``least`` of what it reaches)."""
    found = checkpointed(components(links(fps.select("fp"), max_bits)))
    rooted = fps.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), one row per document."""
    known = checkpointed(fingerprints(docs.select("doc_id", "text"), shingle, seed))
    per_fp = checkpointed(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return known.join(classes(per_fp, max_bits), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """The columns of ``docs``, one row of each class: that of its smallest doc_id; of rows that repeat it, the one of
    the smallest text, and of equal rows one. Documents without a word are one class. Rows stand once: a copy of a
    row that stays is dropped.
    """
    kid, khash, fp, best, n = fresh(docs, "key_id", "key_hash", "fp", "best", "n")
    keyed = docs.select(*docs.columns, *(c.alias(a) for c, a in zip(row_key(), (kid, khash))))
    known = checkpointed(fingerprints(keyed.select(F.col(kid).alias("key_id"), F.col(khash).alias("key_hash"), "doc_id", "text"), shingle, seed))
    order = lambda: F.struct(F.col("doc_id").isNull(), F.col("key_id"), F.col("key_hash"))
    per_fp = checkpointed(known.groupBy("fp").agg(F.min(order()).alias("least")))
    of_class = per_fp.join(classes(per_fp, max_bits), "fp").where(F.col("least") == F.col("component"))
    stay = of_class.select(F.col("least")["key_id"].alias(kid), F.col("least")["key_hash"].alias(khash)).distinct()
    rows = keyed.join(stay, [kid, khash], "left_semi")
    return rows.dropDuplicates([kid, khash]).select(*docs.columns)
