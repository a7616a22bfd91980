"""Substring dedup by recompression: every long run of words that occurs twice is found and removed.

Recompression rewrites each text in rounds. A round first names each run of one symbol by that symbol, then splits
all symbols into left and right ones by a hash of their name and the round, and names each pair of a left symbol
with a right one behind it by a hash of both. A name depends on nothing but what it stands for, so it is global: the
interior of equal substrings gets equal symbols everywhere, and only one symbol at either end of a substring can
fall to its neighbour in a round. For each window of ``window`` words the symbols that its words alone determine are
known, and the heaviest of them is its anchor: windows with equal words have equal anchors.

As a name is a hash of its content, all tasks agree on it without asking each other: the rounds run within the task
that holds a text, and the first exchange is that of the anchors. Spark groups anchors by name. Windows that share an
anchor occurrence are one row, with a hash of all the words they cover; where all rows of a name agree on that hash
the windows are verified repeats at once. Where they differ (the ends of repeats, and chance), the windows are compared
one by one by a hash of their words. Windows whose words determine no symbol are named by a hash of their words.
Names and word hashes come from two hashes of each word with seeds of their own, so what counts as equal agrees in two
independent lanes of 64 bits: words that collide in one of them don't in the other. Rows that are alike within a task
are verified there and stand for one before anything is shuffled, so a passage that many documents hold doesn't fill one
partition. Groups stream through sorted partitions; no pairs are made.

Defined cases: a null or empty text has no words; a text below ``window`` words has no window; a text of any length is
rewritten whole in one row of a task; rows that repeat id and text count as places of their own, so their windows are
repeats; ids may repeat; of equally heavy symbols the one of the greater hash is the anchor, then the leftmost; an empty
table gives an empty result; other columns than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, repeated_groups, row_key

WINDOW, ROUNDS = 35, 6
#: Words that are rewritten together, words whose hashes a task remembers, rows of one name that it holds at most.
BATCH_WORDS, REMEMBERED, HELD = 250_000, 400_000, 100_000

CHUNK = "name long, span long, key_id long, key_hash long, lo int, cnt int, n int"
FOUND = "kind int, name long, key_id long, key_hash long, lo int, cnt int"

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of the two hashes of a word: of names, and of what names are verified by.
SEEDS = (7, 1_000_003)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> place of its two 64-bit hashes, remembered up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.lanes = (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        for lane, seed in zip(self.lanes, SEEDS):
            lane.append(xxhash.xxh64_intdigest(word, seed))
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two rows: the words' hashes with either seed."""
        if len(self) >= REMEMBERED:
            self.clear()
            self.lanes = (array("Q"), array("Q"))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([np.frombuffer(lane, np.uint64)[at] for lane in self.lanes]) if words else np.zeros((2, 0), np.uint64)


class Spans:
    """Hashes of any span of a word sequence, from prefix sums."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Spans.powers) <= n:
            back = np.uint64(pow(int(BASE), -1, 1 << 64))
            Spans.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n + 1, BASE)]), dtype=np.uint64)
            Spans.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n + 1, back)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes) * Spans.powers[:n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words from ``start`` to before ``end``; equal words give equal hashes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * Spans.inverse[start] + (end - start).astype(np.uint64))


def anchors(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows at ``start``: the anchor's name, its place among the last round's symbols, and whether there is one."""
    name, weight = hashes, np.ones(len(hashes), np.int64)
    lo, hi = start, start + window - 1
    some = np.ones(len(start), bool)
    for r in range(rounds):
        first = np.ones(len(name), bool)  # of its run
        first[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.cumsum(first) - 1
        name, weight, doc, lo, hi = name[first], weight[first], doc[first], at[lo], at[hi]

        left = (mix(name ^ np.uint64(r * 2 + 1)) >> np.uint64(17)) & np.uint64(1) > 0
        pair = np.zeros(len(name), bool)  # starts at this symbol
        pair[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
        lo, hi = lo + ~left[lo], hi - left[hi]
        some &= lo <= hi
        lo, hi = np.minimum(lo, len(name) - 1), np.maximum(hi, 0)
        stays = np.ones(len(name), bool)
        stays[1:] = ~pair[:-1]
        after = np.roll(name, -1)
        name = np.where(pair, mix(name * np.uint64(3) + mix(after + BASE)), name)[stays]
        weight = (weight + np.where(pair, np.roll(weight, -1), 0))[stays]
        doc, at = doc[stays], np.cumsum(stays) - 1
        lo, hi = at[lo], at[hi]
    some &= lo <= hi
    lo, hi = np.where(some, lo, 0), np.where(some, hi, 0)
    # the heaviest symbol of each range, ties by name, then the leftmost: a table of maxima over powers of two
    n = len(name)
    value = (np.minimum(weight, 255).astype(np.uint64) << np.uint64(56)) | ((mix(name) >> np.uint64(40)) << np.uint64(32)) | (np.uint64(2**32 - 1) - np.arange(n, dtype=np.uint64))
    level = np.zeros(len(lo), np.int64)
    width = hi - lo + 1
    tables, k = [value], 0
    while width.size and (1 << (k + 1)) <= width.max():
        step, last = 1 << k, tables[-1]
        wider = last.copy()
        wider[: n - step] = np.maximum(last[: n - step], last[step:])
        tables.append(wider)
        k += 1
        level[width >= (1 << k)] = k
    best = np.zeros(len(lo), np.uint64)
    for k, t in enumerate(tables):
        m = level == k
        best[m] = np.maximum(t[lo[m]], t[hi[m] - (1 << k) + 1])
    place = (np.uint64(2**32 - 1) - (best & np.uint64(2**32 - 1))).astype(np.int64)
    place = np.where(some, place, 0)
    return name[place] if n else np.zeros(len(lo), np.uint64), place, some


def chunk_rows(hashes: np.ndarray, lengths: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (both hashes of each word): name, span hash, document, first window and number of
    windows of each row. Names are of the first hash, spans of the second."""
    hashes, seconds = hashes
    doc = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.cumsum(lengths) - lengths
    start = np.arange(len(hashes))
    start = start[start - offset[doc] + window <= lengths[doc]]
    if not len(start):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    spans = Spans(seconds)
    name, place, some = anchors(hashes, doc, start, window, rounds)
    own = spans.hash(start, start + window)
    if not some.all():  # named by their words
        name = np.where(some, name, Spans(hashes).hash(start, start + window))
    opens = np.ones(len(start), bool)
    opens[1:] = (place[1:] != place[:-1]) | ~some[1:] | ~some[:-1] | (start[1:] != start[:-1] + 1)
    row = np.cumsum(opens) - 1
    at = np.flatnonzero(opens)
    count = np.diff(np.append(at, len(start)))
    # a window that occurs twice within a row (a run has one anchor) also stands for itself
    order = np.lexsort((own, row))
    same = (row[order][1:] == row[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    first, count = np.concatenate([start[at], start[twice]]), np.concatenate([count, np.ones(len(twice), np.int64)])
    name = np.concatenate([name[at], name[twice]])
    return name, spans.hash(first, first + count + window - 1), doc[first], first - offset[doc[first]], count


def combined(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows with a count ``n``: of rows alike in the first two columns one goes on with n = 2, and all of them are given
    out as verified, n = 0, under names of their own that spread them over the partitions."""
    order = np.lexsort((columns[1], columns[0]))
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    size = np.bincount(np.cumsum(new) - 1)
    alike = np.repeat(size >= 2, size)
    heads = [c[new] for c in rows]
    spread = mix(rows[3][alike].view(np.uint64) + rows[4][alike].astype(np.uint64)).view(np.int64)
    verified = [spread, *(c[alike] for c in rows[1:])]
    n = np.concatenate([np.minimum(size, 2), np.zeros(int(alike.sum()), np.int64)]).astype(np.int32)
    return [*(np.concatenate(pair) for pair in zip(heads, verified)), n]


def group_found(rows: np.ndarray, seen: np.ndarray, mixed: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For whole groups of rows sorted by (name, span): what is found, and each (name, span)'s first row and size."""
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    sub = np.cumsum(new) - 1
    size = np.bincount(sub, seen)
    heads = np.flatnonzero(new)
    verified = size[sub] >= 2
    names, kinds = np.unique(rows[0, heads], return_counts=True)
    many = kinds[np.searchsorted(names, rows[0, heads])] >= 2
    if mixed:  # more of the first name came before
        many |= rows[0, heads] == rows[0, 0]
    found = [np.vstack([np.full((1, m.shape[1]), kind), m[[0, 2, 3, 4, 5]]]) for kind, m in ((0, rows[:, verified]), (1, rows[:, heads[many]]))]
    return found, heads, size


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, span) -> kind 0: verified ranges of windows; kind 1: ranges to compare window by window."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for m in parts:
            if m.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(k) for v, k in zip(m, kinds)], names=names)

    held, seen, mixed = np.zeros((6, 0), np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)])
        done = rows[:6, rows[6] == 0]
        yield from out([np.vstack([np.zeros((1, done.shape[1]), np.int64), done[[0, 2, 3, 4, 5]]])])
        rows = rows[:, rows[6] > 0]
        held, seen = np.concatenate([held, rows[:6]], axis=1), np.concatenate([seen, rows[6]])
        if not held.shape[1]:
            continue
        cut = int(np.flatnonzero(held[0] != held[0, -1])[-1]) + 1 if (held[0] != held[0, -1]).any() else 0
        if cut:
            yield from out(group_found(held[:, :cut], seen[:cut], mixed)[0])
            held, seen, mixed = held[:, cut:], seen[cut:], False
        if held.shape[1] > HELD:  # one name: give out what is known, keep a row of each span, or of the last
            found, heads, size = group_found(held, seen, mixed)
            yield from out(found[:1])
            held, seen = held[:, heads], size.astype(np.int64)
            if held.shape[1] > HELD:
                yield from out(found[1:])
                held, seen, mixed = held[:, -1:], seen[-1:], True
    if held.shape[1]:
        yield from out(group_found(held, seen, mixed)[0])


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *row_key(), F.col("text"))


def travelling(docs: DataFrame) -> DataFrame:
    """doc_id, key_id, key_hash and the text compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = pa.array([press.compress(t) for t in raw(part, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key_id", "key_hash")), z], names=["doc_id", "key_id", "key_hash", "z"])

    return keyed(docs).mapInArrow(run, "doc_id long, key_id long, key_hash long, z binary")


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """key_id, key_hash, lo, cnt: ranges of window starts whose words also start elsewhere, over all documents."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        keys: list[tuple[int, int]] = []
        hashed: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            name, span, doc, lo, cnt = chunk_rows(np.concatenate(hashed, axis=1), np.array([h.shape[1] for h in hashed]), window, rounds)
            if len(name):
                own = np.array(keys, np.int64)[doc]
                columns = combined([name.view(np.int64), span.view(np.int64), own[:, 0], own[:, 1], lo.astype(np.int32), cnt.astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in CHUNK.split(", ")])
            keys.clear()
            hashed.clear()

        held = 0
        for batch in batches:
            for a, b, text in zip(batch.column("key_id").to_pylist(), batch.column("key_hash").to_pylist(), raw(batch, "text")):
                words = text.split()
                if len(words) >= window:
                    keys.append((a, b))
                    hashed.append(cache.of(words))
                    held += len(words)
                if held >= BATCH_WORDS:
                    yield from out()
                    held = 0
        if hashed:
            yield from out()

    rows = keyed(docs).select("key_id", "key_hash", "text").mapInArrow(rewrite, CHUNK)
    found = checkpointed(rows.repartition("name").sortWithinPartitions("name", "span").mapInArrow(compare_groups, FOUND))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, unpress = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            held = 0
            for i, row in enumerate(batch.to_pylist()):
                spans = Spans(cache.of(unpress.decompress(row["z"]).split())[1])
                lo = np.array([r["lo"] for r in row["ranges"]], np.int64)
                cnt = np.array([r["cnt"] for r in row["ranges"]], np.int64)
                start = np.repeat(lo, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                name = np.repeat(np.array([r["name"] for r in row["ranges"]], np.int64), cnt)
                key = [np.full(len(start), row[k], np.int64) for k in ("key_id", "key_hash")]
                parts.append([name, spans.hash(start, start + window).view(np.int64), *key, start.astype(np.int32)])
                held += len(start)
                if held >= BATCH_WORDS or i == batch.num_rows - 1:
                    columns = combined([np.concatenate(c) for c in zip(*parts)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["name", "words", "key_id", "key_hash", "lo", "n"])
                    parts, held = [], 0

    open_ranges = found.where("kind = 1").groupBy("key_id", "key_hash").agg(F.collect_set(F.struct("name", "lo", "cnt")).alias("ranges"))
    one_each = travelling(docs).join(open_ranges, ["key_id", "key_hash"]).select("key_id", "key_hash", "z", "ranges")
    compared = repeated_groups(one_each.mapInArrow(windows, "name long, words long, key_id long, key_hash long, lo int, n int"), ["name", "words"], "n")
    verified = found.where("kind = 0").select("key_id", "key_hash", "lo", "cnt")
    return verified.union(compared.select("key_id", "key_hash", "lo", F.lit(1).alias("cnt")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text (its words joined by one space), one row per document."""
    ranges = repeated_windows(docs, window, rounds).groupBy("key_id", "key_hash").agg(F.collect_set(F.struct("lo", "cnt")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, z, found in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), batch.column("ranges").to_pylist()):
                words = unpress.decompress(z).split()
                n, gone = len(words), 0
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [r["lo"] for r in found], 1)
                    np.add.at(edge, [r["lo"] + r["cnt"] + window - 1 for r in found], -1)
                    keep = np.cumsum(edge)[:n] == 0
                    gone = n - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                kept = b" ".join(words)
                rows.append((doc, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = travelling(docs).join(ranges, ["key_id", "key_hash"], "left").select("doc_id", "z", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: The query's columns in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM rep),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.rid, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.rid = gone.rid AND words.p = gone.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
