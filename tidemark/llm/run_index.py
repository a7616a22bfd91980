"""Suffix-array dedup with a run-length index: each byte that a 100-byte string with an earlier start covers is removed.

What has to meet in a task is found by anchors. The anchor of a window of 100 bytes is the place of the 32 bytes within
it whose hash is smallest, so equal windows have equal anchors at the same distance. Consecutive windows with one anchor
are a snippet of at most 168 bytes. Tasks give out each snippet's anchor, a hash of its bytes and its place; Spark sorts
them by anchor. Of snippets with the same bytes the earliest goes on and the others are later ones. An anchor with one
kind of snippet is done; only snippets that share an anchor and differ (the ends of repeats, near copies) go on.

Those are brought together with their bytes, by anchor. For a batch of anchors a task builds a run-length index: the
Burrows-Wheeler transform of snippets as runs, with the text positions of both ends of each run sampled. The other
snippets are streamed against it from their last byte to their first, all in step: a byte that continues the run's match
is a step of the LF mapping, any other jumps to the nearest run of that byte above or below, whichever shares more, and
takes the position sampled there. That gives the matching statistics: at each byte the longest match with the index and
where it stands. A match of 100 bytes or more whose earliest occurrence comes first marks the window. Which snippets are
indexed and which are streamed goes by the bits of their order within an anchor: for any two there is a bit in which the
earlier one has 0 and is indexed while the later one has 1 and is streamed. The comparison is of bytes, not of hashes.

An anchor with very many kinds of snippets (a common line in ever other surroundings) isn't held in one task: its
windows go by two hashes of their own bytes instead, so that they spread.

Defined cases: null and empty texts have no bytes; texts below 100 bytes have no window; texts of any length are cut into
blocks that overlap; rows without an id come after all others; rows that repeat an id come in order of a hash of their
text; rows that repeat id and text are one document that stands several times and share one result; ties don't exist
beyond that; an empty table gives an empty result; other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

LENGTH, ANCHOR = 100, 32
#: Bytes hashed at once, bytes whose snippets are compared before they are shuffled, bytes in a run-length index.
BLOCK, COMBINED, INDEXED = 1 << 20, 16 << 20, 1 << 19
#: Kinds of snippets that an anchor may have in one task.
KINDS = 1000
#: Windows of anchors with more kinds that a task compares before it gives them out.
WINDOWS = 200_000

PLACED = "name long, span long, key_id long, key_hash long, place long"
FOUND = "kind int, name long, key_id long, key_hash long, place long"
SNIPPET = "name long, key_id long, key_hash long, place long, bytes binary"
RANGE = "key_id long, key_hash long, place long"

POSITION = np.uint64((1 << 21) - 1)  # within a block
BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def placed(lo: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """First window and number of windows as one long."""
    return lo.astype(np.int64) << 31 | cnt


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 31, place & ((1 << 31) - 1)


class Bytes:
    """Hashes of any span of a byte sequence, from prefix sums."""

    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE) -> None:
        symbols, powers, inverse = Bytes.tables.get(int(base), (None, np.ones(0, np.uint64), None))
        if len(powers) <= len(data):
            n = max(2 * len(data), BLOCK + LENGTH)
            back = np.uint64(pow(int(base), -1, 1 << 64))
            symbols = mix(np.arange(1, 257, dtype=np.uint64) * base)
            powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)]), dtype=np.uint64) for x in (base, back))
            Bytes.tables[int(base)] = symbols, powers, inverse
        self.symbols, self.inverse = symbols[data], inverse
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.symbols * powers[: len(data)], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def snippets_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces laid end to end: piece, first window within it, number of windows, anchor and hash of each snippet."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    spans = Bytes(data)
    h, width = spans.symbols, 1
    while width < ANCHOR:
        h = h[:-width] * np.uint64(pow(int(OTHER_BASE), width, 1 << 64)) + h[width:]
        width *= 2
    names = mix(h)
    least = (names & ~POSITION) | np.arange(len(names), dtype=np.uint64)
    choices, width = LENGTH - ANCHOR + 1, 1
    while 2 * width <= choices:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < choices:
        least = np.minimum(least[: width - choices], least[choices - width :])
    anchor = (least & POSITION).astype(np.int64)  # of the window at each place
    edge = np.zeros(len(data) + 1, np.int32)
    some = length >= LENGTH
    edge[start[some]] += 1
    edge[start[some] + length[some] - LENGTH + 1] -= 1
    window = np.flatnonzero(np.cumsum(edge)[: len(anchor)] > 0)
    at = anchor[window]
    opens = np.ones(len(window), bool)
    opens[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(opens)
    cnt = np.diff(np.append(first, len(window)))
    lo = window[first]
    piece = np.searchsorted(start, lo, side="right") - 1
    return piece, lo - start[piece], cnt, names[at[first]], spans.hash(lo, lo + cnt + LENGTH - 1)


def merged(key: list[np.ndarray], lo: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of windows sorted by document and start: which of them open a gapless stretch, and its windows."""
    opens = np.ones(len(lo), bool)
    opens[1:] = (lo[1:] != lo[:-1] + cnt[:-1]) | np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    first = np.flatnonzero(opens)
    return first, np.add.reduceat(cnt, first) if len(first) else cnt[:0]


def raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keys() -> list[Column]:
    """The place of a document in the order, and what tells it from others with its id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("key_id"), F.xxhash64(F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull()).alias("key_hash")]


def anchored(docs: DataFrame) -> DataFrame:
    """All snippets of each task that differ; places of later equal ones as complements, under names that spread them."""

    def out(texts: dict[tuple[int, int], bytes]) -> pa.RecordBatch | None:
        order = sorted(texts)
        own = np.array(order, np.int64).reshape(-1, 2)
        parts: list[tuple[np.ndarray, ...]] = []
        pieces: list[tuple[int, int, bytes]] = []  # document, offset, bytes

        def cut() -> None:
            length = np.array([len(p[2]) for p in pieces])
            data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
            piece, lo, cnt, name, span = snippets_of(data, np.cumsum(length) - length, length)
            parts.append((np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece] + lo, cnt, name.view(np.int64), span.view(np.int64)))
            pieces.clear()

        held = 0
        for i, key in enumerate(order):
            text = texts[key]
            for at in range(0, max(0, len(text) - LENGTH + 1), BLOCK // 2):
                pieces.append((i, at, text[at : at + BLOCK // 2 + LENGTH - 1]))
                held += len(pieces[-1][2])
                if held >= BLOCK // 2:
                    cut()
                    held = 0
        if pieces:
            cut()
        if not parts:
            return None
        doc, lo, cnt, name, span = (np.concatenate(c) for c in zip(*parts))
        rank = np.lexsort([span, name])  # stable, so the earliest comes first
        later = np.zeros(len(rank), bool)
        later[rank[1:]] = (name[rank[1:]] == name[rank[:-1]]) & (span[rank[1:]] == span[rank[:-1]])
        new = np.flatnonzero(~later)
        old = np.flatnonzero(later)
        first, windows = merged([doc[old]], lo[old], cnt[old])
        rows = np.concatenate([new, old[first]])
        place = np.concatenate([placed(lo[new], cnt[new]), ~placed(lo[old[first]], windows)])
        spread = mix((own[doc[old[first]], 1] + lo[old[first]]).view(np.uint64)).view(np.int64)
        columns = (np.concatenate([name[new], spread]), span[rows], own[doc[rows], 0], own[doc[rows], 1], place)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in PLACED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[int, int], bytes] = {}
        held = 0
        for batch in batches:
            for a, b, text in zip(batch.column("key_id").to_pylist(), batch.column("key_hash").to_pylist(), batch.column("text").cast(pa.binary())):
                texts[a, b] = text.as_py()
                held += len(texts[a, b])
                if held >= COMBINED:
                    if (got := out(texts)) is not None:
                        yield got
                    texts, held = {}, 0
        if texts and (got := out(texts)) is not None:
            yield got

    return docs.select(*keys(), "text").where(F.octet_length("text") >= LENGTH).mapInArrow(run, PLACED)


def rows_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names]).astype(np.int64, copy=False)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets sorted by anchor, hash and place -> kind 0: windows with an earlier occurrence; kind 1: the earliest of
    each kind of snippet, where an anchor has several; kind 2: where it has more than ``KINDS``."""
    names = [c.split()[0] for c in PLACED.split(", ")]
    held = np.zeros((5, 0), np.int64)  # kinds of the last anchor so far; of one with too many, only the last
    many: int | None = None  # an anchor with too many kinds

    def out(kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            columns = (np.full(rows.shape[1], kind, np.int32), rows[0], *rows[2:])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    def close(groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        if groups.shape[1]:
            _, at, size = np.unique(groups[0], return_inverse=True, return_counts=True)
            yield from out(1, groups[:, (size[at] > 1) & (size[at] <= KINDS)])
            yield from out(2, groups[:, size[at] > KINDS])

    for batch in batches:
        rows = rows_of(batch, names)
        known = rows[:, rows[4] < 0]
        known[4] = ~known[4]
        yield from out(0, known)
        rows = rows[:, rows[4] >= 0]
        if not rows.shape[1]:
            continue
        old = held.shape[1]
        rows = np.concatenate([held, rows], axis=1)
        head = np.ones(rows.shape[1], bool)
        head[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        own = np.flatnonzero(head)[np.cumsum(head) - 1]
        elsewhere = (rows[2:] != rows[2:, own]).any(axis=0)
        yield from out(0, rows[:, ~head & elsewhere])
        heads, fresh = rows[:, head], np.flatnonzero(head) >= old
        if many is not None and not (heads[0] == many).any():
            many = None
        if many is not None:  # its held kind went out before
            more = heads[:, (heads[0] == many) & fresh]
            yield from out(2, more)
            rest = heads[:, heads[0] != many]
            if not rest.shape[1]:
                held = heads[:, -1:]
                continue
            heads, many = rest, None
        last = heads[0] == heads[0, -1]
        yield from close(heads[:, ~last])
        held = heads[:, last]
        if held.shape[1] > KINDS:
            yield from out(2, held)
            many, held = int(held[0, -1]), held[:, -1:]
    if many is None:
        yield from close(held)


def travelling(docs: DataFrame) -> DataFrame:
    """doc_id, key_id, key_hash and the text compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = pa.array([press.compress(t) for t in raw(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key_id", "key_hash")), z], names=["doc_id", "key_id", "key_hash", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys(), "text").mapInArrow(run, "doc_id long, key_id long, key_hash long, z binary")


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the open places of theirs -> snippets with their bytes under their anchor's name, and windows of
    anchors with too many kinds under a hash, with another hash for bytes. Of equal windows in a task the earliest goes on."""
    unpress = zstandard.ZstdDecompressor()
    names = [c.split()[0] for c in SNIPPET.split(", ")]
    windows: list[tuple[np.ndarray, ...]] = []
    held = 0

    def compared() -> pa.RecordBatch:
        name, other, a, b, lo = (np.concatenate(c) for c in zip(*windows))
        windows.clear()
        order = np.lexsort([lo, b, a, other, name])
        name, other, a, b, lo = (c[order] for c in (name, other, a, b, lo))
        later = np.zeros(len(name), bool)
        later[1:] = (name[1:] == name[:-1]) & (other[1:] == other[:-1])
        own = np.flatnonzero(~later)[np.cumsum(~later) - 1]
        later &= (a != a[own]) | (b != b[own]) | (lo != lo[own])
        spread = mix((b + lo).view(np.uint64)).view(np.int64)
        place = placed(lo, np.ones(len(lo), np.int64))
        columns = [pa.array(c) for c in (np.where(later, spread, name), a, b, np.where(later, ~place, place))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in other], pa.binary())], names=names)

    for batch in batches:
        snippets = []
        for i in range(batch.num_rows):
            a, b, z, open_places = (batch.column(c)[i].as_py() for c in ("key_id", "key_hash", "z", "places"))
            text = unpress.decompress(z)
            often = []
            for x in open_places:
                lo, cnt = unplaced(x["place"])
                if x["kind"] == 1:
                    snippets.append((x["name"], a, b, x["place"], text[lo : lo + cnt + LENGTH - 1]))
                else:
                    often.append(np.arange(lo, lo + cnt))
            if often:
                data = np.frombuffer(text, np.uint8)
                lo = np.concatenate(often)
                hashes = [Bytes(data, base).hash(lo, lo + LENGTH).view(np.int64) for base in (BASE, OTHER_BASE)]
                windows.append((*hashes, np.full(len(lo), a, np.int64), np.full(len(lo), b, np.int64), lo))
                held += len(lo)
            if held >= WINDOWS:
                yield compared()
                held = 0
        if snippets:
            kinds = (*[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*snippets), kinds)], names=names)
    if windows:
        yield compared()


class RunIndex:
    """A run-length Burrows-Wheeler index of short texts, with sampled run ends.

    Symbols are bytes plus 1; each text ends in a terminator of its own, below all symbols, in the order of the texts.
    """

    def __init__(self, texts: list[bytes]) -> None:  # below 2**15 bytes each
        length = np.array([len(t) for t in texts])
        self.text = np.repeat(np.arange(len(texts)), length + 1)
        self.rest = np.repeat(np.cumsum(length + 1) - 1, length + 1) - np.arange(len(self.text))  # to its terminator
        symbol = np.zeros(len(self.text), np.int64)
        symbol[self.rest > 0] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.order, self.lcp = self.suffixes(symbol)
        before = symbol[self.order - 1]
        opens = np.ones(len(before), bool)
        opens[1:] = before[1:] != before[:-1]
        self.start = np.flatnonzero(opens)  # rows of the runs
        self.end = np.append(self.start[1:], len(before)) - 1
        self.head = before[self.start]
        self.first, self.last = self.order[self.start], self.order[self.end]  # positions sampled at both ends
        by_head = np.argsort(self.head, kind="stable")
        size = (self.end - self.start + 1)[by_head]
        self.lf = np.zeros(len(by_head), np.int64)
        self.lf[by_head] = np.cumsum(size) - size
        self.by_head, self.sought = by_head, self.head[by_head] * len(by_head) + by_head
        self.minima = [self.lcp]
        while 2 << (len(self.minima) - 1) <= len(self.lcp):
            step, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
        self.minima_at = np.concatenate([[0], np.cumsum([len(x) for x in self.minima])])
        self.minima = np.concatenate(self.minima)

    def suffixes(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, by doubling, and what each suffix shares with the one before it."""
        n, rest = len(symbol), self.rest
        packed = np.zeros(n, np.int64)
        for i in range(7):
            shifted = np.zeros(n, np.int64)
            shifted[: max(0, n - i)] = symbol[i:]
            packed = packed << 9 | np.where(rest > i, shifted, 0)
        order = np.lexsort([np.where(rest < 7, self.text + 1, 0), packed])
        tie = np.where(rest < 7, self.text + 1, 0)[order]
        new = np.ones(n, bool)
        new[1:] = (packed[order][1:] != packed[order][:-1]) | (tie[1:] != tie[:-1])
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        ranks, reach = [(7, rank)], 7
        while not new.all():
            after = np.zeros(n, np.int64)
            after[: max(0, n - reach)] = rank[reach:]
            key = rank << 32 | after
            order = np.argsort(key)
            key = key[order]
            new[1:] = key[1:] != key[:-1]
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            reach *= 2
            ranks.append((reach, rank))
        a, b = order[:-1].copy(), order[1:].copy()
        most = np.minimum(rest[a], rest[b])
        shared = np.zeros(n - 1, np.int64)
        for reach, rank in reversed(ranks[:-1] if len(ranks) > 1 else ranks):
            step = np.where(rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)], reach, 0)
            shared += step
        differ = packed[np.minimum(a + shared, n - 1)] ^ packed[np.minimum(b + shared, n - 1)]
        for i in range(1, 8):
            shared += (differ >> (63 - 9 * i)) == 0
        return order, np.concatenate([[0], np.minimum(shared, most)]).astype(np.int16)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """What the suffixes of the rows before ``lo`` and of ``hi`` share, lo <= hi."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        at = self.minima_at[level]
        return np.minimum(self.minima[at + lo], self.minima[at + hi - (1 << level) + 1])

    def matching_statistics(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the texts in ``data``: the longest match from there with an indexed text, and where it stands."""
        matched, where = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        row, place, run_of = (np.zeros(len(order), np.int64) for _ in range(3))
        size = np.zeros(len(order), np.int64)
        place += self.order[0]
        for step in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -step, side="left"))  # longer than step
            at = start[:m] + length[:m] - 1 - step
            symbol = data[at].astype(np.int64) + 1
            run_of = np.searchsorted(self.start, row[:m], side="right") - 1
            jump = np.flatnonzero(self.head[run_of] != symbol)
            if len(jump):
                c, q, s = symbol[jump], row[jump], size[jump]
                i = np.searchsorted(self.sought, c * len(self.head) + run_of[jump])
                up, down = self.by_head[np.maximum(i - 1, 0)], self.by_head[np.minimum(i, len(self.head) - 1)]
                has_up, has_down = (i > 0) & (self.head[up] == c), (i < len(self.head)) & (self.head[down] == c)
                shared_up = np.where(has_up, self.least(np.where(has_up, self.end[up] + 1, q), q), -1)
                shared_down = np.where(has_down, self.least(np.where(has_down, q + 1, q), np.where(has_down, self.start[down], q)), -1)
                upward = shared_up >= shared_down
                some = has_up | has_down
                to = np.where(upward, up, down)
                row[jump] = np.where(some, np.where(upward, self.end[up], self.start[down]), q)
                place[jump] = np.where(upward, self.last[up], self.first[down])
                size[jump] = np.where(some, np.minimum(s, np.where(upward, shared_up, shared_down)), -1)
                run_of[jump] = to
            found = size[:m] >= 0
            row[:m] = np.where(found, self.lf[run_of] + row[:m] - self.start[run_of], row[:m])
            place[:m] = np.where(found, place[:m] - 1, self.order[row[:m]])
            size[:m] += 1
            matched[at], where[at] = size[:m], place[:m]
        return matched, where

    def earliest(self, number: np.ndarray, length: int) -> np.ndarray:
        """By position: the least ``number`` of a text that has the ``length`` bytes from there; only where it has them."""
        opens = np.flatnonzero(self.lcp < length)
        whole = self.rest[self.order] >= length
        own = np.where(whole, number[self.text[self.order]], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(own, opens)
        out = np.zeros(len(own), np.int64)
        out[self.order] = np.repeat(least, np.diff(np.append(opens, len(own))))
        return out


def later_windows(texts: list[bytes], rank: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For texts in order: which of their windows an earlier text of the same anchor has. ``rank``: a text's number
    among those of its anchor, ``size``: how many there are."""
    later = [np.zeros(len(t) - LENGTH + 1, bool) for t in texts]
    bit = 0
    while (size > 1 << bit).any():
        here = size > 1 << bit
        indexed = np.flatnonzero(here & (rank >> bit & 1 == 0))
        streamed = np.array([i for i in np.flatnonzero(here & (rank >> bit & 1 == 1)) if not later[i].all()], np.int64)
        if len(streamed):
            index = RunIndex([texts[i] for i in indexed])
            first = index.earliest(indexed, LENGTH)
            length = np.array([len(texts[i]) for i in streamed])
            start = np.cumsum(length) - length
            matched, where = index.matching_statistics(np.frombuffer(b"".join(texts[i] for i in streamed), np.uint8), start, length)
            mark = (matched >= LENGTH) & (first[where] < np.repeat(streamed, length))
            for i, at in zip(streamed.tolist(), start.tolist()):
                later[i] |= mark[at : at + len(later[i])]
        bit += 1
    return later


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets and windows sorted by name and place -> ranges of windows with an earlier occurrence."""
    held: list[tuple[int, int, int, int, bytes]] = []  # whole anchors, and the last one so far
    size = 0
    window: tuple | None = None

    def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in RANGE.split(", ")])

    def indexed(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        name = np.array([r[0] for r in rows])
        opens = np.append(True, name[1:] != name[:-1])
        count = np.bincount(np.cumsum(opens) - 1)
        rank = np.arange(len(rows)) - np.repeat(np.flatnonzero(opens), count)
        found = []
        for row, later in zip(rows, later_windows([r[4] for r in rows], rank, np.repeat(count, count))):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
            found += [(row[1], row[2], (row[3] >> 31) + lo << 31 | hi - lo) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist())]
        if found:
            yield out(found)

    for batch in batches:
        known = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("name", "key_id", "key_hash", "place", "bytes"))):
            name, a, b, place, data = row
            if place < 0:
                known.append((a, b, ~place))
            elif len(data) < LENGTH:
                if window is None or window[0] != name:
                    window = row
                elif window[4] == data and window[1:4] != (a, b, place):
                    known.append((a, b, place))
            else:
                if held and held[-1][0] != name and size >= INDEXED:
                    yield from indexed(held)
                    held, size = [], 0
                if not held or held[-1][:4] != row[:4]:
                    held.append(row)
                    size += len(data)
        if known:
            yield out(known)
    if held:
        yield from indexed(held)


def later_ranges(docs: DataFrame) -> DataFrame:
    """key_id, key_hash, place: ranges of windows that also start earlier."""
    found = checkpointed(anchored(docs).repartition("name").sortWithinPartitions("name", "span", "key_id", "key_hash", "place").mapInArrow(settle, FOUND))
    places = found.where("kind > 0").groupBy("key_id", "key_hash").agg(F.collect_list(F.struct("kind", "name", "place")).alias("places"))
    joined = travelling(docs).join(places, ["key_id", "key_hash"]).select("key_id", "key_hash", "z", "places")
    matched = joined.mapInArrow(cut_out, SNIPPET).repartition("name").sortWithinPartitions("name", "key_id", "key_hash", "place").mapInArrow(match, RANGE)
    return found.where("kind = 0").select("key_id", "key_hash", "place").union(matched)


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes, one row per document."""
    ranges = later_ranges(docs).groupBy("key_id", "key_hash").agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        kinds = (*[pa.int64()] * 4, pa.string(), pa.binary())
        for batch in batches:
            rows = []
            for doc, z, places in zip(batch.column("doc_id").to_pylist(), batch.column("z"), batch.column("places").to_pylist()):
                text = unpress.decompress(z.as_py())
                kept, spans = text, 0
                if places:
                    lo, cnt = unplaced(np.array(places, np.int64))
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + cnt + LENGTH - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = travelling(docs).join(ranges, ["key_id", "key_hash"], "left").select("doc_id", "z", "places")
    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")


#: The query's columns in DuckDB; bytes as pairs of hexadecimal digits.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, hex(coalesce(text, '')) AS x FROM documents),
win AS (SELECT rid, i, md5(substring(x, (2 * i + 1)::INT, 200)) AS h FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
later AS (SELECT rid, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY rid, i) > 1),
runs AS (SELECT rid, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT rid, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM (SELECT rid, i, lag(i, 1, -1000) OVER (PARTITION BY rid ORDER BY i) AS p FROM later)) GROUP BY rid, g),
pieces AS (SELECT rid, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS before FROM runs),
cut AS (SELECT rid, count(*) AS n_spans, sum(hi - lo) AS gone, string_agg(substring(x, (2 * before + 1)::INT, (2 * (lo - before))::INT), '' ORDER BY lo) || substring(any_value(x), (2 * max(hi) + 1)::INT) AS kept FROM pieces JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)
"""
