"""Phrase collocations by weighted acyclic automata: exact counts of all phrases of 1 to 4 words, per language.

A task sorts the n-grams of its texts into a count transducer: states are phrases, an arc adds a word and carries the
count of the longer phrase. It deals the transducer out by prefix range: all arcs of a state, which is all phrases that
differ in the last word only, go to the range in which the hash of the state's words falls (single words: of the word).
So a range holds at most a vocabulary of arcs of any one state, however often the state occurs. Spark shuffles the
slices; each range unions them, arc by arc, and sums their weights. What stays frequent is written as a minimal
transducer, built one sorted phrase after the other (Mihov and Maurel): equal ends are shared, counts stand as far ahead
as they can and the sum along a path is the phrase's count.

A candidate's parts lie in other ranges. Each range asks for the parts that it needs, once for each part; a range
composes such a list with its transducer and returns the counts. With the question goes the greatest count of a longer
phrase that holds the part, which is all that dropping contained phrases needs. Both trips carry frequent phrases only.

Words and pieces are those of the lower-cased text (A-Z only); an n-gram never leaves its piece. All sums are exact.

Defined cases: a null or empty text has no words; a null language is ``und``; rows that repeat count each; texts of any
length are counted whole, in one row of a task; equal scores go by count, then phrase; candidates need not exist (an
empty table gives no rows); other columns than text and lang are not looked at, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

LONGEST, LEAST, TOP, COVERED = 4, 30, 2000, 80
SCALE = 2_000_000
#: Words that a task counts together, bytes of text that it splits together, arcs that a range holds before it sums.
CHUNK_WORDS, SPLIT_BYTES, HELD_ARCS = 2_000_000, 4_000_000, 3_000_000

#: Delimiters of pieces become a byte that no UTF-8 text holds; what is left of white space is that between words.
BREAK = b"\xff"
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")
SLICE = "bucket int, lang string, blob binary"
MESSAGE = "bucket int, lang string, kind int, source int, total long, blob binary"
ROW = "bucket int, lang string, phrase string, a long, l long, r long, score long"

Phrase = tuple[bytes, ...]


def packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def unpacked(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


class Vocabulary(dict):
    """Word -> number from 1, in order of appearance; the break is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


def bucket_of(phrase: Phrase, lang: str, buckets: int) -> int:
    """The range that owns a phrase: by the hash of all words but the last, or of its only word."""
    return int(ranges([np.array([word_hash(w)], np.uint64) for w in phrase], lang, buckets)[0])


def ranges(hashes: list[np.ndarray], lang: str, buckets: int) -> np.ndarray:
    total = np.array([word_hash(lang.encode())], np.uint64)
    for h in hashes[:-1] or hashes:
        total = scrambled(total * np.uint64(0x9E3779B97F4A7C15) + h)
    return (total % np.uint64(buckets)).astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if x.size else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


Planes = tuple[str, int, bytes]


def planes(x: np.ndarray) -> Planes:
    """An array of whole numbers in the narrowest type, its bytes by place: those of equal place compress well."""
    x = narrow(x)
    return x.dtype.str, len(x), x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def whole(x: Planes) -> np.ndarray:
    kind, n, data = x
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).reshape(n) if n else np.zeros(0, kind)


class WordList:
    """Sorted words; any selection of them is written as what a word adds to the one before it."""

    PREFIX = 32  # bytes that are compared

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        heads = np.array([w[: self.PREFIX] for w in words], f"S{self.PREFIX}").view(np.uint8).reshape(len(words), self.PREFIX)
        same = np.logical_and.accumulate(heads[1:] == heads[:-1], axis=1).sum(axis=1)
        self.shared = np.concatenate([[0], np.minimum(same, np.minimum(self.length[1:], self.length[:-1]))])  # with the word before

    def written(self, used: np.ndarray) -> tuple[Planes, Planes, bytes]:
        shared = np.zeros(len(used), np.int64)
        if len(used) > 1:
            shared[1:] = np.minimum.reduceat(self.shared[: used[-1] + 1], used[:-1] + 1)
        more = self.length[used] - shared
        at = np.repeat(self.start[used] + shared - (np.cumsum(more) - more), more) + np.arange(more.sum())
        return planes(shared), planes(more), self.bytes[at].tobytes()


def read_words(shared: Planes, more: Planes, data: bytes) -> list[bytes]:
    words, word, at = [], b"", 0
    for k, n in zip(whole(shared).tolist(), whole(more).tolist()):
        word = word[:k] + data[at : at + n]
        at += n
        words.append(word)
    return words


def counted(numbers: np.ndarray) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For n = 1 to 4 the n-grams of a sequence of word numbers, sorted, as columns, and their counts."""
    padded = np.concatenate([numbers, np.zeros(LONGEST - 1, numbers.dtype)])
    columns = [numbers]
    for i in range(1, LONGEST):
        columns.append(np.where(columns[-1] > 0, padded[i : i + len(numbers)], 0))
    some = numbers > 0
    columns = [c[some] for c in columns]
    order = np.lexsort([columns[i].astype(np.int64) << 32 | columns[i + 1] for i in (2, 0)])
    columns = [c[order] for c in columns]
    changed, out = np.zeros(len(order), bool), []
    changed[:1] = True
    for n, column in enumerate(columns, 1):
        changed[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(changed)
        count = np.diff(np.append(first, len(order)))
        real = column[first] > 0
        out.append(([c[first[real]] for c in columns[:n]], count[real]))
    return out


def slices(numbers: np.ndarray, vocabulary: Vocabulary, lang: str, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The count transducer of a sequence of words, cut into prefix ranges: (range, slice)."""
    words = [BREAK, *sorted(w for w in vocabulary if w != BREAK)]
    if len(words) == 1:
        return
    rank = np.zeros(len(words), np.int32)
    rank[np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    numbers, listed = rank[numbers], WordList(words[1:])
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    levels = []
    for columns, count in counted(numbers):
        bucket = ranges([hashes[c] for c in columns], lang, buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        levels.append(([c[order] for c in columns], count[order], edges))
    new = np.zeros(len(words), np.int64)
    for b in range(buckets):
        mine = [([c[e[b] : e[b + 1]] for c in columns], count[e[b] : e[b + 1]]) for columns, count, e in levels]
        if not any(len(count) for _, count in mine):
            continue
        used = np.unique(np.concatenate([c for columns, _ in mine for c in columns]))
        new[used] = np.arange(len(used))
        out = []
        for columns, count in mine:  # states once, then their arcs
            opens = np.zeros(len(count), bool)
            opens[:1] = True
            for c in columns[:-1]:
                opens[1:] |= c[1:] != c[:-1]
            state = np.flatnonzero(opens)
            out.append(([planes(new[c[state]]) for c in columns[:-1]], planes(np.diff(np.append(state, len(count)))), planes(new[columns[-1]]), planes(count)))
        yield b, packed((listed.written(used - 1), out))


def shard_slices(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, lang, blob: the slices of each task's count transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, Vocabulary] = defaultdict(Vocabulary)
        numbers: dict[str, list[np.ndarray]] = defaultdict(list)
        waiting: dict[str, list[bytes]] = defaultdict(list)
        held = size = 0

        def split() -> int:
            found = 0
            for lang, texts in waiting.items():
                words = (BREAK + BREAK.join(texts) + BREAK).lower().translate(PIECES).replace(BREAK, b" \xff ").split()
                numbers[lang].append(vocabularies[lang].numbers(words))
                found += len(words)
            waiting.clear()
            return found

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in numbers.items():
                found = list(slices(np.concatenate(parts), vocabularies[lang], lang, buckets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([lang] * len(found)), pa.array([x for _, x in found], pa.binary())], names=["bucket", "lang", "blob"])
            numbers.clear()
            vocabularies.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                waiting[lang].append(text.as_py())
                size += len(waiting[lang][-1])
                if size >= SPLIT_BYTES:
                    held += split()
                    size = 0
                if held >= CHUNK_WORDS:
                    yield from out()
                    held = 0
        split()
        yield from out()

    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, SLICE)


def summed(columns: list[np.ndarray], count: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of ``columns`` (numbers below ``words``) once, with the sum of their counts."""
    width = max(1, words.bit_length())
    key, bits = columns[0].astype(np.uint64), width
    for c in columns[1:]:
        if bits + width > 64:
            values, key = np.unique(key, return_inverse=True)
            key, bits = key.astype(np.uint64), max(1, len(values).bit_length())
        key, bits = key << np.uint64(width) | c.astype(np.uint64), bits + width
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [c[order[first]] for c in columns], np.add.reduceat(count[order], first) if len(first) else count[:0]


class Union:
    """Slices of one range and language, united arc by arc."""

    def __init__(self) -> None:
        self.vocabulary = Vocabulary()
        self.levels: list[list[tuple[list[np.ndarray], np.ndarray]]] = [[] for _ in range(LONGEST)]
        self.held = 0

    def add(self, blob: bytes) -> None:
        words, levels = unpacked(blob)
        numbers = self.vocabulary.numbers(read_words(*words))
        for level, (states, fan, last, count) in zip(self.levels, levels):
            times = whole(fan)
            if len(times):
                level.append(([*(numbers[whole(s).repeat(times)] for s in states), numbers[whole(last)]], whole(count).astype(np.int64)))
                self.held += len(level[-1][1])
        if self.held > HELD_ARCS:
            self.levels = [[x] for x in self.totals()]
            self.held = sum(len(level[0][1]) for level in self.levels) // 2  # what can't shrink is summed half as often

    def totals(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        out = []
        for n, level in enumerate(self.levels, 1):
            columns = [np.concatenate([x[0][i] for x in level]) if level else np.zeros(0, np.int32) for i in range(n)]
            count = np.concatenate([x[1] for x in level]) if level else np.zeros(0, np.int64)
            out.append(summed(columns, count, len(self.vocabulary)))
        return out

    def frequent(self, least: int) -> tuple[list[tuple[Phrase, int]], int]:
        """Phrases with at least ``least`` places, sorted, with their counts, and how many words there are in all."""
        words, found, total = list(self.vocabulary), [], 0
        for n, (columns, count) in enumerate(self.totals()):
            total += int(count.sum()) if n == 0 else 0
            often = count >= least
            found += zip(zip(*([words[i] for i in c[often].tolist()] for c in columns)), count[often].tolist())
        return sorted(found), total


class Transducer:
    """A minimal acyclic transducer of sorted phrases; the outputs along a phrase's path sum to its count."""

    def __init__(self, phrases: Iterable[tuple[Phrase, int]]) -> None:
        self.states: list[tuple[int | None, dict[bytes, tuple[int, int]]]] = []  # final output, arcs: output, target
        known: dict[tuple, int] = {}
        path: list[list] = [[None, []]]  # states that may still get arcs: final output, arcs as [word, output, target]
        before: Phrase = ()

        def freeze(length: int) -> None:
            while len(path) > length + 1:
                final, arcs = path.pop()
                key = (final, tuple(map(tuple, arcs)))
                if key not in known:
                    known[key] = len(self.states)
                    self.states.append((final, {w: (out, target) for w, out, target in arcs}))
                path[-1][1][-1][2] = known[key]

        for phrase, count in phrases:
            same = 0
            while same < min(len(before), len(phrase)) and before[same] == phrase[same]:
                same += 1
            freeze(same)
            for i in range(same):  # what the shared arcs can't give moves on behind them
                arc, after = path[i][1][-1], path[i + 1]
                shared = min(arc[1], count)
                if rest := arc[1] - shared:
                    after[0] = None if after[0] is None else after[0] + rest
                    for x in after[1]:
                        x[1] += rest
                arc[1], count = shared, count - shared
            for word in phrase[same:]:
                path[-1][1].append([word, count, None])
                path.append([None, []])
                count = 0
            path[-1][0] = count
            before = phrase
        freeze(0)
        self.states.append((path[0][0], {w: (out, target) for w, out, target in path[0][1]}))

    def compose(self, phrases: Iterable[Phrase]) -> Iterator[tuple[Phrase, int]]:
        """The counts of sorted phrases that it holds; a shared beginning is walked once."""
        trail, before = [(self.states[-1], 0)], ()
        for phrase in phrases:
            same = 0
            while same < min(len(before), len(phrase), len(trail) - 1) and before[same] == phrase[same]:
                same += 1
            del trail[same + 1 :]
            for word in phrase[same:]:
                (_, arcs), total = trail[-1]
                if word not in arcs:
                    break
                out, target = arcs[word]
                trail.append((self.states[target], total + out))
            before = phrase
            (final, _), total = trail[-1]
            if len(trail) == len(phrase) + 1 and final is not None:
                yield phrase, total + final

    def phrases(self) -> Iterator[tuple[Phrase, int]]:
        todo: list[tuple[int, Phrase, int]] = [(len(self.states) - 1, (), 0)]
        while todo:
            at, phrase, total = todo.pop()
            final, arcs = self.states[at]
            if final is not None:
                yield phrase, total + final
            todo += [(target, (*phrase, w), total + out) for w, (out, target) in arcs.items()]


def messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "lang", "kind", "source", "total", "blob"])


def dealt(df: DataFrame, buckets: int, *order: str) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang", *order)


def united(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted slices -> for each range and language its words in all and the transducer of its frequent phrases."""
    own, union = None, Union()

    def out() -> Iterator[pa.RecordBatch]:
        found, total = union.frequent(least)
        yield messages([(*own, 0, own[0], total, packed(Transducer(found)))])

    for batch in batches:
        for key, blob in zip(zip(batch.column("bucket").to_pylist(), batch.column("lang").to_pylist()), batch.column("blob")):
            if key != own:
                if own:
                    yield from out()
                own, union = key, Union()
            union.add(blob.as_py())
    if own:
        yield from out()


def cuts(phrase: Phrase) -> list[tuple[Phrase, Phrase]]:
    return [(phrase[:k], phrase[k:]) for k in range(1, len(phrase))]


def inner(phrase: Phrase) -> set[Phrase]:
    """Shorter phrases of two words or more within ``phrase``."""
    return {phrase[i : i + n] for n in range(2, len(phrase)) for i in range(len(phrase) - n + 1)}


def questions(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Transducers -> for the ranges of the parts of their phrases: the parts, each with the greatest count of a phrase
    that holds it."""
    for batch in batches:
        for row in batch.to_pylist():
            wanted: dict[Phrase, int] = {}
            for phrase, count in unpacked(row["blob"]).phrases():
                for part in {x for cut in cuts(phrase) for x in cut} | inner(phrase):
                    wanted[part] = max(wanted.get(part, 0), count)
            by_range = defaultdict(list)
            for part in sorted(wanted):
                by_range[bucket_of(part, row["lang"], buckets)].append((part, wanted[part]))
            if by_range:
                yield messages([(b, row["lang"], 1, row["bucket"], 0, packed(parts)) for b, parts in by_range.items()])


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's transducer (kind 0) and the questions to it (1) -> the counts (1) to where the questions come from,
    and to itself the greatest count of a longer phrase of each phrase asked for (2)."""
    own, machine, cover = None, None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if cover:
                    yield messages([(*own, 2, own[0], 0, packed(cover))])
                own, machine, cover = (row["bucket"], row["lang"]), unpacked(row["blob"]), {}
                continue
            parts = unpacked(row["blob"])
            for part, count in parts:
                if len(part) > 1:
                    cover[part] = max(cover.get(part, 0), count)
            yield messages([(row["source"], row["lang"], 1, row["bucket"], 0, packed(list(machine.compose(p for p, _ in parts))))])
    if cover:
        yield messages([(*own, 2, own[0], 0, packed(cover))])


def judged(phrases: Iterable[tuple[Phrase, int]], counts: dict[Phrase, int], cover: dict[Phrase, int], covered: int) -> list[tuple]:
    """(score, a, phrase, l, r) of the candidates that no longer phrase stands for."""
    out = []
    for phrase, a in phrases:
        if len(phrase) < 2 or (phrase in cover and 100 * cover[phrase] >= covered * a):
            continue
        scored = [(SCALE * a // (counts[first] + counts[rest]), k, counts[first], counts[rest]) for k, (first, rest) in enumerate(cuts(phrase))]
        score, _, l, r = min(scored)
        out.append((score, a, b" ".join(phrase), l, r))
    return out


def best(batches: Iterator[pa.RecordBatch], covered: int, top: int) -> Iterator[pa.RecordBatch]:
    """Each range's transducer (kind 0), answers (1) and covering counts (2) -> its ``top`` candidates per language."""
    own, machine, counts, cover = None, None, {}, {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = sorted(judged(machine.phrases(), counts, cover, covered), key=lambda x: (-x[0], -x[1], x[2]))[:top]
        if rows:
            score, a, phrase, l, r = zip(*rows)
            kinds = (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4)
            columns = ([own[0]] * len(rows), [own[1]] * len(rows), [p.decode() for p in phrase], a, l, r, score)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in ROW.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if own:
                    yield from out()
                own, machine, counts, cover = (row["bucket"], row["lang"]), unpacked(row["blob"]), {}, {}
            elif row["kind"] == 1:
                counts.update(unpacked(row["blob"]))
            else:
                cover = unpacked(row["blob"])
    if own:
        yield from out()


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    machines = checkpointed(dealt(shard_slices(docs, n), n).mapInArrow(lambda batches: united(batches, least), MESSAGE))
    asked = machines.mapInArrow(lambda batches: questions(batches, n), MESSAGE)
    answered = dealt(machines.union(asked), n, "kind").mapInArrow(answers, MESSAGE)
    rows = dealt(machines.union(answered), n, "kind").mapInArrow(lambda batches: best(batches, covered, top), ROW)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within groups of ranges, so that no task sorts the candidates of all ranges
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.col("bucket") % 64).orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = machines.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query in DuckDB.
ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
grams AS (SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS len))),
f AS (SELECT lang, len, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (SELECT lang, phrase, len, f AS a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len)) AS k FROM f WHERE len > 1)),
scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, k, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f, array_to_string(ws[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, len + 1)) AS j FROM (SELECT *, unnest(range(1, len)) AS i FROM f WHERE len > 2)) WHERE j - i + 1 < len),
cover AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN cover c USING (lang, phrase) WHERE c.f IS NULL OR 100::HUGEINT * c.f < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
