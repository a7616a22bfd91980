"""Collocations, filter audit and suffix dedup against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import agree
from tests.llm.test_operators import DOCS, LONG, docs, odd
from tidemark.llm import collocations, common, filter_audit, queries, run_index, substring

SF = "/root/testdata/sf0.001"
NEW = ("op11_collocations", "op12_filter_audit", "op13_suffix_dedup")


@pytest.mark.parametrize("name", NEW)
def test_agrees_with_duckdb(spark, name):
    agree(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


# --- collocations ---------------------------------------------------------------------------------------------------


def slow_collocations(rows, least, covered=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        often = [p for p, a in f.items() if len(p) > 1 and a >= least]
        for p in often:
            longer = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= covered * f[p] for q in longer):
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def test_collocations_against_plain_counting(spark):
    rng = random.Random(3)
    words = ["new", "york", "city", "hall", "The", "ÉTÉ", "日本", "a", "of"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, "  \t ")] + [("en", "new york city hall new york city hall")] * 20
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCS).repartition(5)
    for least, covered, top in ((3, 80, 2000), (5, 60, 7)):
        for buckets in (1, 5):
            got = sorted(map(tuple, collocations.collocations(df, least, covered, top, buckets).collect()))
            assert got == slow_collocations(rows, least, covered, top) and got


def test_collocations_of_odd_and_no_rows(spark):
    got = collocations.collocations(odd(spark).drop("n_chars"), least=30)
    rows = [tuple(r) for r in odd(spark).select("lang", "text").collect()]
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, 30)
    assert got.count() == 977  # the phrases of four words; they hold all shorter ones
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_chunks_of_any_size_give_the_same(spark, monkeypatch):
    rows = [("en", "a b c a b c d " * 30)] * 8 + [("de", "a b " * 50)] * 3
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCS)
    for name, value in (("CHUNK_WORDS", 50), ("SPLIT_BYTES", 40), ("HELD_ARCS", 5)):
        monkeypatch.setattr(collocations, name, value)
    machine = collocations.Union()
    for _, blob in (x for _, t in rows[:8] for x in collocations.slices(collocations.Vocabulary().numbers(t.encode().split()), word_numbers(t), "en", 1)):
        machine.add(blob)
    found, total = machine.frequent(1)
    assert total == 8 * 30 * 7 and dict(found)[b"a", b"b", b"c"] == 8 * 60
    assert sorted(map(tuple, collocations.collocations(df).collect())) == slow_collocations(rows, 30)


def test_words_are_written_by_what_they_add():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([1, 3, 9, 40, 300]))) for _ in range(80)})
    listed = collocations.WordList(words)
    for k in (1, 2, 17, len(words)):
        used = np.array(sorted(rng.sample(range(len(words)), k)))
        assert collocations.read_words(*listed.written(used)) == [words[i] for i in used]


def word_numbers(text):
    vocabulary = collocations.Vocabulary()
    vocabulary.numbers(text.encode().split())
    return vocabulary


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=4).map(tuple), st.integers(1, 10**15), max_size=40))
def test_transducer_keeps_every_count(counts):
    machine = collocations.Transducer(sorted(counts.items()))
    assert dict(machine.phrases()) == counts
    asked = sorted({*counts, (b"a",), (b"a", b"z"), (b"c", b"c", b"c", b"c")})
    assert dict(machine.compose(asked)) == counts
    assert len(machine.states) <= 1 + sum(map(len, counts))


def test_transducer_shares_equal_ends():
    ends = [(w, b"of", b"the") for w in (b"a", b"b", b"c", b"d")]
    assert len(collocations.Transducer([(p, 7) for p in ends]).states) == 4


def test_sums_pass_64_bits_keys():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 500) + ((1 << 40) if i % 2 else 0) for i in range(4)]
    rows, count = collocations.summed(columns, np.ones(500, np.int64), 1 << 41)
    assert Counter(zip(*(c.tolist() for c in columns))) == Counter(dict(zip(zip(*(c.tolist() for c in rows)), count.tolist())))


# --- filter audit ---------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 40)), max_size=60))
def test_positional_popcount(pairs):
    words, times = np.array([w for w, _ in pairs], np.uint32), np.array([t for _, t in pairs], np.int64)
    assert filter_audit.positional_popcount(words, times).tolist() == [sum(t for w, t in pairs if w >> b & 1) for b in range(32)]


def slow_audit(rows, labels):
    good, toxic = ({i for i, *ls in labels if i is not None and ls[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, s in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        parts[s or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, of in parts.items():
        taken = defaultdict(list)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in of if f in x[0] and not x[0] & before]
                taken[f].append(len(here))
                out.append((part, "".join(order), step, sum(not x[0] & {*before, f} for x in of), len(here), sum(f in x[0] and bool(x[0] & before) for x in of), sum(x[0] == {f} for x in of), sum(x[1] for x in here), sum(x[2] for x in here), f))
        out[-600:] = [(*r[:-1], sum(taken[r[-1]])) for r in out[-600:]]
    return sorted(out)


def test_audit_against_each_order_in_turn(spark):
    rng = random.Random(5)
    texts = [None, "", "short text", "A" * 80, "price $5", " ".join(map(str, range(60))), " ".join(["same"] * 70), "Loud " * 60 + "#", " ".join(f"w{i}" for i in range(49)) + " |", LONG]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(200)] + [(5, texts[5], "a")] * 4
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(20)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).withColumns({c: F.lit("x") for c in ("part", "n", "times", "failed", "id", "good")}).repartition(4)
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"part": F.lit(1), "same": F.lit(2)})
    got = sorted(map(tuple, filter_audit.audit(df, ls).collect()))
    assert got == slow_audit(rows, labels) and len(got) == 3 * 600


def test_audit_of_no_rows(spark):
    labels = common.table(spark, SF, "labels")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    assert filter_audit.audit(odd(spark), labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# --- suffix dedup ---------------------------------------------------------------------------------------------------


def slow_dedup(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking up every window; rows are in order of their ids."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), len(data) - len(kept), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n=60):
    """Texts with exact and near copies, shared passages of about the window's length, and periodic stretches."""
    rng = random.Random(seed)
    words = [*(f"w{i}" for i in range(300)), "naïve", "東京", "x"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(k) for k in (18, 24, 30, 60, 200)]
    texts = [None, "", "ab", "a" * 99, "a" * 100, "a" * 101, "a" * 400, "ab" * 300]
    for _ in range(n):
        parts = [prose(rng.randint(0, 25)) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 6))]
        texts.append(" ".join(parts))
        if rng.random() < 0.3:
            copy = list(rng.choice([t for t in texts if t]))
            copy[rng.randrange(len(copy))] = "#"
            texts.append("".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_against_all_windows(spark, seed):
    rows = passages(seed)
    got = run_index.remove_repeats(docs(spark, [(i, t, "s") for i, t in rows], parts=5))
    assert sorted(tuple(r)[:5] for r in got.collect()) == slow_dedup(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


@pytest.mark.parametrize("changed", [{"KINDS": 1}, {"KINDS": 3, "WINDOWS": 50}, {"COMBINED": 500, "INDEXED": 200}, {"BLOCK": 512}])
def test_bounds_change_nothing(spark, monkeypatch, changed):
    """Anchors with too many kinds, small batches and long texts in blocks give the same result."""
    rows = passages(7)
    for name, value in changed.items():
        monkeypatch.setattr(run_index, name, value)
    batches = run_index.anchored.__globals__  # what tasks see is pickled by reference to the module, so run it here
    assert all(batches[name] == value for name, value in changed.items())
    df = docs(spark, [(i, t, "s") for i, t in rows], parts=3)
    assert local_dedup(df) == slow_dedup(rows)


def local_dedup(df):
    """The operator's steps over Arrow batches in this process, where the bounds are patched."""
    import pyarrow as pa

    texts = {(r["doc_id"], 0): (r["text"] or "").encode() for r in df.collect()}
    rows = {}

    class Frame:
        def select(self, *_):
            return self

        def where(self, _):
            return self

        def mapInArrow(self, run, schema):
            some = [(k, t) for k, t in texts.items() if len(t) >= 100]
            thirds = [some[i::3] for i in range(3)]
            rows["anchored"] = [b for part in thirds for b in run(iter([pa.RecordBatch.from_pydict({"key_id": pa.array([k[0] for k, _ in part], pa.int64()), "key_hash": pa.array([0] * len(part), pa.int64()), "text": pa.array([t for _, t in part], pa.binary())})]))]
            return self

    run_index.anchored(Frame())
    table = pa.Table.from_batches(rows["anchored"]).sort_by([(c, "ascending") for c in ("name", "span", "key_id", "key_hash", "place")])
    found = pa.Table.from_batches(list(run_index.settle(table.to_batches(max_chunksize=7)))).to_pylist()
    import zstandard

    press = zstandard.ZstdCompressor()
    opened = defaultdict(list)
    for r in found:
        if r["kind"]:
            opened[r["key_id"]].append({k: r[k] for k in ("kind", "name", "place")})
    joined = pa.RecordBatch.from_pylist([{"key_id": k, "key_hash": 0, "z": press.compress(texts[k, 0]), "places": v} for k, v in opened.items()])
    snippets = pa.Table.from_batches(list(run_index.cut_out(iter([joined])))).sort_by([(c, "ascending") for c in ("name", "key_id", "key_hash", "place")])
    ranges = [r for b in run_index.match(iter(snippets.to_batches(max_chunksize=11))) for r in b.to_pylist()] + [r for r in found if not r["kind"]]
    out = []
    for (doc, _), data in sorted(texts.items()):
        gone = bytearray(len(data))
        for r in ranges:
            if r["key_id"] == doc:
                lo, cnt = run_index.unplaced(r["place"])
                gone[lo : lo + cnt + 99] = b"\1" * (cnt + 99)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), len(data) - len(kept), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_of_odd_and_no_rows(spark):
    got = sorted((r[:5] for r in map(tuple, run_index.remove_repeats(odd(spark)).collect())), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = []
    for i, t in ((r["doc_id"], r["text"]) for r in odd(spark).collect()):
        expected.append(slow_dedup([(i, t)])[0] if len(t or "") > 100 else (i, len((t or "").encode()), 0, 0, sha(t)))
    assert got == sorted(expected, key=str)
    assert run_index.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_rows_that_repeat_id_and_text_share_one_result(spark):
    text = " ".join(f"word{i}" for i in range(40))
    got = run_index.remove_repeats(docs(spark, [(2, text), (2, text), (3, text), (None, text)], parts=2))
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in got.collect()) == [(2, 0), (2, 0), (3, len(text)), (9, len(text))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=6), st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=4))
def test_matching_statistics(texts, patterns):
    index = run_index.RunIndex([t.encode() for t in texts])
    length = np.array([len(p) for p in patterns])
    matched, where = index.matching_statistics(np.frombuffer("".join(patterns).encode(), np.uint8), np.cumsum(length) - length, length)
    laid = "".join(t + "$" for t in texts)
    at = 0
    for p in patterns:
        for i in range(len(p)):
            longest = max(n for n in range(len(p) - i + 1) if n == 0 or any(p[i : i + n] in t for t in texts))
            assert matched[at] == longest and (not longest or laid[where[at] : where[at] + longest] == p[i : i + longest])
            at += 1
    assert len(index.start) <= len(index.order) and (index.order[index.start] == index.first).all() and (index.order[index.end] == index.last).all()


# --- substring dedup: two lanes ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("lane", [0, 1])
def test_words_that_collide_in_one_hash_are_told_apart(monkeypatch, lane):
    """Two passages that differ in words whose hash of one seed is the same are no repeats."""
    real = substring.xxhash.xxh64_intdigest

    class Colliding:
        @staticmethod
        def xxh64_intdigest(word, seed):
            return 42 if seed == substring.SEEDS[lane] and word in (b"left", b"right") else real(word, seed)

    monkeypatch.setattr(substring, "xxhash", Colliding)
    rng = random.Random(1)
    before, behind = ([b"w%d" % rng.randrange(10**6) for _ in range(20)] for _ in range(2))
    both = [[*before, word, *behind] for word in (b"left", b"right", b"left")]
    cache = substring.WordHashes()
    name, span, doc, lo, cnt = substring.chunk_rows(np.concatenate([cache.of(w) for w in both], axis=1), np.array([41, 41, 41]), 35, 6)
    keys = defaultdict(set)
    for n, s, d, at, c in zip(name.tolist(), span.tolist(), doc.tolist(), lo.tolist(), cnt.tolist()):
        keys[n, s, c].add((d, at))
    assert all({d for d, _ in places} in ({0, 2}, {1}) for places in keys.values())


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(substring, "REMEMBERED", 5)
    cache = substring.WordHashes()
    words = [b"w%d" % (i % 7) for i in range(50)]
    first = cache.of(words)
    assert (cache.of(words) == first).all() and (cache.of(words[:3]) == first[:, :3]).all() and len(cache) <= 8
