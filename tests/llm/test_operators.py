"""Each training-data operator against brute force, and its defined cases: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import TABLES, agree, spark_rows
from tidemark.llm import common, graph, license_scan, line_dedup, mixing, packing, quality_model, quality_rules, queries, simhash, substring, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in ((*r, "src")[:3] for r in rows)]
    return spark.createDataFrame(full, DOCS).repartition(parts)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def odd(spark):
    """Nulls everywhere, an empty and a blank text, a repeated row, an id twice, a text three times the corpus's longest."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13), (4, "other text", None, "b", 10), (None, "no id here", "en", "c", 10), (5, LONG, "en", "a", len(LONG)), (6, "Zürich ist schön — 東京 🚀 é", "de", None, 9)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("score", "fp", "key_id", "key_hash", "size", "mark", "label", "runs", "starts", "rate", "n_removed", "block", "y")}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


ALL = {
    "packing": lambda s, d, l: packing.pack_documents(d),
    "simhash": lambda s, d, l: simhash.near_duplicates(d),
    "simhash_drop": lambda s, d, l: simhash.drop_near_duplicates(d),
    "mix_plan": lambda s, d, l: mixing.mix_plan(d),
    "mix": lambda s, d, l: mixing.mix(d),
    "quality": lambda s, d, l: quality_model.classify(d, l),
    "keep_good": lambda s, d, l: quality_model.keep_good(d, l),
    "lines": lambda s, d, l: line_dedup.digest(d),
    "dedup_lines": lambda s, d, l: line_dedup.dedup_lines(d),
    "substring": lambda s, d, l: substring.remove_repeats(d),
    "licenses": lambda s, d, l: license_scan.scan_licenses(d),
    "rules": lambda s, d, l: quality_rules.judge(d),
    "toxicity": lambda s, d, l: toxicity.classify(d, l),
}
ONE_ROW_EACH = ("simhash", "mix_plan", "quality", "lines", "dedup_lines", "substring", "licenses", "rules", "toxicity")
SAME_COLUMNS = ("simhash_drop", "mix", "keep_good", "dedup_lines")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_words(text):
    return sha(" ".join((text or "").split()))


#: What the defined cases of each operator promise for the odd rows, in no order.
TWICE, OTHER, PLACE = ("one two three",) * 2, "other text", "Zürich ist schön — 東京 🚀 é"
ODD_TEXTS = [(1, None), (2, ""), (3, " \n\t "), *((4, t) for t in TWICE), (4, OTHER), (None, "no id here"), (5, LONG), (6, PLACE)]
EXPECTED = {
    "simhash": (("doc_id", "fingerprint", "component_id"), lambda: [(i, f"{slow_fingerprint(t or ''):016x}", 1 if i in (1, 2, 3) else i) for i, t in ODD_TEXTS]),
    "mix_plan": (("doc_id", "size", "source_size"), lambda: [(i, len((t or "").split()), {1: 7, 6: 7, 2: 60_000, 3: 60_000, 5: 60_000, 4: 8}.get(i, 3)) for i, t in ODD_TEXTS]),
    "lines": (("doc_id", "n_lines", "n_removed", "kept_sha256"), lambda: [(i, int(bool((t or "").strip())), 0, None if t is None else sha(t)) for i, t in ODD_TEXTS]),
    "dedup_lines": (("doc_id", "text"), lambda: ODD_TEXTS),
    "substring": (("doc_id", "n_words", "n_removed", "kept_sha256"), lambda: [(i, len((t or "").split()), 60_000 if t == LONG else 0, kept_words("" if t == LONG else t)) for i, t in ODD_TEXTS]),
    "licenses": (("doc_id", "n_words", "n_base", "labels", "score"), lambda: [(i, {LONG: 60_000, PLACE: 7}.get(t, len((t or "").split())), 0, "", 0.0) for i, t in ODD_TEXTS]),
    "rules": (("doc_id", "n_words", "word_chars", "base_failed"), lambda: [(i, len((t or "").split()), sum(map(len, (t or "").split())), True) for i, t in ODD_TEXTS]),
    "simhash_drop": (("doc_id", "text"), lambda: [(1, None), (4, OTHER), (4, TWICE[0]), (None, "no id here"), (5, LONG), (6, PLACE)]),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows(spark, labels, name):
    rows = odd(spark)
    out = ALL[name](spark, rows, labels)
    got = out.collect()
    if name in ONE_ROW_EACH:
        assert Counter(r["doc_id"] for r in got) == Counter({1: 1, 2: 1, 3: 1, 4: 3, None: 1, 5: 1, 6: 1})
    if name in SAME_COLUMNS:
        assert out.columns == rows.columns and out.schema.simpleString() == rows.schema.simpleString()
    if name in EXPECTED:
        columns, want = EXPECTED[name]
        assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want())
    if name == "packing":
        tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
        tokens = Counter()
        for r in got:
            tokens[r["doc_id"]] += r["length"]
        want = Counter()
        for i, t in ODD_TEXTS:
            want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        assert tokens == want
    if name in ("quality", "toxicity"):
        scores = {(r["doc_id"], r["score"], r["predicted"]) for r in got}
        assert all(0 <= s <= 1 for _, s, _ in scores) and len({s for i, s, _ in scores if i in (1, 2)}) == 1
        assert len({x for x in scores if x[0] == 4}) <= 2
    if name == "mix":
        assert Counter(r["doc_id"] for r in got) == Counter({i: n for i, n in Counter(dict(mixing_copies(spark, rows))).items() if n})


def mixing_copies(spark, rows):
    total = Counter()
    for r in mixing.mix_plan(rows).collect():
        total[r["doc_id"]] += r["copies"]
    return total.items()


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, labels, name):
    none = spark.createDataFrame([], DOCS)
    assert ALL[name](spark, none, labels).collect() == []
    if name in ("quality", "keep_good", "toxicity"):
        assert isinstance(ALL[name](spark, docs(spark, [(1, "a b c")]), labels.limit(0)).collect(), list)


@pytest.mark.parametrize("kind", ["no labels", "labels of other ids", "one class", "null labels"])
def test_nothing_to_learn_from(spark, kind):
    d = docs(spark, [(i, f"a few words {i}. and more") for i in range(1, 4)])
    rows = {"no labels": [], "labels of other ids": [(100 + i, i % 2, i % 2) for i in range(40)], "one class": [(i, 1, 1) for i in range(1, 4)], "null labels": [(i, None, None) for i in range(1, 4)]}[kind]
    lab = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for classify, modulus, remainder in ((quality_model.classify, 4, 2), (toxicity.classify, 5, 0)):
        got = classify(d, lab).collect()
        n = sum(zlib.crc32(str(i).encode()) % modulus != remainder for i in range(1, 4)) if kind == "one class" else 0
        assert {round(r["score"], 9) for r in got} == {round((n + 1) / (n + 2), 9)} and len(got) == 3


def test_oracles(spark):
    for name, sql in queries.oracle_sql().items():
        agree(spark, SF, queries.queries()[name], sql)


# ---- exact top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute_top(rows, k, is_query):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, (c, w) in enumerate(ok) if i != at and len(w) == len(v))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return Counter(out)


def test_top_k_is_exact(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.7]) for _ in range(6)], 0) for i in range(150)]
    rows += [(i, [0.5] * 6, 0) for i in range(150, 200)]  # many ties
    rows += [(200, None, 0), (201, [0.1, None, 0.2, 0.1, 0.1, 0.1], 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] * 6, 0), (None, [0.1] * 6, 0), (204, [0.3] * 3, 0), (220, [0.2] * 3, 0), (240, [], 0), (260, [1e30] * 6, 0)]
    rows += [(40, [0.25] * 6, 0), (40, [0.25] * 6, 0), (41, [0.7] * 6, 0), (41, [0.7] * 6, 0)]  # ids that repeat
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "CELL_TILES", 1)
    monkeypatch.setattr(topk, "CELL_SHARDS", 1)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    small = [r for r in rows if r[0] != 260]
    got = topk.top_k(vectors(spark, small), F.col("vec_id") % 20 == 0, 5)
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(small, 5, lambda i: i % 20 == 0)
    huge = topk.top_k(vectors(spark, rows), F.col("vec_id") == 260, 3).collect()
    assert len(huge) == 3 and max(r["score"] for r in huge) == 2**63 - 1
    assert topk.top_k(vectors(spark, []), F.lit(True), 3).collect() == []


def test_rows_that_repeat_an_id_find_each_other(spark):
    rows = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 2)
    assert Counter(tuple(r) for r in got.collect()) == Counter({(20, 1, 20, 4096): 2, (20, 2, 1, 2048): 2})
    folder = tempfile.mkdtemp(prefix="tidemark-vectors-")
    for t in set(TABLES) - {"embeddings"}:
        os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    vectors(spark, [(i if i % 3 else 20 * (i // 60), [float(i % 7), 0.25 * (i % 5)], 0) for i in range(200)]).write.parquet(f"{folder}/embeddings.parquet")
    agree(spark, folder, queries.op1_topk, topk.ORACLE_SQL)


def test_extra_columns_of_vectors_may_have_any_name(spark):
    rows = vectors(spark, [(i, [float(i), 1.0], 0) for i in range(60)])
    clash = rows.withColumns({c: F.lit("x") for c in ("v", "asks", "block", "rows", "n", "dim", "part", "at")})
    assert spark_rows(topk.top_k(clash, F.col("vec_id") % 20 == 0, 3)) == spark_rows(topk.top_k(rows, F.col("vec_id") % 20 == 0, 3))


def test_blocks_are_numbered_without_gaps(spark, monkeypatch):
    made = topk.shard(topk.usable(vectors(spark, [(i, [1.0], 0) for i in range(100)]), F.col("vec_id") % 20 == 0), 7)
    found, n = topk.numbered(common.checkpointed(made))
    assert sorted(r["block"] for r in found.collect()) == list(range(n)) and n >= 15


# ---- packing


def check_packing(pieces, texts, room):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            ids = np.array(want[i][at : at + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["length"] > 0 and p["ids_crc32"] == zlib.crc32(ids) and p["doc_tokens"] == len(want[i])
            at += p["length"]
        assert at == len(want[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= room
    return len(by_seq), sum(map(len, want.values()))


def test_packing_is_a_round_trip(spark):
    rows = [(i, t) for i, t in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, "I'll say: don't <|endoftext|> x's’ ÉCOLE é ΣΑΣ İs ²³ ½ \x1c\x85 　 _a_b 3.14%% (q)'re")]
    pieces = packing.pack_documents(docs(spark, rows, 2)).collect()
    n, tokens = check_packing(pieces, rows, 2048)
    filled = {}
    for p in pieces:
        filled[p["sequence_id"]] = filled.get(p["sequence_id"], 0) + p["length"]
    assert all(x & (x - 1) == 0 for x in filled.values())  # no sequence needs padding
    assert sum(x < 2048 for x in filled.values()) <= 2 * 11 and n == len(filled)


def test_place_balances_cost():
    lengths = np.array([900, 900, 100, 100, 48, 1000, 1000, 48])
    at = packing.place(lengths, 2048)
    per = Counter()
    for _, seq, _, n in at:
        per[seq] += n
    assert sum(per.values()) == lengths.sum() and max(per.values()) <= 2048 and len(per) == 2
    assert Counter(seq for item, seq, _, _ in at if lengths[item] >= 900) == {0: 2, 1: 2}
    cut = packing.place(np.array([1500, 1500, 1000]), 2048)
    sums = Counter()
    for _, seq, _, n in cut:
        sums[seq] += n
    assert sorted(sums.values()) == [32, 128, 256, 512, 1024, 2048]  # full, the rest in powers of two


# ---- SimHash


def slow_fingerprint(text):
    words = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, bits):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash_components(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rng = random.Random(2)
    base = [f"t{rng.randrange(50)}" for _ in range(400)]
    for i in range(120):  # a chain of near copies
        base[rng.randrange(400)] = f"n{i}"
        rows.append((20_000 + i, " ".join(base)))
    rows += [(30_000, ""), (30_001, None), (30_002, "A b"), (30_003, "a B")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = {i: slow_fingerprint(t or "") for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    root = classes(fps.values(), 3)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert {i: r["component_id"] for i, r in got.items()} == {i: least[root[f]] for i, f in fps.items()}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert kept == set(least.values())


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_links_connect_what_is_near(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        for _ in range(40):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                f ^= 1 << b
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4), bits).collect()
    want = classes(fps, bits)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in found:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        root[find(a)] = find(b)
    groups = lambda of: {frozenset(f for f in fps if of(f) == r) for r in {of(f) for f in fps}}
    assert groups(find) == groups(want.get)


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_hot_segments_are_split_by_the_other_bits(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "HOT", 4)
    monkeypatch.setattr(simhash, "HOT_PART", 10)
    rng = random.Random(bits)
    fps = {(0xABCDEF01 << 32) | rng.getrandbits(32) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4)
    cuts = simhash.segments(bits)
    hot = simhash.hot_segments(frame, cuts)
    assert bits < 2 or any(len(h) for h in hot)
    own = np.array(sorted(fps), np.uint64)
    groups = Counter()
    for number, value, second, other, at in simhash.variants(own, cuts, hot):
        groups.update(zip(number.tolist(), value.tolist(), second.tolist(), other.tolist()))
    assert bits != 3 or max(n for g, n in groups.items() if g[2] >= 0) < sum(n for g, n in Counter(f >> 32 for f in fps).items() if g == 0xABCDEF01)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in simhash.links(frame, bits).collect():
        root[find(r["a"] % (1 << 64))] = find(r["b"] % (1 << 64))
    want = classes(fps, bits)
    same = lambda of: {frozenset(f for f in fps if of(f) == r) for r in {of(f) for f in fps}}
    assert same(find) == same(want.get)


def test_large_variant_groups_are_dealt_out(monkeypatch):
    rng = random.Random(9)
    fps = np.array(list({rng.getrandbits(10) | (rng.getrandbits(6) << 40) for _ in range(900)}), np.uint64)
    whole = simhash.near_links(fps, 3)
    monkeypatch.setattr(simhash, "DIRECT", 16)
    split = simhash.near_links(fps, 3)
    assert len(whole[0]) == len(split[0])


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


# ---- mixing


def test_targets_fill_up_under_the_cap(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 90)]
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes)]
    got = {r["source"]: r for r in mixing.source_targets(docs(spark, rows).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size"))).collect()}
    assert got["a"]["target"] == 30.0 and got["d"]["target"] == 0.0 and got[None]["target"] == 270.0
    assert got["b"]["target"] == pytest.approx(1300 * 2 / 5) and got["c"]["target"] == pytest.approx(1300 * 3 / 5)
    assert sum(r["target"] for r in got.values()) == pytest.approx(1600)


def test_mix_repeats_rows_as_planned(spark):
    d = common.table(spark, SF, "documents")
    plan = {r["doc_id"]: r for r in mixing.mix_plan(d).collect()}
    again = {r["doc_id"]: r for r in mixing.mix_plan(d.repartition(5)).collect()}
    assert plan == again
    got = Counter(r["doc_id"] for r in mixing.mix(d).collect())
    assert got == Counter({i: r["copies"] for i, r in plan.items()})
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in plan.values())


def test_many_sources_are_joined_by_a_salted_key(spark, monkeypatch):
    d = common.table(spark, SF, "documents")
    want = spark_rows(mixing.mix_plan(d))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert spark_rows(mixing.mix_plan(d)) == want


# ---- line dedup


def brute_lines(rows, window, long_line):
    def key(r):
        return (r[0] is not None, r[0] or 0)

    seen, out = set(), {}
    for i, text in sorted(rows, key=key):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        grams = [at[j : j + window] for j in range(len(at) - window + 1)] + [[k] for k in at if len(lines[k].split()) >= long_line and window > 1]
        for own in grams:
            gram = tuple(lines[k].strip() for k in own)
            if gram in seen:
                gone |= set(own)
            else:
                seen.add(gram)
        out[i] = (len(at), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5])
def test_line_dedup(spark, window):
    rng = random.Random(window)
    passage = [f"p {i} q" for i in range(9)]
    rows = [(i, "\n".join(x for _ in range(rng.randrange(9)) for x in (rng.choice([[rng.choice(["", " ", *"abcdefgh"])], passage[rng.randrange(4) : rng.randrange(4, 10)]])))) for i in range(120)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.deduplicated(docs(spark, rows), window, 3).collect()}
    assert got == brute_lines(rows, window, 3)
    out = line_dedup.dedup_lines(docs(spark, rows), window)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and out.where("n_chars <> char_length(text)").count() == 0


@pytest.mark.parametrize("window", [2, 3, 5])
def test_only_window_minima_are_fingerprints(spark, window):
    rng = random.Random(window)
    rows = [(i, "\n".join(f"{rng.random()}" for _ in range(200))) for i in range(20)]
    found = line_dedup.positions(docs(spark, rows), window).collect()
    assert len(found) < 20 * 200 * (2 / (window + 1) + 0.06)  # the density of winnowing
    assert sum(len(r["wholes"]) for r in found) == 20 * (200 - window + 1)  # yet every window selects one
    hashes, _ = line_dedup.line_hashes(rows[3][1], 99)
    own = sorted((r for r in found if r["key_id"] == 3), key=lambda r: r["first"])
    for r in own:
        for k in range(len(r["wholes"])):
            assert np.int64(r["print"]) == hashes[r["first"] + k : r["first"] + k + window, 0].min().view(np.int64)


def test_lines_end_at_newlines_and_ascii_white_space_only(spark):
    rows = [(1, "\x1ca long line of more than ten words so that it goes\nb\x85"), (2, "a long line of more than ten words so that it goes\r\n\tb"), (3, "  a long line of more than ten words so that it goes \nc")]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (1, "c")}


# ---- substring dedup


def brute_repeats(rows, window):
    count, split = Counter(), [(t or "").encode().split() for _, t in rows]
    for w in split:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def repetitive(seed):
    rng = random.Random(seed)
    base, rows = [rng.choice("abcd") for _ in range(60)], []
    for i in range(160):
        kind = rng.randrange(8)
        unit = [f"u{rng.randrange(6)}_{j}" for j in range(rng.randrange(10, 45))]
        w = [
            ["x"] * rng.randrange(90), (["p", "q", "r"][: rng.randrange(1, 4)] * 60)[: rng.randrange(120)], [*base[rng.randrange(10) : rng.randrange(40, 60)], str(i)], [str(rng.random()) for _ in range(50)],
            [str(i), *["x"] * rng.randrange(30, 40), str(i)], [rng.choice("ab") for _ in range(100)], base * rng.randrange(1, 3), unit + unit + unit[:5],
        ][kind]
        rows.append((i, " ".join(w)))
    return [*rows, (7, rows[7][1]), (None, rows[9][1]), (500, None), (501, "")]


@pytest.mark.parametrize(("window", "rounds", "held"), [(35, 6, 100_000), (35, 6, 2), (5, 2, 3), (12, 3, 100_000)])
def test_substring_dedup(spark, monkeypatch, window, rounds, held):
    monkeypatch.setattr(substring, "HELD", held)
    rows = repetitive(window + held)
    got = substring.remove_repeats(docs(spark, rows), window, rounds).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows, window)


def test_groups_of_one_name_may_exceed_what_is_held(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = np.stack([rng.integers(0, 4, 400), rng.integers(0, 6, 400), np.arange(400), np.arange(400), np.zeros(400, int), np.ones(400, int), np.ones(400, int)])
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    names = [c.split()[0] for c in substring.CHUNK.split(", ")]

    def run(held, size):
        monkeypatch.setattr(substring, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(v) for v in rows[:, i : i + size]], names=names) for i in range(0, 400, size)]
        out = [r for b in substring.compare_groups(iter(batches)) for r in b.to_pylist()]
        return {(r["key_id"], r["lo"]) for r in out if r["kind"] == 0}, {rows[1, list(rows[2]).index(r["key_id"])] * 10 + r["name"] for r in out if r["kind"] == 1}

    assert run(100_000, 400) == run(100_000, 7) == run(20, 7)


# ---- licenses


def test_license_phrases_and_fuzzy_notices(spark):
    rows = [
        (1, "This is under the MIT License. mit license mit license"),
        (2, "Relesed under the MIT Licence"),
        (3, "licensed under the GNU General Public License, version 3"),
        (4, "Licenced under the Apache Licence, Version 2.0"),
        (5, "emit license, the mit licenses"),
        (6, None),
        (7, "word " * 5000 + "Licensed under CC BY-NC 4.0."),
        (8, "transmit\nlicense general\tpublic-license"),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 4, 8, "mit")
    assert got[2]["labels"] == "MIT" and got[2]["n_base"] == 0 and got[2]["first_word"] is None and 0 < got[2]["score"] < 1
    assert got[3]["labels"] == "GPL-3.0,gpl" and got[4]["labels"] == "Apache-2.0"
    assert got[5]["labels"] == "" and got[5]["score"] == 0 and got[6]["n_words"] == 0
    assert got[7]["labels"] == "CC-BY-NC-4.0" and got[7]["spans"][0]["first_word"] == 5000 and got[7]["n_words"] == 5007
    assert (got[8]["n_base"], got[8]["base_labels"], got[8]["first_word"]) == (1, "gpl", 2)


def test_fuzzy_search_finds_the_notice_within_the_bound():
    scanner = license_scan.Scanner()
    rng = random.Random(6)
    for number, (text, label) in enumerate(license_scan.NOTICES.items()):
        k = len(text) // license_scan.LETTERS_PER_ERROR
        for _ in range(12):
            x, n = list(text), rng.randrange(k + 1)
            for _ in range(n):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], ["z"], [x[at], "q"]])
            before = "aaa " * rng.randrange(4)
            line = before + "".join(x) + " bbb"
            finds = scanner.near(line)
            own = [f for f in finds if scanner.notices[f[0]].label == label]
            if not own:  # another notice is as near at the same place
                own = [f for f in finds if f[3] <= n and edits_to_best_place(scanner.notices[f[0]].text, line) == f[3]]
            assert own and min(f[3] for f in own) <= n, (text, line)
            assert any(f[1] < len(line) - 4 and f[2] > len(before) for f in own)


def edits_to_best_place(notice, line):
    """The fewest edits that make ``notice`` a substring of ``line``: dynamic programming over all places."""
    row, letters = np.zeros(len(line) + 1, int), np.array([ord(x) for x in line])
    for i, c in enumerate(notice, 1):
        hit = np.concatenate([[i], row[:-1] + (letters != ord(c))])
        hit[1:] = np.minimum(hit[1:], row[1:] + 1)
        row = np.minimum.accumulate(hit - np.arange(len(hit))) + np.arange(len(hit))
    return int(row.min())


def slow_scan(text):
    words = [w.decode() for w in (text or "").encode().translate(license_scan.WORD_BYTES).split()]
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), " ".join(words)


def test_license_scan_against_brute_force(spark):
    rng = random.Random(8)
    notices = list(license_scan.NOTICES)
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 900][:60]
    for i in range(60):  # notices, whole, bent and broken, with phrases
        x = list(rng.choice(notices))
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(x))
            x[at : at + 1] = rng.choice([[], ["z"], [x[at], "q"]])
        rows.append((90_000 + i, f"Some words {rng.choice(['MIT License', 'the apache  license!', 'mit', ''])} here: {''.join(x).title()}. {rng.choice(['GENERAL public-license', ''])} end"))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    n_found = 0
    for i, text in rows:
        r, slow = got[i], slow_scan(text)
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == slow[:5]
        near = {t: e for t in notices if (e := edits_to_best_place(t, slow[5])) <= len(t) // license_scan.LETTERS_PER_ERROR}
        n_found += len(near)
        assert {s["notice"] for s in r["spans"]} <= set(near) and bool(r["spans"]) == bool(near)
        assert all(s["edits"] >= near[s["notice"]] for s in r["spans"])
        if near:  # the best find stays; a notice is missing only where another one was found in its place
            assert min(s["edits"] for s in r["spans"]) == min(near.values())
        assert set(filter(None, r["labels"].split(","))) == {s["label"] for s in r["spans"]} | set(filter(None, slow[4].split(",")))
    assert n_found >= 25


@pytest.mark.parametrize("unit", ["permission is hereby grant ", "mit license ", "all rights reserve "])
def test_scan_of_repetitive_texts_is_linear(unit):
    scanner = license_scan.Scanner()

    def took(n):
        began = time.process_time()
        scanner.scan(unit * n)
        return time.process_time() - began

    assert took(16_000) < 8 * took(4_000) + 1


# ---- rules, classifier, toxicity


def test_rules_explain_themselves(spark):
    good = " ".join(["the cat sat on the mat and it was of that kind"] + [f"the thing{i} was in place{i}" for i in range(20)])
    rows = [(1, good), (2, " ".join(f"{w}***" for w in good.split())), (3, "short"), (4, "spam " * 200), (5, None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and "symbols_to_words" in got[2]["failed_rules"]
    assert got[3]["base_failed"] and got[4]["base_failed"] and got[4]["n_repeat_words"] == 200 and got[5]["n_words"] == 0


def held_out_auc(rows):
    ranks = {}
    ordered = sorted(rows)
    for i, (s, _) in enumerate(ordered):
        ranks.setdefault(s, []).append(i + 1)
    mean = {s: sum(v) / len(v) for s, v in ranks.items()}
    pos = [mean[s] for s, y in rows if y]
    n1, n0 = len(pos), len(rows) - len(pos)
    return (sum(pos) - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("classify", "label", "least"), [(quality_model.classify, "quality", 0.97), (toxicity.classify, "toxic", 0.85)])
def test_classifiers_on_held_out_labels(spark, classify, label, least):
    sf = "/root/testdata/sf0.1"
    d, lab = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rows = classify(d.join(lab.select("doc_id"), "doc_id", "left_semi"), lab).join(lab, "doc_id").where("held_out").collect()
    assert held_out_auc([(r["score"], r[label]) for r in rows]) > least
    assert all(0 <= r["score"] <= 1 for r in rows)
    modulus, remainder = (4, 2) if label == "quality" else (5, 0)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder for r in rows)


def test_labels_of_held_out_rows_are_never_learnt_from(spark):
    d, lab = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    flipped = lab.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert spark_rows(quality_model.classify(d, lab)) == spark_rows(quality_model.classify(d, flipped))
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert spark_rows(toxicity.classify(d, lab)) == spark_rows(toxicity.classify(d, flipped))


def slow_statistics(text):
    """Each statistic from its definition, one character or word at a time."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return [0.0] * 24
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
    part = lambda chars: sum(b in chars for b in raw) / len(raw)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    cased = lambda w: any(65 <= b <= 90 or 97 <= b <= 122 for b in w)
    return [
        math.log(1 + n), mean, len(set(words)) / n, sum(words[i] == words[i + 1] for i in range(n - 1)) / n, len({(words[i], words[i + 1]) for i in range(n - 1)}) / max(n - 1, 1),
        max(words.count(w) for w in set(words)) / n, sum(x <= 3 for x in lengths) / n, sum(cased(w) and w == w.upper() for w in words) / n, sum(w.istitle() for w in words) / n,
        part(range(65, 91)), part(range(48, 58)), part(b"."), part(b","), part(b"!?"), part(b"|<>{}[]=/\\"), part(b"#*$%&@^~_"), part(b"-+:;'\"()"), part(range(128, 256)),
        math.log(1 + n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), math.log(1 + max(lengths)), math.sqrt(sum((x - mean) ** 2 for x in lengths) / n),
        -sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1),
    ]


def test_statistics_against_their_definitions(spark):
    texts = [r["text"] or "" for r in common.table(spark, SF, "documents").select("text").collect() if len(r["text"] or "") < 5000]
    for text in [*texts[:80], "", " \n ", "A", "É é ÉÉ. \n\n b! b! {x} #1"]:
        assert quality_model.statistics(text) == pytest.approx(slow_statistics(text), abs=1e-9)


def test_quality_query_against_a_slow_walk(spark):
    """The whole query on a small table: statistics from their definitions, trees walked node by node."""
    d, lab = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    trees = quality_model.train(d, lab)
    texts = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}

    def walk(x):
        margin = trees.start
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            margin += value[node - len(feature)]
        return 1 / (1 + math.exp(-margin))

    for r in queries.op5_quality(spark, SF).collect():
        x = quality_model.statistics(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(walk(x)) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_query_against_a_slow_score(spark):
    """The whole query on a small table: each sentence's features summed one by one, noisy-or by its product."""
    d, lab = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.train(d, lab)
    texts = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
    for r in queries.op10_toxicity(spark, SF).collect():
        none = 1.0
        for s in [s for s in re.split(r"[.!?\n]", texts[r["doc_id"]]) if s.strip()] or [""]:
            names = [n for w in set(re.findall(r"[^\W\d_]+", s.lower())) for n in [w + "$", *(w[:k] for k in (4, 5, 6, 7) if k <= len(w))]]
            z = model.bias + sum(model.weights.get(zlib.crc32(n.encode()) % toxicity.BUCKETS, 0.0) for n in names)
            none *= 1 - 1 / (1 + math.exp(-min(max(z, -35), 35)))
        assert r["score"] == pytest.approx(1 - none, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_the_sample_is_bounded_in_entries(spark, monkeypatch):
    d, lab = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    monkeypatch.setattr(toxicity, "TRAIN_ENTRIES", 3_000)
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda bag, labels, sentence, feature, n: (sizes.append(len(bag) + len(feature)), (0.0, np.zeros(n)))[1])
    toxicity.train(d, lab)
    assert sizes and 1_000 < sizes[0] <= 3_000


def test_trees_learn_and_walk_flat_arrays():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality_model.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    one = trees.score(x[:1])
    assert one[0] == trees.score(x)[0] and trees.score(x[:0]).shape == (0,)


def test_offending_sentences_are_located(spark):
    plain = "the day was fine. we walked by the river. it rained later"
    rows = [(i, f"{plain} {i}. you grobnik fool. the end" if i % 3 == 0 else f"{plain} {i}. the end") for i in range(120)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    d = docs(spark, rows)
    found = toxicity.score(d, toxicity.train(d, lab)).collect()
    for r in found:
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
        if r["doc_id"] % 3 == 0:
            assert [s["text"] for s in r["offending"]] == ["you grobnik fool"]


# ---- helpers


def test_repeated_groups_stream(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(3), i) for i in range(150)] + [(7, 7, 1000)]
    got = common.repeated_groups(spark.createDataFrame(rows, "a long, b long, v long").repartition(5), ["a", "b"]).collect()
    count = Counter((a, b) for a, b, _ in rows)
    assert Counter(tuple(r) for r in got) == Counter(r for r in rows if count[r[0], r[1]] > 1)
