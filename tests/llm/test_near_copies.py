"""The pipeline's near-dedup against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from tests.llm.test_operators import docs
from tidemark.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept_by_hand(rows, threshold=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (not union or len(sets[i] & sets[j]) / union >= threshold) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
    return words


def sample():
    rng, rows = random.Random(3), []
    for b in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))]
        for k in range(8):
            rows.append((1000 * b + k, " ".join(edited(rng, base, rng.randrange(1 + len(base) // 25)))))
    chain = [f"c{rng.randrange(400)}" for _ in range(200)]
    for i in range(30):  # the ends have nothing in common
        chain = edited(rng, chain, 3)
        rows.append((50_000 + i, " ".join(chain)))
    return rows + [(60_000, ""), (60_001, " \n"), (60_002, "A b"), (60_003, "a B"), (60_004, "a b c")]


def test_stage_drops_what_is_similar(spark):
    rows = sample()
    got = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs(spark, rows), "").collect()}
    assert got == kept_by_hand(rows)


def classes_of(rows, pairs):
    root = list(range(len(rows)))
    for a, b in pairs:
        root = [root[b] if r == root[a] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def test_group_links_connect_what_is_similar():
    rows = sample()[:-5]
    sets = [near_copies.shingle_set(t) for _, t in rows]
    ids = np.arange(len(rows))
    assert classes_of(rows, near_copies.group_links(ids, ids.copy(), np.zeros(len(ids), int), sets, 0.8)) == kept_by_hand(rows)


def test_pairs_of_blocks_connect_what_is_similar():
    rows = sample()[:-5]
    random.Random(1).shuffle(rows)
    sets = [near_copies.shingle_set(t) for _, t in rows]
    cuts = [np.arange(a, min(a + 60, len(rows))) for a in range(0, len(rows), 60)]
    pairs = []
    for i, p in enumerate(cuts):
        pairs += near_copies.group_links(p, p.copy(), np.zeros(len(p), int), [sets[k] for k in p], 0.8)
        for q in cuts[i + 1 :]:
            both = np.concatenate([p, q])
            pairs += near_copies.group_links(both, both.copy(), np.repeat([0, 1], [len(p), len(q)]), [sets[k] for k in both], 0.8)
    assert classes_of(rows, pairs) == kept_by_hand(rows)


def test_a_large_group_is_cut_into_blocks(spark):
    """One value that all nodes share: two chains and strangers, in blocks of a few nodes."""
    rows = sample()[:-5]
    named = [(i, t, near_copies.shingle_set(t)) for i, (_, t) in enumerate(rows)]
    sets = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, _, s in named], "node long, shingles array<long>")
    members = spark.createDataFrame([(7, i) for i, _, _ in named], "value long, node long")
    cut = near_copies.blocks(members.selectExpr("value", "node", "node AS root", "200L AS size"), 1500)
    assert cut.count() == len(rows) and cut.groupBy("block").count().agg({"count": "max"}).first()[0] <= 8
    found = near_copies.links(members, sets, 0.8, block=1500).collect()
    assert classes_of(rows, [(r["a"], r["b"]) for r in found]) == kept_by_hand(rows)


def test_stage_on_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, "a b"), (3, ""), (3, "x y z"), (3, "x y z"), (4, "p " * 9000)]
    out = corpus_pipeline.one_of_each(spark, docs(spark, rows), "")
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, ""), (2, "a b"), (3, "x y z"), (4, "p " * 9000)]
    assert corpus_pipeline.one_of_each(spark, docs(spark, rows).limit(0), "").count() == 0
