"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in the tasks. The trees are fitted on the driver to a bounded sample of
labelled rows (``TRAIN_ROWS`` of them, chosen by a hash of the id): cut points from the sample's quantiles, gradient
histograms per node and bin, the best cut of each node of a level. The fitted trees are flat arrays (feature, cut,
value, heap order), which each task walks level by level for a whole batch.

Defined cases: a null text counts as empty; an empty text has all statistics zero and is scored like any other;
without labels of both classes every score is the smoothed base rate; repeated rows score alike; an id with
several labels counts with the lowest; null labels are not learnt from; of cuts of equal gain the one of the first
statistic and the least value is taken; a text of any length is read whole, in one row of a task; an empty table gives
an empty result; no column but the text is an input, whatever the names of others.
"""

from __future__ import annotations

from collections import Counter
from itertools import pairwise
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, crc_bucket, texts

#: Labelled rows that a fit takes at most.
TRAIN_ROWS = 12_000
BINS, DEPTH, TREES, RATE, L2, LEAF = 64, 4, 80, 0.15, 2.0, 10
#: Ids with this remainder are held out of every fit.
HELD_OUT, MODULUS = 2, 4
ACCEPT = 0.7

STATISTICS = (
    "words bytes_per_word distinct_share next_same_share bigram_share top_share short_share upper_word_share title_share "
    "upper_share digit_share stop_share comma_share bang_share bar_share mark_share other_share high_share line_words "
    "line_dup_share longest_word word_spread entropy end_share"
).split()


def statistics(text: str) -> list[float]:
    """The document's statistics, in the order of ``STATISTICS``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    length = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = count[count > 0] / size
    of = lambda chars: count[list(chars)].sum() / size
    return [
        np.log1p(n),
        length.mean(),
        len(seen) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(pairwise(words))) / max(n - 1, 1),
        max(seen.values()) / n,
        (length <= 3).mean(),
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.istitle, words)) / n,
        count[65:91].sum() / size,
        count[48:58].sum() / size,
        of(b"."),
        of(b","),
        of(b"!?"),
        of(b"|<>{}[]=/\\"),
        of(b"#*$%&@^~_"),
        of(b"-+:;'\"()"),
        count[128:].sum() / size,
        np.log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(length.max()),
        length.std(),
        float(-(share * np.log2(share)).sum()),
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(len(lines), 1),
    ]


class Trees(NamedTuple):
    """Flat arrays: ``feature`` and ``cut`` are trees x inner nodes, ``value`` trees x leaves, in heap order."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all rows and one level at a time."""
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient-boosted trees for log loss from binned histograms."""
    n, inner, leaves = len(y), 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 1) / (n + 2)
    empty = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not n or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1], method="higher")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    margin, found = np.full(n, empty.start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = (node - first) * BINS
            gain = np.full((width, x.shape[1], BINS), -np.inf)
            for f in range(x.shape[1]):
                where = slot + binned[:, f]
                sums = [np.bincount(where, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None)]
                (gl, gt), (hl, ht), (nl, nt) = ((s, s[:, -1:]) for s in sums)
                better = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[:, f] = np.where((nl >= LEAF) & (nt - nl >= LEAF), better, -np.inf)
            best = gain.reshape(width, -1).argmax(1)
            for i, at in enumerate(best):
                f, b = divmod(int(at), BINS)
                if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + i], cut[first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += value[leaf]
        found.append((feature, cut, value))
    return Trees(empty.start, *(np.stack(a) for a in zip(*found)))


def training_labels(labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids that aren't held out: ``doc_id, y``."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def held_out(doc_id: Column, remainder: int = HELD_OUT, modulus: int = MODULUS) -> Column:
    return crc_bucket(doc_id, modulus) == remainder


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted to the documents of at most ``rows`` labels (so the broadcast side has a proven bound)."""
    sample = F.broadcast(training_labels(labels, "quality", held_out(F.col("doc_id")), rows))
    chosen = docs.select("doc_id", "text").join(sample, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    seen = arrow_map(chosen, run, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted(seen.collect(), key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in got], float).reshape(len(got), len(STATISTICS)), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` without the text and with each row's score."""
    rest = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts(batch)], float).reshape(batch.num_rows, len(STATISTICS))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(model.score(x))], names=[*rest, name])

    return arrow_map(docs, run, f"{fields}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``accept``."""
    model = train(docs, labels)
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts(batch)], float).reshape(batch.num_rows, len(STATISTICS))
        return batch.filter(pa.array(model.score(x) >= accept))

    return arrow_map(docs, run, schema)
