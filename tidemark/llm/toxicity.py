"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic model of its words and word beginnings; the
document's is their noisy-or, 1 - prod(1 - p). Only document labels are given, and the gradient through the noisy-or
teaches the sentence model, which then points at the offending sentences.

Features are hashed. Spark counts, over a bounded sample of labelled documents (``TRAIN_ROWS``, chosen by a hash of
the id), in how many of either class each feature occurs; the ``FEATURES`` that tell the classes apart best are
kept, and only those of the sample reach the driver for the fit.

Defined cases: a null or empty text has one empty sentence and gets its score; without labelled documents of both
classes (labels may match no document) every score is the smoothed base rate; repeated rows score alike; of features
that tell the classes apart alike the one of the smaller hash is kept; of equally bad sentences the first is the worst;
an id with several labels counts with the highest; null labels are not learnt from; no column but the text is an input,
whatever the names of others; long texts are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, checkpointed, crc_bucket, texts

#: Labelled rows that a fit takes at most, and features that it keeps at most.
TRAIN_ROWS, FEATURES = 12_000, 3_000
#: Features of sentences that the sample holds at most. Documents are taken in order of a hash of their id; one that
#: doesn't fit any more is left out of the sample as a whole.
TRAIN_ENTRIES = 6_000_000
#: A feature must occur in so many documents of the sample.
LEAST_DOCS = 4
BUCKETS = 1 << 24
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
STEPS, STEP, DECAY = 400, 0.05, 2e-4
HELD_OUT, MODULUS = 0, 5
THRESHOLD = 0.5
REMEMBERED = 400_000

SENTENCE_END = re.compile(r"[.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    """The non-empty sentences, or the one empty sentence of a text that has none."""
    return [s for s in SENTENCE_END.split(text) if s and not s.isspace()] or [""]


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    names = [f"{word}$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


class SentenceModel(NamedTuple):
    """``bias`` and the weights of the features that have one."""

    bias: float
    weights: dict[int, float]
    #: The score of every document, if there was nothing to learn from.
    base: float | None = None

    def scorer(self) -> WordWeights:
        return WordWeights(self)


class WordWeights(dict):
    """Lower-case word -> the sum of its features' weights, remembered."""

    def __init__(self, model: SentenceModel):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = sum(self.model.weights.get(f, 0.0) for f in word_features(word))
        return got

    def sentence_scores(self, text: str) -> np.ndarray:
        """The score of each sentence. A word counts once in a sentence."""
        if self.model.base is not None:  # all of the document's score in its first sentence
            p = np.zeros(len(sentences(text)))
            p[0] = self.model.base
            return p
        z = np.array([sum(map(self.__getitem__, set(LETTERS.findall(s.lower())))) for s in sentences(text)])
        return 1 / (1 + np.exp(-np.clip(z + self.model.bias, -35, 35)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(bag: np.ndarray, labels: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """Bias and weights; ``bag`` is each sentence's document, ``sentence, feature`` the non-zero entries."""
    n_docs, n_sentences = len(labels), len(bag)
    w, b = np.zeros(n_features), float(np.log(max(labels.sum(), 1) / max(n_sentences, 1)))
    m = np.zeros(n_features + 1)
    v = np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = np.clip(b + np.bincount(sentence, w[feature], n_sentences), -35, 35)
        p = 1 / (1 + np.exp(-z))
        log_none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
        any_ = np.clip(-np.expm1(log_none), 1e-9, 1)
        pull = np.where(labels > 0, -(1 - any_) / any_, 1.0)
        gz = p * pull[bag]
        grad = np.append(np.bincount(feature, gz[sentence], n_features), gz.sum()) / n_docs
        grad[:-1] += DECAY * w
        m += 0.1 * (grad - m)
        v += 0.001 * (grad**2 - v)
        move = STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return b, w


def held_out(doc_id: Column, remainder: int = HELD_OUT, modulus: int = MODULUS) -> Column:
    return crc_bucket(doc_id, modulus) == remainder


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: int = FEATURES) -> SentenceModel:
    """A sentence model from document labels; only ids that aren't held out are learnt from."""
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    sample = labels.where(usable).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[list[int]] = [[], []]
        for y, text in zip(batch.column("y").to_pylist(), texts(batch)):
            found[int(y > 0)] += {f for w in set(LETTERS.findall(text.lower())) for f in word_features(w)}
        both = np.array(found[0] + found[1], np.int64)
        kind, at = np.unique(both, return_inverse=True)
        positive = np.bincount(at, np.repeat([0, 1], [len(found[0]), len(found[1])]), len(kind)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.bincount(at, minlength=len(kind)) - positive), pa.array(positive)], names=["f", "n0", "n1"])

    totals = chosen.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") > 0)).first()
    if not totals[0] or not totals[1]:
        return SentenceModel(0.0, {}, (totals[1] + 1) / (totals[0] + totals[1] + 2))
    counted = arrow_map(chosen, count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    share = F.col("n1") / totals[1] - F.col("n0") / totals[0]
    telling = share * share / (F.col("n0") + F.col("n1") + 2)
    place = {r["f"]: i for i, r in enumerate(counted.orderBy(telling.desc(), "f").limit(keep).select("f").collect())}

    def entries(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Per document: the numbers of its sentences and of the kept features in them, pair by pair."""
        columns: tuple[list, list, list] = ([], [], [])
        for text in texts(batch):
            sentence, feature, n = [], [], 0
            for s in sentences(text):
                got = sorted({place[f] for w in set(LETTERS.findall(s.lower())) for f in word_features(w) if f in place})
                sentence += [n] * len(got)
                feature += got
                n += 1
            for c, x in zip(columns, (sentence, feature, n)):
                c.append(x)
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *map(pa.array, columns, kinds)], names=["doc_id", "y", "sentence", "feature", "n"])

    each = arrow_map(chosen, entries, "doc_id long, y double, sentence array<int>, feature array<int>, n int")
    weighed = each.withColumn("weight", F.size("feature").cast("long") + F.col("n"))
    seen = checkpointed(weighed.groupBy("doc_id").agg(F.min(F.struct("weight", "y", "sentence", "feature", "n")).alias("r")).select("doc_id", F.xxhash64("doc_id").alias("place"), "r.*"))
    taken, total = [], 0
    for r in seen.select("doc_id", "weight").orderBy("place", "doc_id").collect():  # TRAIN_ROWS at most
        if total + r["weight"] <= TRAIN_ENTRIES:
            taken.append(r["doc_id"])
            total += r["weight"]
    got = seen.join(seen.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long"), "doc_id")
    rows = got.select("doc_id", "y", "sentence", "feature", "n").toArrow().combine_chunks().sort_by("doc_id")
    y, n = rows["y"].to_numpy(), rows["n"].to_numpy()
    if not len(y) or y.min() > 0 or y.max() == 0:
        return SentenceModel(0.0, {}, (totals[1] + 1) / (totals[0] + totals[1] + 2))
    before = np.cumsum(n) - n
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in rows["feature"].chunks])
    flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks])
    bias, weights = fit(np.repeat(np.arange(len(y)), n), y, flat("sentence") + np.repeat(before, lengths), flat("feature"), len(place))
    return SentenceModel(bias, {f: float(weights[i]) for f, i in place.items()})


def score(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, worst_sentence (its number, from 0) and the offending sentences with their numbers and scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            rows = []
            for text in texts(batch):
                p = scorer.sentence_scores(text)
                bad = np.flatnonzero(p >= threshold).tolist()
                parts = sentences(text) if bad else []
                rows.append((noisy_or(p), int(p.argmax()), [{"sentence": i, "score": float(p[i]), "text": parts[i].strip()} for i in bad]))
            kinds = (pa.float64(), pa.int64(), pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64()), ("text", pa.string())])))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "score", "worst_sentence", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, worst_sentence long, offending array<struct<sentence:long,score:double,text:string>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_sentence and n_offending (sentences at or over the threshold)."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", F.size("offending").cast("long").alias("n_offending")
    )
