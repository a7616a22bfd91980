"""The break model: imputation and scaling learnt on training rows, an L2 logit, walk-forward scoring, fingerprints, registry reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import MIN_CLASS_N, MIN_SAMPLE_N
from tidemark.operators.pit import at_first_cutoff, until_next
from tidemark.storage import checkpointed


class InsufficientData(ValueError):
    """Too few rows, or too few of a class, to fit."""


#: Bits of a number that one pass of ``exact_quantile`` settles.
DIGIT = 13


def exact_quantile(rows: DataFrame, columns: Sequence[str], q: float = 0.5) -> dict[str, float | None]:
    """Per column (doubles, nulls left out; None if all are null) its exact quantile, between two values by proportion.

    The values in question are found by narrowing down: numbers are taken as whole numbers of 64 bits in the same order,
    and each pass over the rows counts, for all columns at once, the next ``DIGIT`` bits of those that agree with what is
    known of the value sought. Tasks and driver hold a count for each digit at most, however many rows there are. NaN is
    the greatest number.
    """
    names = list(columns)
    own = rows.select(*[F.col(c).cast("double").alias(c) for c in names])
    sizes = own.agg(*[F.count(c).alias(c) for c in names]).first()
    exact = {c: (sizes[c] - 1) * q for c in names if sizes[c]}
    # of each column the value at and the one behind its place: what is known of it, and its place among those that agree
    sought = {(c, k): (0, min(int(at) + k, sizes[c] - 1)) for c, at in exact.items() for k in (0, 1)}
    settled = 0
    while sought and settled < 64:
        step = min(DIGIT, 64 - settled)
        known = {which: prefix for which, (prefix, _) in sought.items()}

        def count(batches: Iterator[pa.RecordBatch], known=known, settled=settled, step=step) -> Iterator[pa.RecordBatch]:
            total = {which: np.zeros(1 << step, np.int64) for which in known}
            for batch in batches:
                for c in {c for c, _ in known}:
                    value = batch.column(names.index(c)).drop_null().to_numpy(zero_copy_only=False) + 0.0
                    value[np.isnan(value)] = np.nan  # of one kind
                    bits = value.view(np.int64)
                    key = (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)
                    for k in (0, 1):
                        mine = key if not settled else key[key >> np.uint64(64 - settled) == np.uint64(known[c, k])]
                        digit = (mine >> np.uint64(64 - settled - step)) & np.uint64((1 << step) - 1)
                        total[c, k] += np.bincount(digit.astype(np.int64), minlength=1 << step)
            out = [(c, k, int(d), int(n[d])) for (c, k), n in total.items() for d in np.flatnonzero(n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["c", "k", "d", "n"])

        counts: dict[tuple[str, int], list[tuple[int, int]]] = {which: [] for which in known}
        for r in own.mapInArrow(count, "c string, k long, d long, n long").groupBy("c", "k", "d").agg(F.sum("n").alias("n")).collect():
            counts[r["c"], r["k"]].append((r["d"], r["n"]))
        for which, (prefix, place) in sought.items():
            for d, n in sorted(counts[which]):
                if place < n:
                    break
                place -= n
            sought[which] = prefix << step | d, place
        settled += step

    def number(key: int) -> float:
        bits = key ^ (1 << 63)
        bits = bits ^ 0x7FFFFFFFFFFFFFFF if bits >> 63 else bits
        return float(np.array([bits], np.uint64).view(np.float64)[0])

    out: dict[str, float | None] = dict.fromkeys(names)
    for c, at in exact.items():
        low, high = (number(sought[c, k][0]) for k in (0, 1))
        out[c] = low if at == int(at) or low == high else low + (high - low) * (at - int(at))
    return out


def preparation(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Per feature the training median (0 if all are missing), and mean and population deviation after imputation."""
    medians = exact_quantile(train, features)
    mid = {f: medians[f] if medians[f] is not None else 0.0 for f in features}
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(mid[f])) for f in features]
    stats = train.agg(*[g(x).alias(f"{n}_{f}") for f, x in zip(features, filled) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {f: (mid[f], stats[f"m_{f}"], stats[f"s_{f}"] or 1.0) for f in features}


def design(rows: DataFrame, learnt: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Standardised features and missing indicators as the vector ``x``."""
    out = rows
    for f, (median, mean, sd) in learnt.items():
        out = out.withColumns({f"z_{f}": (F.coalesce(F.col(f).cast("double"), F.lit(median)) - mean) / sd, f"na_{f}": F.col(f).isNull().cast("double")})
    names = [f"{p}_{f}" for p in ("z", "na") for f in learnt]
    return VectorAssembler(inputCols=names, outputCol="x").transform(out)


def fit(train: DataFrame, features: Sequence[str], c: float = 1.0):
    """(what was learnt, the model). Refuses below the minimum sample."""
    counts = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    if counts["n"] < MIN_SAMPLE_N or min(counts["pos"], counts["n"] - counts["pos"]) < MIN_CLASS_N:
        raise InsufficientData(f"{counts['n']} rows, {counts['pos']} positive")
    learnt = preparation(train, features)
    estimator = LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / (c * counts["n"]), elasticNetParam=0.0, standardization=False, tol=1e-9, maxIter=200)
    return learnt, estimator.fit(design(train, learnt))


def predict(rows: DataFrame, fitted) -> DataFrame:
    learnt, model = fitted
    out = model.transform(design(rows, learnt)).withColumn("p_model", vector_to_array("probability")[1])
    return out.select(*rows.columns, "p_model")


def coefficients(spark, fitted) -> DataFrame:
    """Weight and odds ratio of each standardised column; an association, not a cause."""
    learnt, model = fitted
    names = [f"{p}_{f}" for p in ("z", "na") for f in learnt]
    rows = spark.createDataFrame([(n, float(b)) for n, b in zip(names, model.coefficients)], "feature string, weight double")
    return rows.withColumn("odds_ratio", F.exp("weight"))


def windows(cutoffs: Sequence[str]) -> list[tuple[str, str]]:
    return list(zip(cutoffs, cutoffs[1:]))


def split(rows: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """What was resolved by a cut-off, and what was announced behind it up to the end of its window."""
    lo, hi = (F.lit(x).cast("date") for x in (start, end))
    return rows.where(F.col("resolution_date") <= lo), rows.where((F.col("announce_date") > lo) & (F.col("announce_date") <= hi))


def walk_forward(rows: DataFrame, features: Sequence[str], cutoffs: Sequence[str], spread: str | None = None) -> DataFrame:
    """Scores of each window (cutoff, next cutoff] by a model of what was resolved by its cutoff, with the baselines: the
    share of breaks among the training rows, and a model of the spread alone if its column is named.

    A window that can't be fitted gives no scores; ``walk_forward_status`` says why. The few cut-offs are a driver loop;
    every fit and score is a Spark job over all rows of its window. ``rows`` are worked out once and written to the shared
    folder, as a fit reads them dozens of times.
    """
    rows = checkpointed(rows)
    out = rows.limit(0).select("*", *[F.lit(None).cast("double").alias(c) for c in ("p_model", "p_constant", *(("p_spread",) if spread else ()))], F.lit(None).cast("date").alias("train_cutoff"))
    for start, end in windows(cutoffs):
        train, test = split(rows, start, end)
        try:
            scored = predict(test, fit(train, features)).withColumn("p_constant", F.lit(train.agg(F.avg("label")).first()[0]))
            if spread:
                scored = predict(scored.withColumnRenamed("p_model", "_p"), fit(train, [spread])).withColumnsRenamed({"p_model": "p_spread", "_p": "p_model"})
        except InsufficientData:
            continue
        out = out.unionByName(scored.withColumn("train_cutoff", F.lit(start).cast("date")))
    return out


def walk_forward_status(rows: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """A row for each window: sizes and shares of its training and test sets, and whether it can be fitted: ``no_test_rows``,
    ``insufficient_data`` with the reason, or ``fitted``. One pass over all rows."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("window"), F.lit(a).cast("date").alias("train_cutoff"), F.lit(b).cast("date").alias("test_end")) for i, (a, b) in enumerate(windows(cutoffs))])).alias("w")
    train = F.coalesce(F.col("resolution_date") <= F.col("w.train_cutoff"), F.lit(False))
    test = F.coalesce((F.col("announce_date") > F.col("w.train_cutoff")) & (F.col("announce_date") <= F.col("w.test_end")), F.lit(False))
    positive = F.col("label") == 1
    sizes = rows.select("resolution_date", "announce_date", "label", each).groupBy("w").agg(F.count_if(train).alias("n_train"), F.count_if(train & positive).alias("train_pos"), F.count_if(test).alias("n_test"), F.count_if(test & positive).alias("test_pos"))
    fewest = F.least("train_pos", F.col("n_train") - F.col("train_pos"))
    reason = F.when(F.col("n_train") < MIN_SAMPLE_N, "too_few_rows").when(fewest < MIN_CLASS_N, "too_few_of_a_class")
    status = F.when(F.col("n_test") == 0, "no_test_rows").when(reason.isNotNull(), "insufficient_data").otherwise("fitted")
    return sizes.select("w.*", "n_train", "train_pos", "n_test", "test_pos", F.try_divide("train_pos", "n_train").alias("train_prevalence"), F.try_divide("test_pos", "n_test").alias("test_prevalence"), status.alias("status"), F.when(F.col("n_test") > 0, reason).alias("reason"))


def row_digests(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A SHA-256 of each row's content; null is spelled out."""
    text = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__NULL__"))) for c in columns]
    return rows.select(F.sha2(F.concat_ws("\x1f", *text), 256).alias("digest"))


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One digest of all rows, whatever their order: the digests' four lanes of 60 bits are added up, and the sums and the
    number of rows are hashed. It holds a few numbers, however many rows there are."""
    lanes = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = row_digests(rows, columns).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i, x in enumerate(lanes)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("fingerprint"))


def prediction_as_of(predictions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per deal and cut-off the last prediction made by then; several model runs at that time are an ambiguity, not a choice.

    Rows trained after their own as_of leak and never count.
    """
    ok = predictions.where("training_cutoff <= as_of")
    at = ok.groupBy("deal_id", "as_of").agg(F.count_distinct("model_run_id").alias("runs"), F.min(F.struct("model_run_id", "p_break")).alias("x"))
    rows, numbers = at_first_cutoff(at, cutoffs, "as_of")
    last = until_next(rows.groupBy("deal_id", "_i").agg(F.max_by(F.struct("as_of", "runs", "x"), "as_of").alias("r")), ["deal_id"], numbers)
    clear = F.col("r.runs") == 1
    return last.select("deal_id", "cutoff", F.col("r.as_of").alias("as_of"), F.when(clear, "ok").otherwise("ambiguous").alias("state"), F.when(clear, F.col("r.x.p_break")).alias("p_break"))


def covariance_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, cov`` for every pair of columns (doubles), over rows without a null among them.

    Two passes: the means, then products of centred columns, a matrix of partial sums for each task.
    """
    full = rows.select(*columns).dropna()
    means = full.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] if means[c] is not None else 0.0 for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(columns), len(columns))), 0
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in columns], axis=1) - centre
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(total.size), len(columns))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel()), pa.array(np.full(total.size, n))], names=["i", "j", "s", "n"])

    sums = full.mapInArrow(run, "i long, j long, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), (F.col(c) + 1).cast("int"))
    return sums.select(name("i").alias("a"), name("j").alias("b"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).alias("cov"))
