"""Experiments: identities of model runs, the registry, preparation that never fits, baselines, challengers, gates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import COST_FN, COST_FP, COST_RATIO_GRID, MIN_CLASS_N, MIN_SAMPLE_N, SNAPSHOT_POLICIES, STRATEGY_VERSION
from tidemark.operators.model import InsufficientData, design, fingerprint
from tidemark.operators.ordering import small

#: The contract that a protocol must state as it is here.
LOCKED = {
    "STRATEGY_VERSION": STRATEGY_VERSION, "MODEL_VERSION": "break_logit_v1", "FEATURE_SCHEMA_VERSION": "fs_v1", "C": 1.0, "penalty": "l2", "calibration": "none",
    "MIN_SAMPLE_N": MIN_SAMPLE_N, "MIN_CLASS_N": MIN_CLASS_N, "COST_FN": COST_FN, "COST_FP": COST_FP, "COST_RATIO_GRID": list(COST_RATIO_GRID),
}
#: The challenger's identity, the draft's state and what keeps it from being frozen.
CHALLENGER = {"model_id": "spread_stress", "model_version": "spread_stress_v1", "feature_schema_version": "fs_spread_stress_v1"}
DRAFT = {"spec_version": "spread_stress_v2", "status": "draft", "recommended_policy": "ann_tplus_10_session", "weighting": "deal_equal_snapshot_weight", "split": "grouped_chronological_by_announcement"}
BLOCKERS = ("SPEC_STATUS_DRAFT", "NYSE_SESSION_CALENDAR_REQUIRED", "TIMEZONE_AWARE_INTRADAY_REQUIRED", "ACTIVE_AT_FEATURE_TIME_MUST_USE_PIT_KNOWN_AT", "RESOLUTION_MUST_NOT_CHOOSE_FEATURE_DATES")


class NotAuthorized(RuntimeError):
    """An experiment that isn't authorised doesn't run."""


def run_id(**parts: object) -> str:
    """The identity of a model run: a hash of all that makes it, so the same fit has the same id whenever it is made."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()).hexdigest()


def model_to_dict(fitted, features: Sequence[str]) -> dict:
    """A fitted model (model.fit) as plain values."""
    learnt, model = fitted
    return {"features": list(features), "learnt": {f: list(learnt[f]) for f in features}, "coef": [float(x) for x in model.coefficients], "intercept": float(model.intercept)}


def scored_by(rows: DataFrame, stored: dict) -> DataFrame:
    """``rows`` with ``p_model`` by a model that was stored with ``model_to_dict``."""
    learnt = {f: tuple(stored["learnt"][f]) for f in stored["features"]}
    names = [f"{p}_{f}" for p in ("z", "na") for f in learnt]
    z = F.lit(stored["intercept"])
    for name, weight in zip(names, stored["coef"]):
        z = z + F.col(name) * weight
    return design(rows, learnt).withColumn("p_model", 1 / (1 + F.exp(-z))).select(*rows.columns, "p_model")



def registered(training: DataFrame, cohort: DataFrame | None, stored: dict, cutoff: str, columns: Sequence[str], claimed: str | None = None) -> DataFrame:
    """The registry row of a fitted model, or an error: labels must be 0 or 1, members of the cohort, and a claimed fingerprint true."""
    sizes = training.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")).first()
    if not sizes["n"]:
        raise InsufficientData("no training rows")
    if sizes["n_pos"] + sizes["n_neg"] != sizes["n"]:
        raise ValueError("labels must be 0 or 1")
    if cohort is not None and training.join(cohort.select("deal_id").distinct(), "deal_id", "left_anti").limit(1).count():
        raise ValueError("training deals outside the cohort")
    own = fingerprint(training, columns).first()["fingerprint"]
    if claimed is not None and claimed != own:
        raise ValueError("the claimed fingerprint isn't that of the rows")
    identity = {"model_version": LOCKED["MODEL_VERSION"], "feature_schema_version": LOCKED["FEATURE_SCHEMA_VERSION"], "training_cutoff": cutoff, "dataset_fingerprint": own, "artifact": json.dumps(stored, sort_keys=True)}
    row = identity | {"model_run_id": run_id(**identity), "n_train": sizes["n"], "n_pos": sizes["n_pos"], "n_neg": sizes["n_neg"], "sample_prevalence": sizes["n_pos"] / sizes["n"]}
    kinds = "model_version string, feature_schema_version string, training_cutoff string, dataset_fingerprint string, artifact string, model_run_id string, n_train long, n_pos long, n_neg long, sample_prevalence double"
    return training.sparkSession.createDataFrame([row], kinds)


def loaded(registry: DataFrame, model_run_id: str) -> dict:
    """The stored model of exactly that run."""
    found = registry.where(F.col("model_run_id") == model_run_id).select("artifact").distinct().take(2)
    if len(found) != 1:
        raise LookupError(f"{len(found)} artifacts for {model_run_id}")
    return json.loads(found[0]["artifact"])


def contract_drift(protocol: dict) -> list[str]:
    """Names of the locked values that a protocol states otherwise."""
    return [n for n, v in LOCKED.items() if protocol.get(n) != v]


def refuse_execution(protocol: dict) -> None:
    if not protocol.get("execution_authorized"):
        raise NotAuthorized("execution isn't authorised")


def prepared_plan(rows: DataFrame, cohort: DataFrame, cutoffs: Sequence[str], horizon: str, protocol: dict) -> DataFrame:
    """Each window's training and test sets, by size, class and fingerprint; nothing is fitted.

    Rows: deal_id, feature_at, label, resolved_at (dates). A protocol that drifts from the locked contract, or that claims
    to be authorised, is refused. A training row was resolved by the cut-off; a test row's features lie behind it.
    """
    if protocol.get("execution_authorized"):
        raise NotAuthorized("preparation doesn't run authorised protocols")
    if drift := contract_drift(protocol):
        raise ValueError(f"locked contract drift: {drift}")
    spark, ends = rows.sparkSession, [*cutoffs[1:], horizon]
    windows = small(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cutoffs, ends))], "window int, a string, b string").select("window", F.col("a").cast("date").alias("cutoff"), F.col("b").cast("date").alias("test_end")))
    own = rows.join(cohort.select("deal_id").distinct(), "deal_id", "left_semi").join(windows, F.col("feature_at") <= F.col("test_end"))
    role = F.when((F.col("resolved_at") <= F.col("cutoff")) & (F.col("feature_at") <= F.col("cutoff")), "train").when((F.col("feature_at") > F.col("cutoff")) & (F.col("resolved_at") <= F.lit(horizon).cast("date")), "test")
    marked = own.withColumn("role", role).where("role is not null")
    digest = F.sha2(F.concat_ws("\x1f", F.col("deal_id").cast("string"), F.date_format("feature_at", "yyyy-MM-dd"), F.col("label").cast("string")), 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(2)]
    sizes = marked.groupBy("window", "cutoff", "test_end", "role").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *lanes), 256).alias("fingerprint"))
    pick = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    out = sizes.groupBy("window", "cutoff", "test_end").agg(*[F.coalesce(pick(r, c), F.lit(0)).alias(f"{c}_{r}") for r in ("train", "test") for c in ("n", "n_pos")], *[pick(r, "fingerprint").alias(f"fingerprint_{r}") for r in ("train", "test")])
    enough = (F.col("n_train") >= MIN_SAMPLE_N) & (F.least(F.col("n_pos_train"), F.col("n_train") - F.col("n_pos_train")) >= MIN_CLASS_N)
    return out.withColumns({"meets_minimum": enough, "status": F.lit("PREPARED_NOT_FITTED")})


def constant_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Every test row scored with the share of breaks among the training rows."""
    rate = train.agg(F.avg(F.col("label").cast("double")).alias("p_constant"))
    return test.crossJoin(F.broadcast(rate))


def challenger_fits(stored: dict) -> bool:
    """Whether a stored model is the challenger's; another version or feature schema isn't loaded as one."""
    return all(stored.get(k) == v for k, v in CHALLENGER.items())


def diagnostic_delta(stress: Column, base: Column) -> Column:
    """By how much the challenger's score is above the base model's."""
    return stress.cast("double") - base.cast("double")


def policy_document(spark: SparkSession) -> DataFrame:
    """The draft's snapshot policies, one row for each offset, with the rules that go with them."""
    rows = [(name, kind, n, len(offsets), name == DRAFT["recommended_policy"], DRAFT["weighting"] if len(offsets) > 1 else None, False) for name, (kind, offsets) in SNAPSHOT_POLICIES.items() for n in offsets]
    return spark.createDataFrame(rows, "policy string, counted_in string, after int, n_snapshots int, recommended boolean, weighting string, uses_resolution boolean")


def authorisation() -> dict:
    """A draft doesn't run, whatever else is ready."""
    return {"authorized": False, "reason": f"{DRAFT['spec_version']} is {DRAFT['status']}", "blockers": list(BLOCKERS), "MIN_SAMPLE_N": MIN_SAMPLE_N, "MIN_CLASS_N": MIN_CLASS_N}


def fit_draft(*_: object) -> None:
    raise NotAuthorized(authorisation()["reason"])


def contract_flags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Artifacts (name, sha256) of a locked baseline before and after a run: unchanged, changed, added or removed."""
    both = before.select("name", F.col("sha256").alias("a")).join(after.select("name", F.col("sha256").alias("b")), "name", "full_outer")
    return both.select("name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("state"))
