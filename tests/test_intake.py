"""Extraction, listings, intake, identities, experiments, ordering: what the queries over the driver's tables don't reach."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import extract, listing
from tidemark.operators import evidence, experiment, identity, intake, market, model, ordering
from tidemark.storage import checkpointed


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 256, 1000])
def test_earlier_below_is_a_count(n):
    values = np.random.default_rng(n).permutation(n)
    assert ordering.earlier_below(values).tolist() == [sum(values[j] < values[i] for j in range(i)) for i in range(n)]


def test_numbers_run_on_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.random(), i) for i in range(500)]
    got = ordering.numbered(spark.createDataFrame(rows, "k string, v double, i int").repartition(7), ["k"], ["v", "i"], "n").collect()
    for key in "ab":
        assert [r["n"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["v"])] == list(range(sum(k == key for k, _, _ in rows)))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_counts_below_so_far_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, i, float(rng.randrange(12))) for k in "ab" for i in range(90 if k == "a" else 5)]
    got = ordering.below_so_far(spark.createDataFrame(rows, "k string, t int, v double").repartition(5), "k", "t", "v", block).collect()
    want = {(k, t): (sum(a == k and b < t for a, b, _ in rows), sum(a == k and b < t and w <= v for a, b, w in rows)) for k, t, v in rows}
    assert {(r["k"], r["t"]): (r["n_before"], r["n_below"]) for r in got} == want


def test_percentile_of_a_long_series(spark):
    rows = spark.range(200_000).select(F.lit("s").alias("series_id"), F.date_add(F.lit("1500-01-01").cast("date"), F.col("id").cast("int")).alias("obs_date"), (F.col("id") % 1000).cast("double").alias("close"))
    last = market.expanding_percentile(rows, "close").orderBy(F.col("obs_date").desc()).first()
    assert last["pctile"] == 1.0


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_revision_chains_of_any_length(spark, n):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(1000, 999)], "evidence_id long, revises long").repartition(3)
    got = {r["evidence_id"]: (r["root"], r["steps"]) for r in evidence.revision_chain(rows).collect()}
    assert got == {**{i: (0, i) for i in range(n)}, 1000: (999, 1)}


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 0)], [(0, 0)], [(0, 1), (1, 2), (2, 0), (5, None)]])
def test_a_cycle_of_revisions_raises(spark, pairs):
    with pytest.raises(ValueError, match="cycle"):
        evidence.revision_chain(spark.createDataFrame(pairs, "evidence_id long, revises long"))


def test_terms_of_press_releases(spark):
    texts = [
        "Annie's, Inc. to be acquired by General Mills for $46.00 per share in cash.",
        "an affiliate of Vector Capital (the fund) under which holders get $9.00 per share",
        "MaxLinear deal: $1.20 in cash per share and 0.22 shares of MaxLinear common stock for each share at an exchange ratio of 0.22.",
        "exchange ratio of 0.5 and later an exchange ratio of 0.7 and 0.5 of a share of X",
        "Holders may elect cash. $5.00 per share in cash.",
    ]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", extract.deal_terms(F.col("t")).alias("f")).select("i", extract.decided_terms(F.col("f")).alias("x")).orderBy("i").collect()
    got = [tuple(r["x"])[:3] for r in rows]
    assert got[0] == ("cash", 46.0, None) and rows[0]["x"]["acquirer"] == "General Mills"
    assert got[1] == ("cash", 9.0, None) and rows[1]["x"]["acquirer"] == "Vector"
    assert got[2] == ("mixed", 1.2, 0.22) and got[3] == ("stock", None, 0.5) and rows[4]["x"]["reason"] == "unsupported_mechanics"


@pytest.mark.parametrize(("name", "target", "code"), [
    ("Acme Holdings Inc", "Widget", None), ("Permira", "Widget", None), ("", "Widget", "missing"), ("an affiliate", "Widget", "no_entity"), ("Parent", "Widget", "role_word"), ("Widget Corp", "Widget Inc", "equals_the_target"),
    ("(iv) Acme Corp", "Widget", None), ("(iv)x the Parent Corp", "Widget", "residue"), ("Acme Corp for $5", "Widget", "price"), ("Acme and Other Inc", "Widget", "several_parties"), ("red house", "Widget", "no_entity_form"), ("Acme Corp Olathe", "Widget", "trailing_place"), ("Acme Inc which is in 2014", "Widget", "residue"), ("Big Widget Partners", "Widget Co", "names_the_target"),
])
def test_who_can_be_a_buyer(spark, name, target, code):
    assert one(spark, x=intake.acquirer_refusal(F.lit(name), F.lit(target)))["x"] == code


def test_name_next_to_its_ticker(spark):
    text = "Buyer Corp (NYSE: BUY) will acquire Widget Makers (NASDAQ: WDG). Nothing that stands this far behind the name is the name of a ticker (NYSE: OLD)"
    assert one(spark, x=listing.adjacent_ticker(F.lit(text), F.lit("Widget Makers Inc")))["x"] == "WDG"
    assert one(spark, x=listing.adjacent_ticker(F.lit("Widget (NYSE: A) Widget (NYSE: B)"), F.lit("Widget")))["x"] is None
    assert one(spark, x=listing.adjacent_ticker(F.lit("no tickers"), F.lit("Widget")))["x"] is None


def test_review_order_is_blind_to_outcomes(spark):
    rows = spark.createDataFrame([(3, "DEFERRED_IDENTITY", "closed"), (1, "DEFERRED_IDENTITY", "broken"), (2, "x", "closed")], "deal_id long, canonical_status string, outcome string")
    assert [(r["deal_id"], r["place"]) for r in identity.review_order(rows).orderBy("place").collect()] == [(1, 1), (3, 2)]
    with pytest.raises(ValueError, match="outcome"):
        identity.review_order(rows, ["outcome", "deal_id"])


def training(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * x))).astype(float)
    return spark.createDataFrame([(i, float(y[i]), None if i % 9 == 0 else float(x[i])) for i in range(200)], "deal_id long, label double, x1 double")


def test_registry_keeps_the_exact_model(spark):
    rows = training(spark)
    fitted = model.fit(rows, ["x1"])
    stored = experiment.model_to_dict(fitted, ["x1"])
    row = experiment.registered(rows, rows.select("deal_id"), stored, "2026-01-01", ["deal_id", "label", "x1"])
    again = experiment.registered(rows.repartition(5), None, stored, "2026-01-01", ["deal_id", "label", "x1"]).first()
    first = checkpointed(row).first()
    assert first["model_run_id"] == again["model_run_id"] and first["n_train"] == 200
    want = {r["deal_id"]: r["p_model"] for r in model.predict(rows, fitted).collect()}
    got = experiment.scored_by(rows, experiment.loaded(row, first["model_run_id"])).collect()
    assert all(r["p_model"] == pytest.approx(want[r["deal_id"]]) for r in got) and len(got) == 200
    with pytest.raises(LookupError):
        experiment.loaded(row, "none")
    with pytest.raises(ValueError, match="cohort"):
        experiment.registered(rows, rows.where("deal_id > 5").select("deal_id"), stored, "2026-01-01", ["deal_id"])
    with pytest.raises(ValueError, match="fingerprint"):
        experiment.registered(rows, None, stored, "2026-01-01", ["deal_id"], "abc")
    with pytest.raises(ValueError, match="0 or 1"):
        experiment.registered(rows.withColumn("label", F.lit(2.0)), None, stored, "2026-01-01", ["deal_id"])
    with pytest.raises(model.InsufficientData):
        experiment.registered(rows.limit(0), None, stored, "2026-01-01", ["deal_id"])


def test_nothing_runs_unauthorised(spark):
    rows = spark.createDataFrame([(1, date(2026, 1, 1), 1, date(2026, 2, 1))], "deal_id long, feature_at date, label int, resolved_at date")
    with pytest.raises(experiment.NotAuthorized):
        experiment.refuse_execution({})
    with pytest.raises(experiment.NotAuthorized):
        experiment.prepared_plan(rows, rows, ("2026-01-15",), "2026-12-31", {**experiment.LOCKED, "execution_authorized": True})
    with pytest.raises(ValueError, match="MIN_SAMPLE_N"):
        experiment.prepared_plan(rows, rows, ("2026-01-15",), "2026-12-31", {**experiment.LOCKED, "MIN_SAMPLE_N": 1})
    with pytest.raises(experiment.NotAuthorized, match="draft"):
        experiment.fit_draft()
    assert experiment.challenger_fits(dict(experiment.CHALLENGER)) and not experiment.challenger_fits({"model_version": "break_logit_v1"})
    assert not experiment.authorisation()["authorized"]


def test_covariances_equal_numpys(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e4, 3, size=(300, 4))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").repartition(3)
    got = {(r["a"], r["b"]): r["cov"] for r in model.covariance_matrix(rows, rows.columns).collect()}
    want = np.cov(x.T)
    assert all(got["abcd"[i], "abcd"[j]] == pytest.approx(want[i, j]) for i in range(4) for j in range(4)) and len(got) == 16
    assert {r["cov"] for r in model.covariance_matrix(rows.limit(0), ["a", "b"]).collect()} <= {None}


def test_a_small_side_is_broadcast_and_a_large_one_not(spark, monkeypatch):
    rows = spark.range(1000)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(ordering.small(rows))
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 10)
    assert not hinted(ordering.small(rows))


def test_kinds_of_events(spark):
    seen = [one(spark, x=intake.window_event(F.lit(t)))["x"] for t in ("announced+closed", "announced", "CMA Phase 1 launched; more", "nonsense")]
    assert seen == ["closing", None, "regulatory_phase1_launched", "unmapped"]
    assert Counter(intake.DEAL_KINDS) == Counter({"signed_definitive": "DEAL", "proposal": "PROP", "unverified": "UNVR"}) or len(intake.DEAL_KINDS) == 3


def plain_candidates(text):
    """The buyers of a text by its patterns alone, tried at every letter."""
    import re

    from tidemark.functions.scan import cleaned

    pattern = lambda p: re.compile(p, re.ASCII)
    head, whole = text[: extract.BUYER_HEAD], text[: extract.PARTY_HEAD]
    found = [m[1] for p in (*extract.TARGET_SIDE_CASH, extract.ACQUIRED_BY, *extract.ACQUIRER_PATTERNS) if (m := pattern(p).search(head))]
    for m in pattern(extract.ACQUIRES).finditer(head):
        raw = m[1].strip()
        if raw.lower() not in extract.SHELLS and not raw.lower().startswith(extract.SHELL_STARTS) and not pattern(extract.INTENT).search(raw):
            found.append(raw)
    found += [m[1] for m in pattern(extract.AMONG).finditer(whole) if m[1].strip().lower() not in extract.AMONG_SHELLS]
    for p, where in ((extract.QUOTED_ROLE, whole), (extract.ROLE_BEHIND, whole), (extract.PENDING, head)):
        found += [m[1] for m in pattern(p).finditer(where)]
    return list(dict.fromkeys(name for raw in found if (name := cleaned(raw))))


PIECES = """Acme Holdings Inc|General Mills, Inc.|an affiliate of Vector Capital|The Permira Funds|the  Permira|KKR & Co|Parent|Merger Sub|to be acquired by|will be acquired by|acquired by|would acquire|will acquire|has agreed to acquire|to acquire|for $12.50 per share in cash|
 $7 per share|(NYSE: ACM)|(Nasdaq: WDG) (note)|(the fund)|under which holders get|desires|.|,|and|led by|Funds advised by Apax|Agreement and Plan of Merger by and among Parentco Inc, Merger Sub|Merger Agreement among Foo,|Parent "Imerys SA"|Buyer “Big Co”|Imerys SA ("Parent")|
 Lindsay (Purchaser)|pending acquisition of Widget by Foo Bar Inc.|proposed merger with X by Y Corp,|ÉTÉ SA|\n|  """.replace("\n ", "").split("|")


def test_buyer_candidates_against_plain_search(spark):
    import random

    rng = random.Random(11)
    texts = [" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(1500)] + ["", "x" * 24_010 + " acquired by Late Corp, ", 'y' * 39_000 + ' Parent "Also Found SA" ' + 'z' * 2_000 + ' Parent "Too Late SA" ']
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").repartition(4)
    got = {r["i"]: r["x"] for r in df.select("i", extract.buyer_candidates(F.col("t")).alias("x")).collect()}
    assert got.pop(-1) == []
    assert [got[i] for i in range(len(texts))] == [plain_candidates(t) for t in texts]
    assert got[len(texts) - 2] == [] and got[len(texts) - 1] == ["Also Found SA"]


def test_terms_beyond_the_head_need_a_longer_one(spark):
    text = "x " * 10_000 + "to be acquired by General Mills for $46.00 per share in cash."
    rows = spark.createDataFrame([(text,)], "t string")
    price = lambda **k: rows.select(extract.deal_terms(F.col("t"), **k).alias("f")).select(extract.decided_terms(F.col("f")).alias("x")).first()["x"]["offer_price"]
    assert price() is None and price(head=30_000) == 46.0


def test_extraction_of_long_texts_takes_seconds(spark):
    """400 texts of 18 KB; column expressions took 24 and 61 seconds for terms and tickers."""
    import time

    text = ("The boards approved the deal at $45.00 per share in cash (NASDAQ: WDG) as affiliates of the parent elected. " * 170)[:18_000]
    rows = spark.range(400).repartition(4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).persist()
    rows.count()
    for found in (extract.deal_terms(F.col("t")), extract.buyer_candidates(F.col("t")), listing.filing_identity(F.col("t"), F.lit("Widget"), F.lit(True))):
        start = time.perf_counter()
        rows.select(found.alias("x")).write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - start < 12
    rows.unpersist()


def test_a_refused_buyer_gives_way_to_the_next_candidate(spark):
    text = "x" * 200 + " Widget Inc is to be acquired by Parent for $12.50 per share in cash. "
    texts = [text, text + 'Parent "Imerys SA" pays.', text + "Widget Inc is acquired by Acme Holdings Inc, while Foo Corp will acquire Acme today."]
    n = range(len(texts))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = intake.resolve_candidates(
        frame([(i, i, "Widget Inc", f"A{i}") for i in n], "rank long, target_cik long, target string, accession string"),
        frame([(i, f"A{i}", "2026-03-01", ["announcement"]) for i in n], "cik long, accession string, filed string, events array<string>").withColumn("filed", F.to_date("filed")),
        frame([(f"A{i}", t, "Agreement and Plan of Merger by and among Agreed Corp, Merger Sub and the Company" if i == 0 else None) for i, t in enumerate(texts)], "accession string, text string, agreement string"),
        frame([(i, f"A{i}", "closed", "2026-08-01") for i in n], "cik long, accession string, resolution string, resolution_date string").withColumn("resolution_date", F.to_date("resolution_date")),
        frame([], "cik long"), 20,
    )
    assert [(r["decision"], r["reason"], r["entry"] and r["entry"]["acquirer"]) for r in got.orderBy("rank").collect()] == [("ADMIT", "rules_pass", "Agreed Corp"), ("ADMIT", "rules_pass", "Imerys SA"), ("EXCLUDE", "party_inversion", None)]
