"""The pipeline's stages and its run."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD_TEXTS, odd
from tidemark.llm import common

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "packing"]
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3]


def test_run_packs_what_the_stages_leave(spark):
    pieces = corpus_pipeline.run(spark, SF)
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    rows = docs.select("doc_id", "text").collect()
    once = {r["doc_id"]: r["text"] for r in rows}
    assert pieces.agg({"length": "sum"}).first()[0] == sum(r["doc_tokens"] for r in pieces.where("start = 0").collect())
    first = pieces.dropDuplicates(["doc_id", "start"]).collect()
    assert {p["doc_id"] for p in first} == set(once)
    assert pieces.where("start = 0").count() == len(rows)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables of odd rows, of no rows, and labels for both."""
    out = {}
    for name, rows in (("odd", odd(spark)), ("empty", spark.createDataFrame([], DOCS))):
        out[name] = str(tmp_path_factory.mktemp(name))
        rows.write.parquet(f"{out[name]}/documents.parquet")
        common.table(spark, SF, "labels").write.parquet(f"{out[name]}/labels.parquet")
    return out


def test_run_on_an_empty_table(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).collect() == []


def test_run_on_odd_rows(spark, folders):
    """Whatever the classifier thinks of them, nothing crashes and what it keeps is packed whole."""
    left = common.table(spark, folders["odd"], "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folders["odd"])
        assert left.columns == common.table(spark, folders["odd"], "documents").columns
    pieces = corpus_pipeline.run(spark, folders["odd"])
    assert pieces.where("start = 0").count() == left.count()


@pytest.mark.parametrize(("name", "want"), [
    ("line dedup", {i: None for i, _ in ODD_TEXTS}), ("simhash near-dedup", {1: 1, 4: 2, None: 1, 5: 1, 6: 1}), ("packing", {i: None for i, _ in ODD_TEXTS}),
])
def test_stages_on_odd_rows(spark, folders, name, want):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, common.table(spark, folders["odd"], "documents"), folders["odd"]).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    counts = {r["doc_id"]: r["n"] for r in got}
    assert set(counts) == set(want) and all(n is None or counts[i] == n for i, n in want.items())
    if name == "line dedup":
        assert sum(counts.values()) == len(ODD_TEXTS)


def test_only_the_result_stays_in_the_shared_folder(spark):
    before = set(map(str, Path(common.shared_folder(spark).removeprefix("file:")).glob("pipeline-*/*.parquet")))
    corpus_pipeline.run(spark, SF)
    after = set(map(str, Path(common.shared_folder(spark).removeprefix("file:")).glob("pipeline-*/*.parquet")))
    assert {x.rpartition("/")[2] for x in after - before} == {"4.parquet"}
