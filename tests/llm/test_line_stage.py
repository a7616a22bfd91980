"""The pipeline's line dedup deletes what repeats, be it one line."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_operators import docs


def test_single_lines_between_differing_neighbours_go(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage), (4, "e\n \nf\ne")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_repeated_lines(spark, docs(spark, rows), "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("c\nd", 3), 3: ("", 0), 4: ("e\n \nf", 5)}
