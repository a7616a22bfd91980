"""What the review of round 4 asked for."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tidemark.operators import simulation
from tidemark.sources import formulas, workbook


def test_first_bits_decide_as_whole_numbers_do():
    rng = np.random.default_rng(2)
    bars, shift = np.sort(rng.normal(-0.7, 0.01, 13)), rng.normal(0, 0.4, 4000)
    low, high = ((simulation.chance(bars[k] - shift) * simulation.FIRST).astype(np.uint16) for k in (0, -1))
    got = simulation.broken(simulation.draws(1, 0, 0), bars, shift, low, high - low)
    again = simulation.draws(1, 0, 0)
    first = again.bit_generator.random_raw(13 * 1000).view(np.uint16).reshape(13, 4000)
    own = np.array([simulation.chance(bar - shift) for bar in bars])
    sure = (first < low) | (first > high)
    assert 0.9 < sure.mean() < 1 and (got == (first < own * simulation.FIRST))[sure].all()
    assert abs(got[~sure].mean() - ((own * simulation.FIRST - low) / (high - low + 1.0))[~sure].mean()) < 0.05


def test_chances_and_sums_of_subsets():
    assert simulation.chance(np.array([-1.0, 0.0, 9.0, np.nan])) == pytest.approx([0.15865525393145707, 0.5, 1.0, 0.0])
    amounts = np.arange(1.0, 12.0)
    sums = simulation.subset_sums(amounts)
    assert sums.shape == (2, 256) and sums[0, 0b10000101] == 1 + 3 + 8 and sums[1, 0b110] == 10 + 11 and sums[1, 0b11111111] == 30


def test_every_position_breaks_as_often_as_its_own_chance_says(spark):
    book = spark.range(40).selectExpr("id as deal_id", "array(0.0D, 0.0005D, 0.001D, 0.3D, 0.3007D, 0.9999D, 1.0D, 0.5D)[id % 8] as p_break", "pow(2.0D, id) as downside_notional", "0.0D as upside_notional")
    paths = simulation.simulate(book, paths=50_000, rho=0.15).toPandas()
    assert sorted(paths.path) == list(range(50_000))
    lost = (-paths.pnl).astype("int64").to_numpy()  # each position's own bit
    often = np.array([(lost >> i & 1).mean() for i in range(40)])
    assert (paths.breaks == np.bitwise_count(lost)).all()
    assert np.abs(often - np.tile([0.0, 0.0005, 0.001, 0.3, 0.3007, 0.9999, 1.0, 0.5], 5)).max() < 0.01
    x, y = lost >> 3 & 1, lost >> 11 & 1  # copulas of 0.15 at 0.3 have both in 0.1074
    assert (x & y).mean() == pytest.approx(0.1074, abs=0.007)


def test_a_book_of_many_chances_asks_for_few_whole_numbers(spark):
    few, most = [], 200
    noise = simulation.draws(1, 0, 0)

    class Counted:
        bit_generator = noise.bit_generator

        def random(self, n):
            few.append(n)
            return noise.random(n)

    shift = np.random.default_rng(1).normal(0, 0.4, 20_000)
    low = (simulation.chance(-0.7 - shift) * simulation.FIRST).astype(np.uint16)
    for _ in range(8):
        simulation.broken(Counted(), np.full(8, -0.7), shift, low, low - low)
    assert sum(few) < most  # of 1,280,000
    empty = spark.createDataFrame([], "deal_id long, p_break double, downside_notional double, upside_notional double")
    assert simulation.simulate(empty, paths=10).count() == 0


def book_of(rng, file, n):
    """Cells with numbers, texts, blanks, truths and errors, stored or not, circles, repeated cells and formulas that can't be read."""
    cells = []
    for row in range(1, n + 1):
        for col in range(1, 6):
            a, b, c = rng.integers(1, n + 1), rng.integers(1, n + 1), "ABCDE"[rng.integers(0, 5)]
            asked = [f"SUM(A{min(a, b)}:A{max(a, b)})", f"IF(COUNT(A1:{c}{a})>3,MAX(A1:B{b})-MIN(A{b}:B{b}),\"none\")", f"{c}{a}+1", f"{c}{a}&\"x\"", f"{c}{a}>B{b}", f"IFERROR(A{a}/B{b},AVERAGE(B:B))", f"FOO({c}1)", f"Other!A{a}*2", f"ISNUMBER({c}{a})"]
            kind = rng.integers(0, 8)
            text, formula = (str(float(rng.integers(0, 9))) if kind < 4 else None if kind == 4 else "t" if kind == 5 else "#N/A"), None
            if col > 2 or rng.random() < 0.03:
                formula = asked[rng.integers(0, len(asked))]
                text = None if rng.random() < 0.7 else text
            number = float(text) if text and text[0].isdigit() else None
            cells += [(file, "Other" if row % 17 == 0 else "Log", row, col, text, number, formula)] * (2 if rng.random() < 0.02 else 1)
    return cells + [(file, None, 1, 1, "1", 1.0, None), (file, None, 1, 2, None, None, "A1+1"), (file, "Log", None, 1, "5", 5.0, "A1")]


def test_files_in_a_task_and_spread_over_tasks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    cells = [cell for file, n in (("a", 12), ("b", 90), (None, 3), ("c", 40)) for cell in book_of(rng, file, n)]
    sheets = spark.createDataFrame(cells, workbook.CELLS)

    def found(least):
        monkeypatch.setattr(formulas, "FILE_CELLS", least)
        return sorted((str([round(x, 6) if isinstance(x, float) else x for x in row]) for row in formulas.gate(sheets).collect()))

    together, apart, mixed = found(1 << 16), found(0), found(250)
    assert together == apart == mixed
    assert len(together) == sum(cell[6] is not None for cell in cells) and len({x.split(", ")[-2] for x in together}) >= 5


def test_small_files_meet_in_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(formulas, "by_rounds", None)
    cells = [(f"f{i}", "S", r, c, text, number, formula) for i in range(20) for r, c, text, number, formula in ((1, 1, "2.0", 2.0, None), (1, 2, None, None, "C1*2"), (1, 3, None, None, "SUM(A1:A1)+1"))]
    checked = formulas.gate(spark.createDataFrame(cells, workbook.CELLS))
    plan = checked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {(r["col"], r["expected"], r["status"]) for r in checked.collect()} == {(2, 6.0, "computed"), (3, 3.0, "computed")}


def test_long_columns_of_growing_ranges_and_long_chains():
    n = 12_000
    cells = [("S", r, 1, str(r), float(r), None) for r in range(1, n + 1)] + [("S", r, 2, None, None, f"SUM(A1:A{r})") for r in range(1, n + 1)] + [("S", r, 3, None, None, f"C{r + 1}+1" if r < n else "B1") for r in range(1, n + 1)]
    start = time.process_time()
    found = {cells[k][1:3]: number for k, number, _, waits, problem in formulas.of_file(cells) if not waits and problem is None}
    assert time.process_time() - start < 20
    assert all(found[r, 2] == r * (r + 1) / 2 and found[r, 3] == n - r + 1 for r in range(1, n + 1))
