"""The Monte Carlo query draws as many paths as the reference does by default."""

from __future__ import annotations

from tidemark.operators import simulation
from tidemark.plans import model_queries


def test_monte_carlo_draws_the_references_paths(spark, monkeypatch):
    asked = {}

    def simulate(book, paths=simulation.SIMULATION_PATHS):
        asked["paths"] = paths
        return book.selectExpr("downside_notional as pnl")

    monkeypatch.setattr(simulation, "simulate", simulate)
    model_queries.monte_carlo(spark, "/root/testdata/sf0.001")
    assert asked["paths"] == 100_000
