"""Loops over a large check's edges: what passes through the driver, and when they end."""

from __future__ import annotations

from drawkit.operators import graph

EDGES = "check_id long, parent long, child long"


def counted(monkeypatch):
    """The number of broadcasts in the plan of each result that a loop settles."""
    seen, settled = [], graph.settled

    def record(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange"))
        return settled(df)

    monkeypatch.setattr(graph, "settled", record)
    return seen


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    """rounds join by shuffles; only the list of large checks is broadcast, once for each split."""
    monkeypatch.setattr(graph, "MOST_EDGES", 0)
    seen = counted(monkeypatch)
    ring = [(1, k, (k + 1) % 6) for k in range(6)] + [(1, 5, 6), (1, 6, 7)]
    edges = spark.createDataFrame(ring, EDGES)
    got = {(r.parent, r.child): r.in_cycle for r in graph.in_cycle(edges).collect()}
    assert got == {(a, b): b < 6 for _, a, b in ring}
    assert len(seen) > 10 and sum(seen) <= 4


def test_what_fits_a_task_ends_the_loop(spark, monkeypatch):
    """a check that peeling brings down to MOST_EDGES goes on in one task."""
    monkeypatch.setattr(graph, "MOST_EDGES", 8)
    seen = counted(monkeypatch)
    rows = [(1, k, (k + 1) % 8) for k in range(8)] + [(1, k, 100 + k) for k in range(8)] + [(2, 1, 2), (2, 2, 1), (2, 2, 3)]
    got = {(r.check_id, r.parent, r.child): r.in_cycle for r in graph.in_cycle(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {(c, a, b): b < 8 and (c, b) != (2, 3) for c, a, b in rows}
    assert len(seen) <= 4
