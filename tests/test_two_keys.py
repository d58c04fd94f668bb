"""Rows accepted by two keys: components against a plain loop, long chains, rounds for large components."""

import random

import pytest

from prospectra.operators import graph, relational


def plain(rows):
    seen_d, seen_n, want = set(), set(), []
    for i, d, n in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2] is None, r[2] or "")):
        if d not in seen_d and n not in seen_n:
            seen_d.add(d)
            seen_n.add(n)
            want.append((i, d, n))
    return sorted(map(str, want))


def got(frame, **more):
    return sorted(str((r.id, r.d, r.n)) for r in relational.greedy_two_keys(frame, "d", "n", "id", **more).collect())


@pytest.mark.parametrize("large, rounds", [(0, 1), (8, 1), (1000, 3)])
def test_components_and_rounds_match_a_loop(spark, large, rounds):
    rng = random.Random(large)
    rows = [(i, f"d{rng.randrange(150)}", f"n{rng.randrange(150)}") for i in range(160)] + [(i + 0, "hub", f"m{i}") for i in range(300, 340)]
    rows += [(None, "d1", "late"), (None, None, "n3"), (401, None, None), (400, None, "x"), (5, "same", "order"), (5, "same", "other"), *[(500 + i, "copy", "copy") for i in range(20)]]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "id int, d string, n string, component string").repartition(5)
    assert got(frame, large=large, rounds=rounds) == plain(rows)


def test_nothing_in_nothing_out(spark):
    frame = spark.createDataFrame([], "id int, d string, n string")
    assert got(frame) == []


def test_a_long_chain_takes_few_jobs(spark):
    """Row i shares a key with the next one. Settled link by link this was a round for each accepted row."""
    context = spark.sparkContext
    n, jobs = 10_000, {}
    for size in (n // 100, n):
        rows = [(i, f"d{(i + 1) // 2}", f"n{i // 2}") for i in range(1, size + 1)]
        frame = spark.createDataFrame(rows, "id int, d string, n string")
        context.setJobGroup(f"chain-{size}", "chain")
        assert sorted(r.id for r in relational.greedy_two_keys(frame, "d", "n", "id").collect()) == list(range(1, size + 1, 2))
        jobs[size] = len(context.statusTracker().getJobIdsForGroup(f"chain-{size}"))
    context.setJobGroup("other", "")
    assert jobs[n] < 4 * jobs[n // 100]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (900, 900), (None, 3)] + [(300, k) for k in range(301, 340)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[200] == found[150] == 100 and found[900] == 900
    assert all(found[k] == 300 for k in range(300, 340))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
