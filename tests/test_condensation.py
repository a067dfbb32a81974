"""Components, the graph between them, and callers counted over it, against brute force."""

import random

import pytest

from fathom.operators import condensation as D


def brute(edges):
    nodes = {x for e in edges for x in e}
    down = {n: [b for a, b in edges if a == n] for n in nodes}
    reach = {}
    for n in nodes:
        seen, left = set(), list(down[n])
        while left:
            if (x := left.pop()) not in seen:
                seen.add(x)
                left += down[x]
        reach[n] = seen
    component = {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in nodes}
    return component, {n: sum(n in reach[m] for m in nodes) for n in nodes}, {n for n in nodes if n in reach[n]}


def graph(seed):
    """Random cores with chains between, behind and around them, rings apart, self-loops and repeated edges."""
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range((25, 45, 70)[seed % 3])]
    edges += [(100 + i, 101 + i) for i in range(20)] + [(3, 100), (115, 200), (200, 201), (201, 3), (5, 5), (120, 120)]
    edges += [(300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(400, 401), (401, 400), (401, 400), (7, 500), (500, 7), (7, 501), (501, 7)]
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    edges = graph(seed)
    component, callers, cyclic = brute(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    comps = D.strong_components(df)
    assert {r.fn: r.component for r in comps.collect()} == component
    assert {r.fn for r in D.cyclic_nodes(df).collect()} == cyclic
    assert {tuple(r) for r in D.condensed(df, comps).collect()} == {(component[a], component[b]) for a, b in edges if component[a] != component[b]}
    if seed == 1:
        assert {r.fn: (r.blast, r.approximate) for r in D.blast(df).collect()} == {n: (c, False) for n, c in callers.items()}
        return
    few = {r.fn: (r.blast, r.approximate) for r in D.blast(df, 1).collect()}
    assert any(a for _, a in few.values()) and all(abs(b - callers[n]) <= (0.07 * callers[n] + 1) * a for n, (b, a) in few.items())


def test_names_and_nulls(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", None), (None, "c"), ("c", "b"), ("d", "d")], "src string, dst string")
    assert {r.fn: r.component for r in D.strong_components(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert {r.fn: r.blast for r in D.blast(df).collect()} == {"a": 3, "b": 3, "c": 0, "d": 1}


@pytest.mark.parametrize("closed", [True, False])
def test_long_rings_and_chains(spark, closed):
    n = 30_000
    df = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    df = df if closed else df.filter("dst <> 0")
    out = D.blast(df)
    if closed:
        assert D.strong_components(df).selectExpr("count(*) AS n", "max(component) AS m").first()[:] == (n, 0)
        assert out.selectExpr("min(blast) AS a", "max(blast) AS b", "count(*) AS n").first()[:] == (n, n, n)
    else:
        assert out.filter("blast <> fn OR approximate").isEmpty() and out.count() == n


def test_sketches_of_a_wide_graph(spark):
    """Hubs with more callers than the bound: within four standard errors."""
    df = spark.range(30_000).selectExpr("id + 10 AS src", "id % 3 AS dst").unionByName(spark.createDataFrame([(0, 3), (1, 3), (3, 4), (2, 4), (5, 6)], "src long, dst long"))
    got = {r.fn: (r.blast, r.approximate) for r in D.blast(df, 1_000).filter("fn < 10").collect()}
    want = {0: 10_000, 1: 10_000, 2: 10_000, 3: 20_002, 4: 30_004}
    assert {n for n, (_, a) in got.items() if a} == set(want) and got[6] == (1, False) and got[5] == (0, False)
    assert all(abs(got[n][0] - w) < 4 * 1.04 / 64 * w for n, w in want.items())


def test_counts_beyond_the_bound_are_exact(spark, monkeypatch):
    """Without a bound of its own, what is too much to spell out is counted by bitmaps."""
    monkeypatch.setattr(D, "BOUND", 1)
    edges = graph(2)
    _, callers, _ = brute(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.fn: (r.blast, r.approximate) for r in D.blast(df).collect()} == {n: (c, False) for n, c in callers.items()}
