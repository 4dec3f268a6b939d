"""The loops against plain Python on random graphs."""

import random

import pytest

from veridag.plans.fixpoint import bfs, closure, cycles, longest, radius, reach, strong_components


def reachable(seeds, edges):
    known, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in known:
                known.add(b)
                todo.append(b)
    return known


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(16)) if a < b})
    return edges, spark.createDataFrame(edges, "src string, dst string")


def test_reach_and_bfs(spark, graph):
    edges, df = graph
    seeds = spark.createDataFrame([("n0",), ("n3",)], "node string")
    assert {r[0] for r in reach(seeds, df).collect()} == reachable({"n0", "n3"}, edges)
    for node, d in bfs(seeds, df).collect():
        level = {"n0", "n3"}
        for _ in range(d):
            assert node not in level
            level |= {b for a, b in edges if a in level}
        assert node in level


def test_closure_counts_the_start_on_a_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = {tuple(r) for r in closure(spark.createDataFrame([("a",), ("c",)], "node string"), df).collect()}
    assert got == {("a", "b"), ("a", "a"), ("a", "c")}


def test_longest_and_its_cycle(spark, graph):
    edges, df = graph
    nodes = sorted({x for e in edges for x in e})
    frame = spark.createDataFrame([(n,) for n in nodes], "node string")
    memo = {}

    def level(n):
        return memo.setdefault(n, max([0, *(1 + level(a) for a, b in edges if b == n)]))

    assert {r[0]: r[1] for r in longest(frame, df).collect()} == {n: level(n) for n in nodes}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(RuntimeError):
        longest(spark.createDataFrame([("a",), ("b",)], "node string"), loop, rounds=5)


def components(edges):
    nodes = {x for e in edges for x in e}
    onward = {n: reachable({b for a, b in edges if a == n}, edges) for n in nodes}
    return onward, {n: min(m for m in nodes if m in onward[n] and n in onward[m]) for n in nodes if n in onward[n]}


def shortest(root, edges):
    paths = [[root]]
    while paths:
        paths = [[*p, b] for p in paths for a, b in edges if a == p[-1] and (b == root or b not in p)]
        if done := [p for p in paths if p[-1] == root]:
            return " -> ".join(min(done))


@pytest.mark.parametrize("seed", [1, 3])
def test_components_cycles_and_radius(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range((12, 18, 26, 40)[seed])})
    df = spark.createDataFrame(edges, "src string, dst string")
    onward, root = components(edges)
    assert {r["node"]: r["root"] for r in strong_components(df).collect()} == root
    want = {(r, list(root.values()).count(r), shortest(r, edges)) for r in set(root.values())}
    assert {tuple(r) for r in cycles(df).collect()} == want
    got = {r["node"]: r["radius"] for r in radius(spark.createDataFrame([(n,) for n in onward], "node string"), df).collect()}
    assert got == {n: len(x) for n, x in onward.items() if x}


def test_a_large_component_costs_no_pairs(spark, monkeypatch):
    """A ring of 12 with a tail of 3: its own 12 x 12 pairs are never made."""
    from veridag.plans import fixpoint

    ring = [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [("r7", "t0"), ("t0", "t1"), ("t1", "t2")]
    made = []
    monkeypatch.setattr(fixpoint, "closure", lambda *a: made.append(closure(*a)) or made[-1])
    nodes = spark.createDataFrame([(f"r{i}",) for i in range(12)] + [("t1",)], "node string")
    got = {r["node"]: r["radius"] for r in radius(nodes, spark.createDataFrame(ring, "src string, dst string")).collect()}
    assert got == {f"r{i}": 15 for i in range(12)} | {"t1": 1}
    assert made[0].count() == 4


def test_rounds_leave_edges_where_they_are(spark):
    """A join with bucketed edges shuffles the frontier alone."""
    from veridag.plans.staging import bucketed, dropped, staged

    edges = bucketed(spark.range(5000).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst"), "src")
    front = staged(spark.range(900).selectExpr("cast(id as string) as node"))
    plan = front.hint("shuffle_merge").join(edges, front["node"] == edges["src"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(node") == 1 == plan.count("Exchange hashpartitioning")
    assert front.join(edges, front["node"] == edges["src"]).count() == 900
    dropped(edges, front)
    assert not spark.catalog.tableExists(edges._table)


def test_no_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert strong_components(df).count() == 0 and cycles(df).count() == 0 and cycles(df.limit(0)).count() == 0
