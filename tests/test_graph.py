"""Connected components on chains, hubs that fill ranges, random graphs and odd edges."""

import random

import pytest

from duologue.operators import graph as G


def slow(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def run(spark, n, edges, parts=5, rounds=None, at_once=150):
    nodes = spark.range(n).select("id")
    e = spark.createDataFrame(edges, "parent long, child long").repartition(parts)
    rows = G.components(nodes, e, rounds, at_once).collect()  # few edges at once, so that stars have work to do
    assert len(rows) == n
    return {r.id: r.component for r in rows}


def shuffled(edges, seed):
    rng = random.Random(seed)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    rng.shuffle(edges)
    return edges


def relabelled(n, edges, seed):
    new = list(range(n))
    random.Random(seed).shuffle(new)
    return [(new[a], new[b]) for a, b in edges]


def test_long_chain_in_few_rounds(spark):
    edges = shuffled(relabelled(3000, [(i, i + 1) for i in range(2999)], 1), 2)
    rounds = []
    assert set(run(spark, 3000, edges, rounds=rounds, at_once=1500).values()) == {0}
    assert len(rounds) <= 10 and rounds[-1] <= 2999  # a round more only finds that nothing is left to do


def test_star_is_contracted_before_it_travels(spark):
    edges = shuffled([(4000, i) for i in range(4000)] * 3, 3)  # of 12,000 edges with 3 copies
    e = spark.createDataFrame(edges, "u long, v long").repartition(4)
    assert G.contracted(e).count() <= 4 * 4000  # a forest in each partition
    rounds = []
    assert set(run(spark, 4001, edges, rounds=rounds, at_once=2000).values()) == {0}
    assert len(rounds) <= 4


def test_one_partition_is_one_forest(spark):
    edges = shuffled([(i, j) for i in range(60) for j in range(i)], 4)
    assert G.contracted(spark.createDataFrame(edges, "u long, v long").coalesce(1)).count() == 59


def test_forests_leave_in_parts(spark):
    edges = shuffled(relabelled(500, [(i, i + 1) for i in range(499)], 5), 6)
    e = spark.createDataFrame(edges, "u long, v long").coalesce(1)
    got = [tuple(r) for r in G.contracted(e, at_once=20).collect()]
    assert slow(500, got) == slow(500, edges) and len(got) <= 499


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 400
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([100, 250, 600]))]
    hubs = [(rng.randrange(n), h) for h in rng.sample(range(n), 3) for _ in range(rng.choice([0, 150]))]
    odd = [(None, 3), (4, None), (None, None), (9, 9), *edges[:20]]
    e, parts = edges + hubs + odd, rng.choice([1, 3, 7])
    want = slow(n, edges + hubs)
    assert run(spark, n, e, parts) == want
    assert run(spark, n, e, parts, at_once=1000) == want  # one task holds the forest


def test_hub_with_its_smaller_neighbours_in_one_range_and_larger_in_others(spark):
    edges = [(2000, 5)] + [(2000, i) for i in range(2001, 8000)] + [(5, 1), (7999, 9000), (9000, 9001)]
    got = run(spark, 9002, shuffled(edges, 7), at_once=3000)
    assert got == slow(9002, edges)


def test_nothing(spark):
    assert run(spark, 3, [(1, 1)]) == {0: 0, 1: 1, 2: 2}
    assert G.components(spark.range(0).select("id"), spark.createDataFrame([], "parent long, child long")).count() == 0
