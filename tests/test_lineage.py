"""Graph steps on shapes the driver tables do not have: hubs, long chains, many parents, a cycle."""

import random

from pyspark.sql import functions as F

from duologue.operators import lineage as L
from duologue.operators.summaries import gini
from duologue.operators.windows import child_priors


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(i, -1 if i == 0 else i, False) for i in range(n)], "id bigint, iteration bigint, rejected boolean")
    return nodes, spark.createDataFrame(edges, "parent bigint, child bigint")


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 120)]
    hub = [(250, i) for i in range(200, 250)]
    extra = [(rng.randrange(0, 90), rng.randrange(0, 90)) for _ in range(40)]
    n, e = graph(spark, 300, chain + hub + extra)
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in chain + hub + extra:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    want = {i: find(i) for i in range(300)}
    assert {r["id"]: r["component"] for r in L.components(n, e).collect()} == want


def test_depths_and_reach(spark):
    n, e = graph(spark, 8, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 1), (5, 6)])
    seeds = n.where("iteration < 0")
    assert {r["id"]: r["depth"] for r in L.depth_from(seeds, e).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    acyclic = e.where("not (parent = 3 and child = 1)")
    assert {r["id"]: r["longest"] for r in L.longest_from(seeds, acyclic).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    fans = L.fan_out(n.where("id in (0, 7)"), n.where("id between 1 and 6"), acyclic, include_zero=True)
    assert {r["seed"]: r["fan_out"] for r in fans.collect()} == {0: 3, 7: 0}


def test_gini(spark):
    def g(values):
        return gini(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").head()[0]

    assert g([1, 1, 1]) == 0.0
    assert abs(g([0, 0, 3]) - 2 / 3) < 1e-12
    assert g([0, 0]) == 0.0


def test_prior_mass_is_capped(spark):
    kids = spark.createDataFrame([(1, 0, 1, 5, 1), (2, 0, 2, 0, 0), (3, 1, 3, 0, 0)], "id bigint, parent bigint, iteration bigint, alpha bigint, beta bigint")
    roots = spark.createDataFrame([(0, 1.0, 1.0)], "id bigint, prior_alpha double, prior_beta double")
    got = {r["id"]: (r["prior_alpha"], r["prior_beta"]) for r in child_priors(kids, roots).collect()}
    assert got == {1: (1.0, 1.0), 2: (3.0, 1.0), 3: (1.0, 1.0)}


def test_closest_parent_and_known_edges(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.9, 0.0)], "id bigint, x double, y double")
    e = spark.createDataFrame([(1, 3), (2, 3), (9, 3)], "parent bigint, child bigint")
    assert [(r["child"], r["parent"]) for r in L.closest_parent(e, pts).collect()] == [(3, 2)]
    emb = pts.withColumn("embedding", F.array("x", "y"))
    assert L.known_edges(e, pts.select("id")).count() == 2
    assert L.audit_rows(emb, e.where("parent < 9"), emb.where("id = 3")).count() == 2
    assert L.audit_rows(emb, e.where("parent < 9"), emb.where("id = 1"), 2).count() == 2


def test_long_chain_in_few_rounds(spark):
    n, e = graph(spark, 2003, [(i, i + 1) for i in range(1999)] + [(2001, 2002), (2002, 2001)])  # and a cycle that no seed reaches
    rounds = []
    g = L.Junctions(n.where("id = 0"), e, rounds)
    assert len(rounds) <= 13 and g.links.count() == 0
    assert {r["id"]: r["depth"] for r in L.depth_from(None, None, g).collect()} == {i: i for i in range(2000)}
    assert [tuple(r) for r in L.fan_out(n.where("id = 0"), n.where("id % 2 = 1"), e, graph=g).collect()] == [(0, 1000)]


def test_random_lineages(spark):
    for seed in range(1):
        rng = random.Random(seed)
        size = 60
        edges = [(rng.randrange(max(0, c - 30), c), c) for c in range(6, size) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] + [(None, 9), (50, 50)]
        n, e = graph(spark, size, edges)
        e = e.unionByName(e.limit(5))
        seeds = [0, 1, 2, 3, 4, 5, 40]
        s = n.where(F.col("id").isin(seeds))
        down = {}
        for a, b in edges:
            if a is not None and a != b:
                down.setdefault(a, set()).add(b)
        depth, front = {x: 0 for x in seeds}, list(seeds)
        for x in front:
            for y in sorted(down.get(x, ())):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    front.append(y)
        most = {x: 0 for x in seeds}
        for _ in range(size):
            for x in list(most):
                for y in down.get(x, ()):
                    most[y] = max(most.get(y, 0), most[x] + 1)
        reach = set()
        for x in seeds:
            seen, todo = {x}, [x]
            while todo:
                for y in down.get(todo.pop(), ()):
                    if y not in seen and y not in seeds:
                        seen.add(y)
                        todo.append(y)
            reach |= {(x, y) for y in seen}
        g = L.Junctions(s, e)
        assert {r["id"]: r["depth"] for r in L.depth_from(s, e, g).collect()} == depth
        assert {r["id"]: r["longest"] for r in L.longest_from(s, e, g).collect()} == most
        assert {(r["seed"], r["id"]) for r in L.seed_reach(s, e, g).collect()} == reach
        fans = {r["seed"]: r["fan_out"] for r in L.fan_out(s, n.where("id > 5"), e, include_zero=True, graph=g).collect()}
        assert fans == {x: sum(1 for a, y in reach if a == x and y > 5) for x in seeds}


def test_cycle_below_a_seed_is_an_error(spark):
    n, e = graph(spark, 6, [(0, 1), (1, 2), (2, 3), (3, 1)])
    import pytest

    with pytest.raises(ValueError):
        L.longest_from(n.where("id = 0"), e).collect()
    assert {r["id"]: r["depth"] for r in L.depth_from(n.where("id = 0"), e).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
