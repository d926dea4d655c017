"""Lineage graphs as node and edge tables.

Iterative steps keep their state in written tables, so a lost executor costs one step at most. One parent may own a third of all
edges: joins with attributes are salted, and in steps only the side of the edges is large, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.operators.graph import components
from duologue.operators.nearest import Rule, best_match, top_k, vectors
from duologue.operators.rules import node_role
from duologue.operators.scale import salted_join
from duologue.operators.summaries import gini
from duologue.session import Steps, cut


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends exist."""
    e = edges.select("parent", "child").distinct()
    for end in ("parent", "child"):
        e = salted_join(e, nodes.select(F.col("id").alias(end)), [end], "left_semi",
                        ["child" if end == "parent" else "parent"])
    return e


def closest_parent(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Parent closest in the plane; unplaced nodes drop out."""
    p = points.select(F.col("id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    c = points.select(F.col("id").alias("child"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    j = salted_join(edges, p, ["parent"], "inner", ["child"]).join(c, "child")
    dx, dy = F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    j = j.withColumn("d2", dx * dx + dy * dy)
    return j.groupBy("child").agg(F.min_by(F.struct("parent", "d2"), F.struct("d2", "parent")).alias("b")).select("child", "b.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L1: in- and out-degree of every node."""
    o = edges.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    i = edges.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(o, "id", "left").join(i, "id", "left").fillna(0, ["out_degree", "in_degree"])


def degree_stats(nodes: DataFrame, edges: DataFrame, role: Column | None = None) -> DataFrame:
    d = degrees(nodes.withColumn("role", node_role() if role is None else role), edges)
    out = F.col("out_degree")
    return d.agg(
        F.count_if((F.col("role") == "generated") & (F.col("in_degree") == 0)).alias("num_orphans"),
        F.coalesce(F.avg(F.when(out > 0, out)), F.lit(0.0)).alias("branching_factor"),
        F.count_if(out == 0).alias("leaf_count"), F.count_if(out > 0).alias("backbone_count"))


class Junctions:
    """A graph with its unbranched descent folded away: ``hang`` (id, anchor, dist) and ``links`` (source, target, least, most).

    A node with one parent hangs on it; where that hangs in turn, distances add up, and each round doubles the steps taken, so a chain of n nodes
    takes log2(n) rounds. Seeds, nodes with several parents and nodes without one are anchors. Links are the ways between anchors, with the
    least and the largest number of steps. Nodes that hang in a cycle have no anchor, and nothing that starts at a seed reaches them.
    """

    def __init__(self, seeds: DataFrame, edges: DataFrame, rounds: list[int] | None = None):
        e = edges.select("parent", "child").where("parent is not null and child is not null and parent <> child").distinct()
        self.seeds = seeds.select("id").distinct()
        heads = e.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
        single = heads.where("n = 1").join(self.seeds, "id", "left_anti")
        steps = Steps(e.sparkSession, "junctions")
        now = steps.write(single.select("id", "up", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")))
        most = now.count().bit_length() + 1  # rounds after which only cycles are left
        for _ in range(most):
            if now.where("not done").isEmpty():
                break
            if rounds is not None:
                rounds.append(1)
            above = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
            moved = now.where("not done").join(above, "up", "left").select(
                "id", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
                F.coalesce("done2", F.lit(True)).alias("done"))
            now = steps.write(now.where("done").unionByName(moved))
        hung = now.where("done").select("id", F.col("up").alias("anchor"), "dist")
        own = self.seeds.unionByName(heads.where("n > 1").select("id")).unionByName(hung.select(F.col("anchor").alias("id"))).unionByName(
            e.select(F.col("parent").alias("id")).join(heads.select("id"), "id", "left_anti")).distinct()
        self.hang = cut(hung.unionByName(own.select("id", F.col("id").alias("anchor"), F.lit(0).cast("long").alias("dist"))))
        into = e.join(now.select(F.col("id").alias("child")), "child", "left_anti")  # edges whose child is an anchor
        self.links = cut(into.join(self.hang.withColumnRenamed("id", "parent"), "parent").groupBy(
            F.col("anchor").alias("source"), F.col("child").alias("target")).agg(
            (F.min("dist") + 1).alias("least"), (F.max("dist") + 1).alias("most")))

    def spread(self, longest: bool = False) -> DataFrame:
        """(id, steps): the fewest steps from a seed to each anchor that seeds reach, or the most."""
        steps = Steps(self.links.sparkSession, "spread")
        best, weight = (F.max, "most") if longest else (F.min, "least")
        state = steps.write(self.seeds.select("id", F.lit(0).cast("long").alias("steps"), F.lit(True).alias("fresh")))
        bound = self.hang.count() if longest else None
        while not state.where("fresh").isEmpty():
            if bound is not None and state.agg(F.max("steps")).head()[0] > bound:  # a path without repeated nodes is shorter
                raise ValueError("the lineage has a cycle")
            step = self.links.join(state.where("fresh").select(F.col("id").alias("source"), "steps"), "source")
            new = step.groupBy(F.col("target").alias("id")).agg(best(F.col("steps") + F.col(weight)).alias("new"))
            both = state.select("id", "steps").join(new, "id", "full")
            better = F.col("steps").isNull() | (F.col("new") > F.col("steps") if longest else F.col("new") < F.col("steps"))
            better = F.coalesce(F.col("new").isNotNull() & better, F.lit(False))
            state = steps.write(both.select("id", F.when(better, F.col("new")).otherwise(F.col("steps")).alias("steps"), better.alias("fresh")))
        return state.select("id", "steps")

    def from_seeds(self, longest: bool = False) -> DataFrame:
        """(id, steps) of every node that seeds reach."""
        at = self.spread(longest).withColumnRenamed("id", "anchor")
        return self.hang.join(at, "anchor").select("id", (F.col("steps") + F.col("dist")).alias("steps"))

    def reach(self) -> DataFrame:
        """(seed, anchor) for every anchor reached from a seed; a seed counts as its own ancestor only."""
        links = self.links.join(self.seeds.select(F.col("id").alias("target")), "target", "left_anti")
        level = cut(self.seeds.select(F.col("id").alias("seed"), F.col("id").alias("anchor")))
        done = level
        while True:
            nxt = links.join(level.withColumnRenamed("anchor", "source"), "source").select("seed", F.col("target").alias("anchor"))
            level = cut(nxt.distinct().join(done, ["seed", "anchor"], "left_anti"))
            if level.isEmpty():
                return done
            done = cut(done.unionByName(level))


def depth_from(seeds: DataFrame, edges: DataFrame, graph: Junctions | None = None) -> DataFrame:
    """L3: number of steps from the nearest seed; unreachable nodes have no row."""
    return (graph or Junctions(seeds, edges)).from_seeds().select("id", F.col("steps").cast("int").alias("depth"))


def longest_from(seeds: DataFrame, edges: DataFrame, graph: Junctions | None = None) -> DataFrame:
    """Longest path from a seed. A cycle that seeds reach is an error."""
    return (graph or Junctions(seeds, edges)).from_seeds(longest=True).select("id", F.col("steps").cast("int").alias("longest"))


def seed_reach(seeds: DataFrame, edges: DataFrame, graph: Junctions | None = None) -> DataFrame:
    """L4: (seed, id) for every node reached from a seed; a seed counts as its own ancestor only."""
    graph = graph or Junctions(seeds, edges)
    return graph.reach().join(graph.hang.select("id", "anchor"), "anchor").select("seed", "id")


def fan_out(seeds: DataFrame, generated: DataFrame, edges: DataFrame, include_zero: bool = False, graph: Junctions | None = None) -> DataFrame:
    """L4: generated descendants of each seed; seeds without any are left out unless asked for.

    Nodes are counted by anchor first, so pairs of a seed and a node are made for anchors only.
    """
    graph = graph or Junctions(seeds, edges)
    below = graph.hang.join(generated.select("id"), "id", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    n = graph.reach().join(below, "anchor").groupBy("seed").agg(F.sum("n").alias("fan_out"))
    if not include_zero:
        return n
    return seeds.select(F.col("id").alias("seed")).join(n, "seed", "left").fillna(0, ["fan_out"])


def parent_distance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cosine distance of each child to its closest parent."""
    from duologue.functions.vectors import cosine

    e = nodes.where(F.col("embedding").isNotNull())
    j = salted_join(edges, e.select(F.col("id").alias("parent"), F.col("embedding").alias("pe")), ["parent"], "inner", ["child"])
    j = j.join(e.select(F.col("id").alias("child"), F.col("embedding").alias("ce")), "child")
    return j.groupBy(F.col("child").alias("id")).agg(F.min(1 - cosine(F.col("pe"), F.col("ce"))).alias("distance"))


def lineage_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The sixteen numbers that describe a lineage graph, as one row.

    nodes(id, iteration, rejected, embedding), edges(parent, child) between known nodes.
    """
    n = nodes.withColumn("role", node_role())
    seeds, gen = n.where(F.col("role") == "seed"), n.where(F.col("role") == "generated")
    edges = cut(known_edges(edges, n))

    def rnd(c: Column, places: int) -> Column:
        return F.round(F.coalesce(c, F.lit(0.0)), places)

    base = n.agg(F.count(F.lit(1)).alias("num_nodes"), F.count_if(F.col("role") == "seed").alias("num_seeds"),
                 F.count_if(F.col("role") == "generated").alias("num_generated"),
                 F.count_if(F.col("role") == "failed_int").alias("num_failed_moi"))
    ne = edges.agg(F.count(F.lit(1)).alias("num_edges"))
    comp = components(n, edges).agg(F.count_distinct("component").alias("weakly_connected_components"))
    deg = degree_stats(n, edges, F.col("role")).withColumn("branching_factor", F.round("branching_factor", 3))
    graph = Junctions(seeds, edges)
    depth = depth_from(seeds, edges, graph).join(gen.select("id"), "id", "left_semi").agg(
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_chain_depth"),
        F.coalesce(F.median("depth"), F.lit(0.0)).alias("median_chain_depth"))
    fans = cut(fan_out(seeds, gen, edges, graph=graph))
    top = fans.agg(F.coalesce(F.max("fan_out"), F.lit(0)).alias("top_seed_fanout"))
    g = gini(fans, "fan_out").select(F.round("gini", 3).alias("fanout_gini"))
    near = best_match(vectors(gen, "id", "embedding"), vectors(seeds, "id", "embedding")).agg(
        rnd(F.avg(1 - F.col("sim")), 4).alias("mean_dist_to_nearest_seed"))
    par = parent_distance(n, edges).join(gen.select("id"), "id", "left_semi").agg(
        rnd(F.avg("distance"), 4).alias("mean_dist_to_parent"))
    out = base
    for one in (ne, comp, deg, depth, top, g, near, par):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out


def audit_rows(nodes: DataFrame, edges: DataFrame, children: DataFrame, k: int = 3) -> DataFrame:
    """Each child next to its parents, else next to its k nearest rows."""
    own = edges.join(children.select(F.col("id").alias("child")), "child", "left_semi").select(
        F.col("child").alias("id"), F.col("parent").alias("other"), F.lit("parent").alias("kind"))
    alone = children.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
    v = vectors(nodes, "id", "embedding")
    near = top_k(vectors(alone, "id", "embedding"), v, k, Rule(not_self=True)).select(
        "id", F.col("nid").alias("other"), F.lit("nearest").alias("kind"))
    return own.unionByName(near)
