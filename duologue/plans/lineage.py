"""Section L, E15, D18, D20, A11 over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import lineage as L
from duologue.operators.rules import node_role
from duologue.plans.frames import LINEAGE, lineage_edges, lineage_nodes, table
from duologue.plans.registry import query

_ROLE = "CASE WHEN iteration < 0 THEN 'seed' WHEN rejected THEN 'failed_int' ELSE 'generated' END"
_DEG = f"""dg AS (SELECT id, {_ROLE} AS role, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM nodes
 LEFT JOIN (SELECT parent AS id, count(*) AS o FROM edges GROUP BY 1) USING (id)
 LEFT JOIN (SELECT child AS id, count(*) AS i FROM edges GROUP BY 1) USING (id))"""
_REACH = """rc AS (SELECT id AS seed, id, 0 AS depth FROM nodes WHERE iteration < 0
 UNION ALL SELECT rc.seed, e.child, depth + 1 FROM rc JOIN edges e ON e.parent = rc.id)"""


@query("d18_known_edges", f"""WITH {LINEAGE} SELECT parent, child FROM edges WHERE parent % 7 <> 3 AND child % 7 <> 3""")
def _(spark, d):
    nodes = lineage_nodes(spark, d).where(F.col("id") % 7 != 3)
    return L.known_edges(lineage_edges(spark, d), nodes)


@query("d18_closest_parent", """WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT vec_id // 2 AS parent, vec_id AS child FROM embeddings WHERE vec_id > 0 UNION ALL SELECT vec_id // 3, vec_id FROM embeddings WHERE vec_id > 2),
j AS (SELECT child, parent, (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) AS d2 FROM e JOIN p ON p.id = parent JOIN p c ON c.id = child),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY d2, parent) AS rn FROM j) SELECT child, parent, d2 FROM r WHERE rn = 1""")
def _(spark, d):
    v = F.col("vec_id")
    t = table(spark, d, "embeddings")
    pts = t.select(v.alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    e = t.where(v > 0).select(F.floor(v / 2).alias("parent"), v.alias("child")).unionByName(
        t.where(v > 2).select(F.floor(v / 3).alias("parent"), v.alias("child")))
    return L.closest_parent(e, pts)


@query("d20_row_audit", f"""WITH {LINEAGE}, u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
al AS (SELECT id FROM nodes WHERE iteration >= 0 AND id NOT IN (SELECT child FROM edges)),
p AS (SELECT q.id, v.id AS other, list_cosine_similarity(q.e, v.e) AS sim FROM u q JOIN al ON al.id = q.id JOIN u v ON v.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS rn FROM p)
SELECT child AS id, parent AS other, 'parent' AS kind FROM edges UNION ALL SELECT id, other, 'nearest' FROM r WHERE rn <= 3""")
def _(spark, d):
    n = lineage_nodes(spark, d)
    return L.audit_rows(n, lineage_edges(spark, d), n.where(F.col("iteration") >= 0))


@query("l01_degree_stats", f"""WITH {LINEAGE}, {_DEG} SELECT count(*) FILTER (role = 'generated' AND in_degree = 0) AS num_orphans,
 avg(out_degree) FILTER (out_degree > 0) AS branching_factor, count(*) FILTER (out_degree = 0) AS leaf_count,
 count(*) FILTER (out_degree > 0) AS backbone_count FROM dg""")
def _(spark, d):
    return L.degree_stats(lineage_nodes(spark, d), lineage_edges(spark, d))


_COMP = """w AS (SELECT id, id AS lab FROM nodes UNION SELECT b.y, w.lab FROM w
 JOIN (SELECT parent AS x, child AS y FROM edges UNION ALL SELECT child, parent FROM edges) b ON b.x = w.id WHERE w.lab <= b.y)"""


@query("l02_components", f"""WITH RECURSIVE {LINEAGE}, {_COMP} SELECT id, min(lab) AS component FROM w GROUP BY 1""")
def _(spark, d):
    return L.components(lineage_nodes(spark, d), lineage_edges(spark, d))


@query("l03_depth", f"""WITH RECURSIVE {LINEAGE}, {_REACH} SELECT id, min(depth) AS depth FROM rc GROUP BY 1""")
def _(spark, d):
    return L.depth_from(lineage_nodes(spark, d).where(F.col("iteration") < 0), lineage_edges(spark, d))


@query("l03_longest_path", f"""WITH RECURSIVE {LINEAGE}, {_REACH} SELECT id, max(depth) AS longest FROM rc GROUP BY 1""")
def _(spark, d):
    return L.longest_from(lineage_nodes(spark, d).where(F.col("iteration") < 0), lineage_edges(spark, d))


@query("l04_fan_out", f"""WITH RECURSIVE {LINEAGE}, {_REACH} SELECT seed, count(DISTINCT rc.id) AS fan_out FROM rc
 JOIN nodes n ON n.id = rc.id WHERE n.iteration >= 0 AND NOT rejected GROUP BY 1""")
def _(spark, d):
    n = lineage_nodes(spark, d)
    return L.fan_out(n.where(F.col("iteration") < 0), n.where(node_role() == "generated"), lineage_edges(spark, d))


@query("e15_lineage_statistics", f"""WITH RECURSIVE {LINEAGE}, {_DEG}, {_COMP}, {_REACH},
u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dp AS (SELECT rc.id, min(depth) AS depth FROM rc JOIN dg ON dg.id = rc.id WHERE role = 'generated' GROUP BY 1),
fo AS (SELECT seed, count(DISTINCT rc.id) AS x FROM rc JOIN dg ON dg.id = rc.id WHERE role = 'generated' GROUP BY 1),
fr AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM fo),
ns AS (SELECT g.id, max(list_cosine_similarity(a.e, b.e)) AS sim FROM dg g JOIN u a ON a.id = g.id JOIN dg s ON s.role = 'seed' JOIN u b ON b.id = s.id
 WHERE g.role = 'generated' GROUP BY 1),
pd AS (SELECT child, min(1 - list_cosine_similarity(a.e, b.e)) AS dist FROM edges JOIN u a ON a.id = child JOIN u b ON b.id = parent
 JOIN dg ON dg.id = child WHERE role = 'generated' GROUP BY 1)
SELECT (SELECT count(*) FROM dg) AS num_nodes, (SELECT count(*) FROM edges) AS num_edges,
 (SELECT count(*) FROM dg WHERE role = 'seed') AS num_seeds, (SELECT count(*) FROM dg WHERE role = 'generated') AS num_generated,
 (SELECT count(*) FROM dg WHERE role = 'failed_int') AS num_failed_moi,
 (SELECT count(DISTINCT lab) FROM (SELECT id, min(lab) AS lab FROM w GROUP BY 1)) AS weakly_connected_components,
 (SELECT count(*) FROM dg WHERE role = 'generated' AND in_degree = 0) AS num_orphans,
 (SELECT round(avg(out_degree), 3) FROM dg WHERE out_degree > 0) AS branching_factor,
 (SELECT count(*) FROM dg WHERE out_degree = 0) AS leaf_count, (SELECT count(*) FROM dg WHERE out_degree > 0) AS backbone_count,
 (SELECT max(depth) FROM dp) AS max_chain_depth, (SELECT median(depth) FROM dp) AS median_chain_depth,
 (SELECT max(x) FROM fo) AS top_seed_fanout,
 (SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 3) FROM fr) AS fanout_gini,
 (SELECT round(avg(1 - sim), 4) FROM ns) AS mean_dist_to_nearest_seed, (SELECT round(avg(dist), 4) FROM pd) AS mean_dist_to_parent""")
def _(spark, d):
    return L.lineage_statistics(lineage_nodes(spark, d), lineage_edges(spark, d))
