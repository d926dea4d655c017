"""Section F over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import rules, windows as W
from duologue.operators.joins import first_per_key, last_per_key
from duologue.plans.frames import ATTEMPTS, ITERATIONS, LINEAGE, attempts, iterations, lineage_edges, lineage_nodes, table
from duologue.plans.registry import query


@query("f01_sliding_frontier_share", f"""WITH {ITERATIONS}, s AS (SELECT row_number() OVER (ORDER BY iteration) AS i,
 CASE WHEN classification = 'frontier' THEN 1 ELSE 0 END AS y FROM it),
w AS (SELECT i, sum(y) OVER x AS k, CAST(count(*) OVER x AS DOUBLE) AS n FROM s WINDOW x AS (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
p AS (SELECT i, n, k / n AS p, 1 + 3.8416 / n AS dd FROM w)
SELECT i, p AS mean, greatest(0, (p + 3.8416 / (2 * n)) / dd - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / dd) AS lo,
 least(1, (p + 3.8416 / (2 * n)) / dd + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / dd) AS hi FROM p""")
def _(spark, d):
    return W.sliding_share(iterations(spark, d), "iteration", F.col("classification") == "frontier")


@query("f02_learning_slope", f"""WITH {ATTEMPTS}, w AS (SELECT event_id, list(goal) OVER (PARTITION BY task ORDER BY ts, event_id
 ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x FROM a)
SELECT event_id, CASE WHEN len(x) < 4 THEN 0 ELSE list_avg(x[len(x) // 2 + 1:]) - list_avg(x[:len(x) // 2]) END AS slope FROM w""")
def _(spark, d):
    return W.learning_slope(attempts(spark, d), "task", [F.col("ts_us"), F.col("event_id")], F.col("ts_us"),
                            F.col("goal")).select("event_id", "slope")


@query("f03_recency_weight", """WITH n AS (SELECT max(event_id) AS t FROM events),
l AS (SELECT user_id * 3 AS vec_id, max(event_id) AS last FROM events GROUP BY 1)
SELECT e.vec_id, CASE WHEN last IS NOT NULL THEN t - last ELSE 1 + t - e.vec_id END AS weight
FROM embeddings e CROSS JOIN n LEFT JOIN l USING (vec_id)""")
def _(spark, d):
    ev = table(spark, d, "events")
    now = ev.agg(F.max("event_id").alias("t"))  # one row
    rows = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("added")).crossJoin(F.broadcast(now))
    choices = ev.select((F.col("user_id") * 3).alias("vec_id"), F.col("event_id").alias("step"))
    return W.recency_weight(rows, choices, "vec_id", F.col("t"))


@query("f04_running_counters", f"""WITH {ITERATIONS} SELECT iteration, sum(CAST(generated AS INT)) OVER w AS generated_count,
 sum(CASE WHEN generated AND goal >= 7 THEN 1 ELSE 0 END) OVER w AS solved_count, count(*) OVER w AS archive_size
FROM it WINDOW w AS (ORDER BY iteration ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return W.running_counters(iterations(spark, d), "iteration", {
        "generated_count": F.col("generated").cast("int"),
        "solved_count": (F.col("generated") & (F.col("goal") >= 7)).cast("int"), "archive_size": F.lit(1)}).select(
        "iteration", "generated_count", "solved_count", "archive_size")


@query("f05_half_means", f"""WITH {ITERATIONS}, s AS (SELECT row_number() OVER (ORDER BY iteration) AS i, count(*) OVER () AS n, goal FROM it)
SELECT avg(goal) FILTER (i <= n // 2) AS first_half, avg(goal) FILTER (i > n // 2) AS second_half FROM s""")
def _(spark, d):
    return W.half_means(iterations(spark, d), "iteration", F.col("goal"))


@query("f06_child_priors", f"""WITH RECURSIVE {LINEAGE},
k AS (SELECT child AS id, parent, child % 3 AS alpha, child % 5 AS beta FROM edges),
c AS (SELECT id, parent, coalesce(sum(alpha) OVER w, 0) AS a0, coalesce(sum(beta) OVER w, 0) AS b0 FROM k
 WINDOW w AS (PARTITION BY parent ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT id, 1.0::DOUBLE AS pa, 1.0::DOUBLE AS pb, true AS is_root FROM nodes WHERE iteration < 0
 UNION ALL SELECT c.id, (pa + a0) * least(1, 4.0 / (pa + a0 + pb + b0)), (pb + b0) * least(1, 4.0 / (pa + a0 + pb + b0)), false
 FROM c JOIN r ON r.id = c.parent)
SELECT id, pa AS prior_alpha, pb AS prior_beta FROM r WHERE NOT is_root""")
def _(spark, d):
    c = F.col("child")
    kids = lineage_edges(spark, d).select(c.alias("id"), "parent", c.alias("iteration"), (c % 3).alias("alpha"), (c % 5).alias("beta"))
    roots = lineage_nodes(spark, d).where(F.col("iteration") < 0).select(
        "id", F.lit(1.0).alias("prior_alpha"), F.lit(1.0).alias("prior_beta"))
    return W.child_priors(kids, roots)


@query("f07_keep_first_last", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
 arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    f = first_per_key(o, ["o_custkey"], order, ["o_orderkey"]).withColumnRenamed("o_orderkey", "first_order")
    return f.join(last_per_key(o, ["o_custkey"], order, ["o_orderkey"]).withColumnRenamed("o_orderkey", "last_order"), "o_custkey")
