"""Section J, E22 and E23 over the driver tables. The md5 order is the same in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import permutation as P, sampling as J, summaries as S
from duologue.plans.frames import ITERATIONS, iterations, table
from duologue.plans.registry import query
from duologue.plans.summaries import children


@query("j01_exact_sample", "SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 25")
def _(spark, d):
    return J.exact_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 25, 42)


@query("j01_first_n", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def _(spark, d):
    return J.exact_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 25, None)


@query("j02_folds", "SELECT c_custkey, (row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) - 1) % 5 AS fold FROM customer")
def _(spark, d):
    return J.folds(table(spark, d, "customer").select("c_custkey"), "c_custkey", 5, 7)


@query("j03_chunks", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) AS rn, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(floor((rn - 1) / ceil(n / ceil(n / 8))) AS BIGINT) AS chunk FROM r""")
def _(spark, d):
    return J.chunks(table(spark, d, "customer").select("c_custkey"), "c_custkey", 8, 7)


@query("j04_weighted_sample", """SELECT c_custkey FROM customer WHERE c_acctbal > 0
ORDER BY -ln((('0x' || substr(md5('3:' || c_custkey), 1, 8))::BIGINT + 0.5) / 4294967296.0) / c_acctbal, c_custkey LIMIT 25""")
def _(spark, d):
    return J.weighted_sample(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal"), 25, 3).select("c_custkey")


@query("j05_farthest_points")
def _(spark, d):
    return J.farthest_points(table(spark, d, "embeddings"), "vec_id", "embedding", 5, 0)


@query("j06_thompson")
def _(spark, d):
    arms = S.posterior(children(spark, d))
    return J.thompson(arms, "anchor", 1 + F.col("alpha_votes"), 1 + F.col("beta_votes"), 16, 11)


@query("j06_uniform_choice", """SELECT round, arg_min(user_id, (md5('5:' || round || ':' || user_id), user_id)) AS user_id
FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 16)) AS round) GROUP BY 1""")
def _(spark, d):
    return J.uniform_choice(table(spark, d, "events").select("user_id").distinct(), "user_id", 16, 5)


@query("e22_trend_statistic", f"""WITH {ITERATIONS}, s AS (SELECT row_number() OVER (ORDER BY iteration) AS i,
 CASE WHEN classification = 'frontier' THEN 1 ELSE 0 END AS y FROM it) SELECT count(*) AS n, corr(i, y) AS r FROM s""")
def _(spark, d):
    return P.trend_statistic(iterations(spark, d), F.col("classification") == "frontier", "iteration")


@query("e22_trend_permutation")
def _(spark, d):
    return P.trend(iterations(spark, d), F.col("classification") == "frontier", "iteration")


@query("e23_mean_difference")
def _(spark, d):
    it = iterations(spark, d)
    return P.mean_difference(it, F.col("goal"), F.col("generated"), F.col("iteration"))
