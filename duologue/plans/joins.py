"""Equi-join parts of section D and A12, A16, A17 over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import joins as J, rules
from duologue.plans.frames import ATTEMPTS, CONDITIONS, EPISODES, attempts, conditions, episodes, iterations, table
from duologue.plans.registry import query

OK = "(goal >= 7 AND relationship >= 0 AND judge)"
GR = "(goal >= 7 AND relationship >= 0)"

_ASM = """ep1 AS (SELECT o_custkey AS env, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1),
st AS (SELECT least(a1, a2) AS lo, greatest(a1, a2) AS hi, arg_max(story, pos) AS story FROM (
  SELECT s_nationkey AS a1, s_suppkey % 25 AS a2, s_suppkey AS pos,
   CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN 'nan' ELSE s_name END AS story FROM supplier)
  WHERE story NOT IN ('', 'nan') GROUP BY 1, 2),
asm AS (SELECT c_custkey AS env, c_name AS scenario, k % 27 AS a1, k // 27 % 25 AS a2, n1.n_name AS a1_name, n2.n_name AS a2_name,
  n1.n_name IS NOT NULL AS a1_known, n2.n_name IS NOT NULL AS a2_known, coalesce(story, '') AS story
 FROM customer JOIN ep1 ON env = c_custkey LEFT JOIN nation n1 ON n1.n_nationkey = k % 27
 LEFT JOIN nation n2 ON n2.n_nationkey = k // 27 % 25
 LEFT JOIN st ON lo = least(k % 27, k // 27 % 25) AND hi = greatest(k % 27, k // 27 % 25))"""


def _assembled(spark, d):
    k = F.col("o_orderkey")
    envs = table(spark, d, "customer").select(F.col("c_custkey").alias("env"), F.col("c_name").alias("scenario"))
    eps = table(spark, d, "orders").select(F.col("o_custkey").alias("env"), F.struct("o_orderdate", "o_orderkey").alias("order"),
                                           (k % 27).alias("a1"), (F.floor(k / 27) % 25).alias("a2"))
    agents = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("agent"), F.col("n_name").alias("name"))
    s = F.col("s_suppkey")
    rel = table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("a1"), (s % 25).alias("a2"), s.alias("pos"),
        F.when(s % 4 == 0, "").when(s % 4 == 1, "nan").otherwise(F.col("s_name")).alias("story"))
    return J.assemble(envs, eps, agents, rel)


@query("d01_seed_assembly", f"WITH {_ASM} SELECT * FROM asm")
def _(spark, d):
    return _assembled(spark, d)


@query("d01_assembly_misses", f"""WITH {_ASM} SELECT count(*) AS n,
 sum(CAST(NOT a1_known AS INT) + CAST(NOT a2_known AS INT)) AS missing_agents, count(*) FILTER (story = '') AS missing_stories FROM asm""")
def _(spark, d):
    return J.assembly_misses(_assembled(spark, d))


@query("d02_held_out", """SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0
 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return J.without_held_out(c, "c_custkey", c.where(F.col("c_custkey") % 10 == 0),
                              table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")))


def _pairing_sql(text):
    return f"""WITH s AS (SELECT s_nationkey AS code, s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i_all,
 row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i_code FROM supplier),
z AS (SELECT code, count(*) AS n_code FROM s GROUP BY 1), w AS (SELECT count(*) AS n_all FROM s),
m AS (SELECT c_custkey, c_nationkey AS code, n_code, CAST(coalesce(n_code, n_all) AS HUGEINT) AS n, md5({text}) AS h
 FROM customer CROSS JOIN w LEFT JOIN z ON z.code = c_nationkey),
e AS (SELECT c_custkey, code, n_code, list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, 8),
 lambda i: ('0x' || substr(h, CAST(i * 4 + 1 AS BIGINT), 4))::HUGEINT)), lambda acc, x: (acc * 65536 + x) % n) AS pick FROM m)
SELECT e.c_custkey, e.code, s.s_suppkey, s.s_name FROM e JOIN s
 ON CASE WHEN n_code IS NULL THEN s.i_all = pick ELSE s.code = e.code AND s.i_code = pick END"""


def _pairing(spark, d, seed=""):
    envs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    pool = table(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), "s_suppkey", "s_name")
    return J.hash_pairing(envs, pool, "c_custkey", "code", "s_suppkey", seed)


@query("d03_md5_pairing", _pairing_sql("CAST(c_custkey AS VARCHAR)"))
def _(spark, d):
    return _pairing(spark, d)


@query("d03_random_pairing", _pairing_sql("'42:' || CAST(c_custkey AS VARCHAR)"))
def _(spark, d):
    return _pairing(spark, d, "42:")


_RES = f"""WITH {ATTEMPTS}, x AS (SELECT event_id, {GR} AS ok_old, event_id % 4 <> 0 AS hit,
 (11 - goal) >= 7 AND relationship >= 0 AS ok_new FROM a),
r AS (SELECT event_id, CASE WHEN hit THEN ok_new ELSE ok_old END AS success,
 CASE WHEN NOT hit THEN 'missing' WHEN ok_old = ok_new THEN 'unchanged' ELSE 'changed' END AS status FROM x)"""


@query("d04_rescore", _RES + " SELECT status, success, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, d):
    a = attempts(spark, d)
    new = a.where(F.col("event_id") % 4 != 0).select("event_id", (11 - F.col("goal")).alias("new_goal"),
                                                     F.col("relationship").alias("new_rel"))
    ok_new = (F.col("new_goal") >= 7) & (F.col("new_rel") >= 0)
    out = J.rescore(a.select("event_id", "goal", "relationship"), new, "event_id", rules.success("goal_rel"), ok_new)
    return out.groupBy("status", "success").agg(F.count(F.lit(1)).alias("n"))


_CAL = """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0),
c AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'frontier' WHEN 1 THEN 'too_easy' WHEN 2 THEN 'beyond_frontier' END AS classification FROM orders)"""


def _cal(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).where(F.col("k") % 3 != 0)
    k = F.col("k")
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumn(
        "classification", F.when(k % 4 == 0, "frontier").when(k % 4 == 1, "too_easy").when(k % 4 == 2, "beyond_frontier"))
    return s, c


@query("d05_calibration_join", _CAL + """ SELECT classification, CASE WHEN classification = 'frontier' THEN 2.0 ELSE 1.0 END AS prior_alpha,
 1.0 AS prior_beta, count(*) AS n FROM s JOIN c USING (k) GROUP BY 1, 2, 3""")
def _(spark, d):
    s, c = _cal(spark, d)
    return J.calibrate(s, c, "k").groupBy("classification", "prior_alpha", "prior_beta").agg(F.count(F.lit(1)).alias("n"))


@query("d05_uncalibrated", _CAL + """ SELECT k, 'no_seed' AS problem FROM c WHERE k NOT IN (SELECT k FROM s)
 UNION ALL SELECT k, 'no_class' FROM c WHERE classification IS NULL AND k IN (SELECT k FROM s)""")
def _(spark, d):
    return J.uncalibrated(*_cal(spark, d), "k")


@query("d06_paired_deltas", f"""WITH {CONDITIONS}, f AS (SELECT condition, scenario, coalesce(goal, 0) AS goal,
 coalesce(knowledge, 0) AS knowledge, CASE WHEN {GR} THEN 1.0 ELSE 0.0 END AS sr FROM cond)
SELECT f.condition, count(*) AS n_paired, avg(f.goal - b.goal) AS goal_delta, avg(f.knowledge - b.knowledge) AS knowledge_delta,
 avg(f.sr - b.sr) AS success_delta FROM f JOIN f b ON b.scenario = f.scenario AND b.condition = 'click'
WHERE f.condition <> 'click' GROUP BY 1""")
def _(spark, d):
    return J.paired_deltas(conditions(spark, d), "click", ["goal", "knowledge"], {"success": rules.success("goal_rel")})


@query("d07_contrast_pairs", f"""WITH {EPISODES} SELECT s.scenario, s.attempt AS success_trial, f.attempt AS fail_trial,
 s.goal AS success_goal, f.goal AS fail_goal FROM ep s JOIN ep f ON s.scenario = f.scenario
WHERE (s.goal >= 7 AND s.relationship >= 0) AND NOT (f.goal >= 7 AND f.relationship >= 0)""")
def _(spark, d):
    return J.contrast_pairs(episodes(spark, d), "scenario", rules.success("goal_rel"), "attempt", ["goal"])


@query("d08_improvement_pairs", f"""WITH {EPISODES}, b AS (SELECT scenario, min(attempt) AS base_trial, arg_min(goal, attempt) AS base_goal
 FROM ep GROUP BY 1 HAVING NOT bool_or({GR})),
l AS (SELECT ep.scenario, attempt AS best_trial, goal AS best_goal, base_trial, base_goal,
 row_number() OVER (PARTITION BY ep.scenario ORDER BY goal DESC, attempt) AS rn FROM ep JOIN b USING (scenario) WHERE attempt > base_trial)
SELECT scenario, base_trial, base_goal, best_trial, best_goal FROM l WHERE rn = 1 AND best_goal > base_goal""")
def _(spark, d):
    return J.improvement_pairs(episodes(spark, d), "scenario", rules.success("goal_rel"), "attempt", "goal")


@query("d09_zip_longest", f"""WITH {ATTEMPTS}, s AS (SELECT source, event_id AS s_id, row_number() OVER (PARTITION BY source ORDER BY event_id) AS n FROM a WHERE {OK}),
f AS (SELECT source, event_id AS f_id, row_number() OVER (PARTITION BY source ORDER BY event_id) AS n FROM a WHERE NOT {OK})
SELECT coalesce(s.source, f.source) AS source, coalesce(s.n, f.n) AS n, s_id, f_id FROM s FULL JOIN f ON s.source = f.source AND s.n = f.n""")
def _(spark, d):
    a = attempts(spark, d)
    ok = rules.success("goal_rel_judge")
    return J.zip_longest(a.where(ok).withColumn("s_id", F.col("event_id")), a.where(~ok).withColumn("f_id", F.col("event_id")),
                         ["source"], "event_id", ["s_id"], ["f_id"])


@query("d11_one_perspective", """WITH x AS (SELECT vec_id // 3 AS source_id, vec_id AS pos, vec_id % 2 = 1 AS m FROM embeddings)
SELECT source_id, coalesce(max(pos) FILTER (m), min(pos)) AS id FROM x GROUP BY 1""")
def _(spark, d):
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select(F.floor(v / 3).alias("source_id"), v.alias("id"))
    return J.one_perspective(e, "source_id", "id", F.col("id") % 2 == 1, ["id"])


@query("d13_id_overlap", """WITH ev AS (SELECT CAST(item_id * 7 AS VARCHAR) AS id FROM benchmark UNION SELECT md5(text) FROM benchmark),
s AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents UNION SELECT md5(text) FROM documents UNION SELECT source FROM documents),
p AS (SELECT CAST(page_id AS VARCHAR) AS id FROM pages UNION SELECT md5(html) FROM pages)
SELECT id, 'seeds' AS corpus FROM s WHERE id IN (SELECT id FROM ev)
UNION ALL SELECT id, 'archive' FROM p WHERE id IN (SELECT id FROM ev)""")
def _(spark, d):
    null = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), F.col("source").alias("env"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5("html").alias("h"), null.alias("env"))
    ev = table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("id"), F.md5("text").alias("h"), F.lit("").alias("env"))
    return J.id_overlap({"seeds": docs, "archive": pages}, ev, ["id", "h", "env"])


@query("d19_fold_rules", """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 END AS fold,
 CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 < 4 THEN r_name ELSE 'combined' END AS rules
FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 5""")
def _(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey")
    fold = rows.where(k % 3 != 0).withColumn("fold", k % 5)
    fr = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("bigint").alias("fold"), F.col("r_name").alias("rules"))
    return J.fold_rules(rows, fold, fr, table(spark, d, "region").agg(F.lit("combined").alias("rules")), "c_custkey")


@query("a12_remaining", f"""WITH {EPISODES} SELECT scenario, attempt FROM ep WHERE event_id % 3 <> 0 OR event_id % 5 = 0""")
def _(spark, d):
    ep = episodes(spark, d).select("scenario", "attempt", "event_id")
    done = ep.where(F.col("event_id") % 3 == 0)
    return J.remaining(ep, done, ["scenario", "attempt"], F.col("event_id") % 5 != 0).select("scenario", "attempt")


@query("a16_named_subset", """WITH m AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM m) AS in_subset FROM customer""")
def _(spark, d):
    lists = table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.array("o_custkey", "o_custkey").alias("members"))
    return J.named_subset(table(spark, d, "customer").select("c_custkey"), lists, "1-URGENT", "c_custkey")


@query("a17_fill_columns", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND quality IS NOT NULL THEN CAST(quality AS VARCHAR)
 WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS title, quality IS NOT NULL AND doc_id % 3 = 0 AS title_filled
FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("title"))
    return J.fill_columns(docs, new, "doc_id", ["title"])
