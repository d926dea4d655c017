"""Section G over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.functions.text import umbrella_label
from duologue.operators import ordering as G, rules
from duologue.plans.frames import ARCHIVE, ATTEMPTS, archive, attempts, table
from duologue.plans.registry import query

OK = "(goal >= 7 AND relationship >= 0 AND judge)"


@query("g01_first_outcomes", f"""WITH {ATTEMPTS}, r AS (SELECT event_id, task, {OK} AS passed,
 row_number() OVER (PARTITION BY task, {OK} ORDER BY event_id) AS rn FROM a)
SELECT * FROM r WHERE rn <= CASE WHEN passed THEN 3 ELSE 5 END""")
def _(spark, d):
    return G.sample_outcomes(attempts(spark, d), "task", rules.success("goal_rel_judge"), "event_id").select(
        "event_id", "task", "passed", "rn")


@query("g02_mode_representatives", f"""WITH {ATTEMPTS}, f AS (SELECT event_id, goal, CASE WHEN goal >= 7 AND relationship >= 0 AND NOT judge THEN 'goal_score_ok_but_judge_rejected'
 WHEN goal >= 7 AND relationship < 0 THEN 'goal_ok_rel_negative' WHEN goal < 7 AND relationship < 0 THEN 'both_goal_and_rel_failed'
 WHEN goal >= 5 THEN 'goal_close_but_insufficient' WHEN goal >= 3 THEN 'goal_partial' ELSE 'goal_very_low' END AS mode FROM a WHERE NOT {OK}),
r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY goal, event_id) AS rn FROM f) SELECT mode, event_id, goal FROM r WHERE rn = 1""")
def _(spark, d):
    return G.representative(attempts(spark, d).where(~rules.success("goal_rel_judge")), rules.failure_mode(), "mode", "event_id", "goal")


@query("g03_top_labels", """WITH k AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5)
SELECT CASE WHEN source IN (SELECT source FROM k) THEN source ELSE 'other' END AS label, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, d):
    return G.top_labels(table(spark, d, "documents"), umbrella_label(F.col("source")), 5).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("g04_newest", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    return G.newest(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "value")


@query("g05_equal_sizes", f"""WITH {ARCHIVE}, m AS (SELECT min(n) AS n FROM (SELECT method, count(*) AS n FROM arc GROUP BY 1)),
r AS (SELECT id, method, row_number() OVER (PARTITION BY method ORDER BY iteration, id) AS rn FROM arc) SELECT id, method, rn FROM r, m WHERE rn <= n""")
def _(spark, d):
    return G.equal_sizes(archive(spark, d).drop("embedding"), "method").select("id", "method", "rn")


@query("g06_ranked_candidates", """WITH c AS (SELECT event_id // 3 AS slot, event_id % 3 AS pos, CASE WHEN event_id % 4 <> 0 THEN round(value / 50) END AS score,
 event_id % 4 <> 0 AND event_id % 29 = 0 AS error FROM events), b AS (SELECT slot, bool_or(error) AS bad FROM c GROUP BY 1)
SELECT slot, pos, row_number() OVER (PARTITION BY slot ORDER BY CASE WHEN bad THEN 0 ELSE -coalesce(score, 0) END, pos) AS place FROM c JOIN b USING (slot)""")
def _(spark, d):
    e = F.col("event_id")
    ev = table(spark, d, "events")
    c = ev.select(F.floor(e / 3).alias("slot"), (e % 3).alias("pos"))
    s = ev.where(e % 4 != 0).select(F.floor(e / 3).alias("slot"), (e % 3).alias("pos"), F.round(F.col("value") / 50).alias("score"), (e % 29 == 0).alias("error"))
    return G.rank_candidates(c, s, "slot", "pos").select("slot", "pos", "place")


@query("g07_relevant_in_order", """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS relevance_rank FROM documents)
SELECT source, doc_id, relevance_rank, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM r WHERE relevance_rank <= 3""")
def _(spark, d):
    return G.relevant_in_order(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id", 3).select(
        "source", "doc_id", "relevance_rank", "place")


@query("g09_custom_order", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS place FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.custom_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "5-LOW"]).alias("place"))
