"""Section C over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import checks as C, rules
from duologue.operators.scale import spread
from duologue.plans.frames import EPISODES, TURNS, attempts, episodes, table, turns
from duologue.plans.registry import query


def _scenarios(spark, d):
    i = F.col("doc_id")

    def s(x):
        return F.lit(x)

    profile = F.struct(F.when(i % 11 != 0, F.col("lang")).otherwise("").alias("first_name"),
                       F.col("source").alias("occupation"), F.lit("open").alias("big_five"))
    goal = F.struct(F.col("lang").alias("outcome"), F.when(i % 13 != 0, F.col("source")).otherwise(" ").alias("constraint"),
                    F.lit("x").alias("shortcut"))
    key = F.struct(F.when(i % 17 == 0, "charm").otherwise("reactance").alias("key_mechanism"),
                   F.when(i % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(s("listen"))).alias("movement_conditions"),
                   F.array(s("push")).alias("hardening_triggers"), s("a").alias("surface_misdirection"),
                   s("b").alias("cost_coupling"))
    return table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("scenario"),
        F.when(i % 7 == 0, F.array(profile)).otherwise(F.array(profile, profile)).alias("agent_profiles"),
        F.when(i % 23 == 0, F.array(goal, goal)).otherwise(F.array(goal, F.lit(None).cast(
            "struct<outcome:string,constraint:string,shortcut:string>"))).alias("agent_structured_goals"),
        F.lit("keep it").alias("partner_goal"), F.when(i % 5 != 0, F.lit("friends")).alias("relationship"),
        F.col("source").alias("interaction_type"), key.alias("partner_key"))


@query("c01_first_problem", """WITH x AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'Missing field: relationship'
 WHEN doc_id % 7 = 0 THEN 'agent_profiles must be a list of exactly 2 profiles'
 WHEN doc_id % 11 = 0 THEN 'Agent profile 0 missing/empty field: first_name'
 WHEN doc_id % 13 = 0 THEN 'agent_structured_goals[0] missing/empty field: constraint'
 WHEN doc_id % 23 = 0 THEN 'agent_structured_goals[1] must be null'
 WHEN doc_id % 17 = 0 THEN 'partner_key.key_mechanism is not a known tag'
 WHEN doc_id % 19 = 0 THEN 'partner_key.movement_conditions must be a non-empty list'
 WHEN length(text) < 50 THEN 'scenario too short (< 50 chars)' ELSE 'ok' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM x GROUP BY 1""")
def _(spark, d):
    return _scenarios(spark, d).groupBy(F.coalesce(C.first_problem(), F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


def _doc_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))
    child = docs.where(F.col("doc_id") > 0).withColumn("parent_id", F.floor(F.col("doc_id") / 3))
    j = spread(child, "parent_id").join(parents, "parent_id")  # by the key of the join: its pairs are not moved again
    return j.withColumn("child_names", F.split("text", " ")).withColumn("parent_names", F.split("parent_text", " "))


@query("c02_shared_names", """WITH x AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, ' '),
 lambda w: lower(regexp_replace(w, '^\\s+|\\s+$', '', 'g'))), lambda w: w <> '')) AS names FROM documents)
SELECT c.doc_id, c.doc_id // 3 AS parent_id, len(list_intersect(c.names, p.names)) AS n_reused
FROM x c JOIN x p ON p.doc_id = c.doc_id // 3 WHERE c.doc_id > 0""")
def _(spark, d):
    j = _doc_pairs(spark, d)
    return j.select("doc_id", "parent_id", F.size(F.array_intersect(
        C._names(F.col("child_names")), C._names(F.col("parent_names")))).alias("n_reused"))


@query("c02_surface_novelty")
def _(spark, d):
    j = _doc_pairs(spark, d)  # names are capitalised words that no sentence begins with
    for names, text in (("child_names", "text"), ("parent_names", "parent_text")):
        j = j.withColumn(names, F.regexp_extract_all(text, F.lit(r"(?<=[\p{L}\p{N},] )\p{Lu}\p{Ll}+\b"), 0))
    out = C.surface_novelty(j, "child_names", "parent_names", "text", "parent_text")
    return out.select("doc_id", "parent_id", "is_clone", "passes")


@query("c03_key_delta")
def _(spark, d):
    j = _doc_pairs(spark, d).withColumn("slots", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" B "), F.lit("a"))).otherwise(F.array(F.lit("a"))))
    j = j.withColumn("b_child", F.regexp_extract("text", r"^[^.]*", 0)).withColumn(
        "b_parent", F.regexp_extract("parent_text", r"^[^.]*", 0))
    out = C.key_delta(j, {"b": ("b_child", "b_parent")}, "slots", "child_names", "parent_names", "text", "parent_text")
    return out.select("doc_id", "parent_id", F.array_join("issues", ",").alias("issues"))


@query("c04_key_leaks")
def _(spark, d):
    # Sentences in turn: hidden conditions and triggers. Public is the whole parent text.
    j = _doc_pairs(spark, d).withColumn("s", F.filter(F.split("text", r"(?<=\.)\s+"), lambda x: F.length(x) > 0))
    j = j.withColumn("conditions", F.filter("s", lambda x, i: i % 2 == 0)).withColumn("triggers", F.filter("s", lambda x, i: i % 2 == 1))
    return C.key_leaks(j, "doc_id", "conditions", "triggers", F.col("parent_text"), F.col("parent_text"))


@query("c05_entry_quality", """WITH e AS (SELECT doc_id, source, text AS guidance, lang AS condition,
 CASE WHEN doc_id % 3 = 0 THEN 'Attempt 1: turns' ELSE source END AS provenance FROM documents),
g AS (SELECT source, count(*) > 3 AS too_many FROM e GROUP BY 1)
SELECT doc_id, concat_ws(',',
 CASE WHEN regexp_matches(condition || chr(10) || guidance, '(?i)(\\bwritten\\b|\\breceipt\\b|\\btimestamp|\\bsealed\\b|\\brecorded\\b|\\brecording\\b|\\bphotograph|\\bescrow\\b|\\bdocument(ed|ation)?\\b|\\bemail\\b|\\bsign(ed|ature)\\b|\\bin writing\\b)') THEN 'unexecutable' END,
 CASE WHEN regexp_matches(guidance, '(\\bsee (the )?[A-Z]|\\bsee entry\\b|\\bprotocol\\b|\\b(FINAL|ENTRY|NEW)_\\d)') THEN 'not_self_contained' END,
 CASE WHEN regexp_matches(guidance, '(?i)(\\balways\\b|\\bnever fails\\b|\\breliably\\b|\\bregularly\\b)') THEN 'overgeneralised' END,
 CASE WHEN NOT regexp_matches(provenance, '(?i)attempt\\s*\\d') THEN 'bad_provenance' END) AS issues, too_many
FROM e JOIN g USING (source)""")
def _(spark, d):
    e = table(spark, d, "documents").select(
        "doc_id", "source", F.col("text").alias("guidance"), F.col("lang").alias("condition"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("Attempt 1: turns")).otherwise(F.col("source")).alias("provenance"))
    return C.entry_quality(e, "source").select("doc_id", F.array_join("issues", ",").alias("issues"), "too_many")


@query("c08_validity_flags", f"""WITH {TURNS}, {EPISODES}, aa AS (SELECT task AS conv_id,
 bool_or(key_ok AND NOT goal >= 7) AS key_without_goal, bool_or(goal >= 7 AND NOT key_ok) AS goal_without_key FROM a GROUP BY 1),
tt AS (SELECT conv_id, count(*) <= 6 AND contains(arg_max(content, pos), 'an') AS early_exit FROM t GROUP BY 1)
SELECT coalesce(aa.conv_id, tt.conv_id) AS conv_id, key_without_goal, goal_without_key, early_exit
FROM aa FULL JOIN tt ON aa.conv_id = tt.conv_id""")
def _(spark, d):
    a = attempts(spark, d).withColumnRenamed("task", "conv_id")
    return C.validity_flags(a, turns(spark, d), "conv_id", rules.success("goal"), F.col("key_ok"), closing="an")


@query("c09_runnable", """SELECT c_custkey FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 10 <> 0
 AND c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def _(spark, d):
    k = F.col("c_custkey")
    envs = table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("code"), F.col("c_name").alias("scenario"),
        F.array(F.col("c_mktsegment"), F.when(k % 6 != 0, F.col("c_name")).otherwise("")).alias("goals"))
    pairs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("code"))
    held = table(spark, d, "customer").where(k % 10 == 0).select("c_custkey")
    return C.runnable(envs, pairs, held, "c_custkey", "code").select("c_custkey")


_WALK = """WITH c AS (SELECT event_id, event_id // 4 AS slot, event_id % 4 AS pos, value AS score,
 CASE WHEN event_id % 11 = 0 OR user_id % 6 = 0 THEN 'leak' WHEN event_id % 13 = 0 THEN 'embed' WHEN event_id % 5 = 0 THEN 'coherence'
  WHEN event_id % 3 = 0 THEN 'surface_novelty' WHEN event_id % 100 > 80 THEN 'diversity' END AS gate FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, pos) AS rk FROM c),
s AS (SELECT slot, min(rk) FILTER (gate = 'coherence') AS stop, min(rk) FILTER (gate IS NULL) AS win FROM r GROUP BY 1),
w AS (SELECT event_id, r.slot, gate, CASE WHEN gate = 'leak' THEN 'dropped'
 WHEN gate IS NULL AND rk = win AND (stop IS NULL OR rk < stop) THEN 'admitted'
 WHEN gate IS NOT NULL AND (stop IS NULL OR rk <= stop) AND (win IS NULL OR rk < win) THEN 'rejected'
 ELSE 'not_reached' END AS verdict FROM r JOIN s USING (slot))"""


def _walk(spark, d):
    e = F.col("event_id")
    c = table(spark, d, "events").select("event_id", "user_id", F.floor(e / 4).alias("slot"), (e % 4).alias("pos"),
                                         F.col("value").alias("score"))
    return C.gate_ladder(c, "slot", "score", "pos", {
        "leak": (e % 11 == 0) | (F.col("user_id") % 6 == 0), "embed": e % 13 == 0, "coherence": e % 5 == 0,
        "surface_novelty": e % 3 == 0, "diversity": e % 100 > 80})


@query("c12_gate_log", _WALK + " SELECT event_id, slot, gate, verdict FROM w")
def _(spark, d):
    return _walk(spark, d).select("event_id", "slot", "gate", "verdict")


@query("c12_gate_outcome", _WALK + """ SELECT slot, max(event_id) FILTER (verdict = 'admitted') AS admitted,
 CASE WHEN max(event_id) FILTER (verdict = 'admitted') IS NULL THEN CASE WHEN bool_and(verdict = 'dropped')
 THEN 'all_candidates_leaked_key' ELSE 'no_candidate_passed_gates' END END AS reason FROM w GROUP BY 1""")
def _(spark, d):
    return C.gate_outcome(_walk(spark, d), "slot", "event_id")
