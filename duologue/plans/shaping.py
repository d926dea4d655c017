"""Section B over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.functions import text as T
from duologue.operators import rules, shaping as B, summaries as S
from duologue.operators.scale import rank_rows, top_rows
from duologue.plans.frames import (ATTEMPTS, EPISODES, ITERATIONS, LINEAGE, TURNS, attempts, episodes, iterations,
                                   lineage_nodes, table, turns)
from duologue.plans.registry import query


@query("b01_embedding_text", """SELECT doc_id, concat_ws(chr(10), 'Scenario: ' || text, 'Interaction type: ' || source,
 'Relationship: ' || lang, CASE WHEN doc_id % 2 = 0 THEN 'Learner goal: ' || source ELSE
  CASE WHEN doc_id % 3 <> 0 THEN 'Learner goal: ' || lang END END,
 CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 <> 0 THEN 'Partner goal: ' || lang END
  ELSE 'Partner goal: ' || source END) AS embedding_text FROM documents""")
def _(spark, d):
    goals = F.array(F.col("source"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return table(spark, d, "documents").select("doc_id", T.embedding_text(
        F.col("text"), F.col("source"), F.col("lang"), goals, (F.col("doc_id") % 2).cast("int")).alias("embedding_text"))


@query("b01_structural_key", """WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS sd,
 CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS tp FROM documents)
SELECT doc_id, CASE WHEN sd <> '' AND tp <> '' THEN sd || ' | ' || tp
 ELSE regexp_replace(coalesce(nullif(sd, ''), nullif(tp, ''), left(text, 200)), '^\\s+|\\s+$', '', 'g') END AS key FROM x""")
def _(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", T.structural_key(
        F.when(i % 2 == 0, F.col("source")).otherwise(""), F.when(i % 3 == 0, F.col("lang")).otherwise(""),
        F.lit(None).cast("string"), F.col("text")).alias("key"))


@query("b02_goal_sentence", """SELECT p_partkey, 'Your goal is to ' || p_name
 || CASE WHEN p_partkey % 3 <> 0 THEN ', without ' || p_type ELSE '' END || '.'
 || CASE WHEN p_partkey % 2 = 0 THEN ' <extra_info>' || p_brand || '</extra_info>' ELSE '' END AS goal FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", T.render_goal(
        F.concat(F.lit(" "), F.col("p_name"), F.lit("..")), F.when(k % 3 != 0, F.col("p_type")),
        F.when(k % 2 == 0, F.col("p_brand"))).alias("goal"))


@query("b03_clean_record", """SELECT doc_id, md5(regexp_replace(replace(text, chr(160), ' '), '^\\s+|\\s+$', '', 'g')) AS text_md5,
 lang AS constraint_text FROM documents""")
def _(spark, d):
    t = F.concat(F.lit("\x00  "), F.col("text"), F.lit(" "))
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Without  "), F.col("lang"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.clean_text(t)).alias("text_md5"), T.drop_without(c).alias("constraint_text"))


_RAW = TURNS + """, rt AS (SELECT conv_id, pos, turn, speaker,
 CASE WHEN (conv_id + turn) % 9 = 0 THEN 'did nothing' ELSE content END AS content FROM t),
cl AS (SELECT * FROM rt WHERE speaker <> 'Environment' AND NOT contains(content, 'did nothing') AND content <> '')"""


def raw_turns(spark, d):
    """Turns with the scaffolding that cleaning removes."""
    k = (F.col("conv_id") + F.col("turn"))
    c = (F.when(k % 9 == 0, F.lit("did nothing"))
         .when(k % 9 == 1, F.concat(F.lit('[private to [x, y]]  said: "'), F.col("content"), F.lit('"')))
         .otherwise(F.col("content")))
    return turns(spark, d).withColumn("content", c)


@query("b04_clean_turns", f"WITH {_RAW} SELECT conv_id, pos, turn, speaker, trim(content) AS content FROM cl")
def _(spark, d):
    return B.clean_turns(raw_turns(spark, d)).withColumn("content", F.trim("content"))


@query("b05_render_transcripts", f"""WITH {_RAW} SELECT conv_id,
 string_agg('[T' || turn || '] ' || speaker || ': ' || trim(content), chr(10) ORDER BY pos) AS text FROM cl GROUP BY 1""")
def _(spark, d):
    return B.render(B.clean_turns(raw_turns(spark, d)).withColumn("content", F.trim("content")), ["conv_id"], "judge")


@query("b05_render_history", f"""WITH {TURNS} SELECT conv_id,
 string_agg(speaker || ' said: "' || content || '"', chr(10) ORDER BY pos) AS text FROM t GROUP BY 1""")
def _(spark, d):
    return B.render(turns(spark, d), ["conv_id"], "history")


def _cut_sql(name):
    limit, head, tail, marker = T.TEXT_CUTS[name]
    m = marker.replace("\n", "' || chr(10) || '")
    return (f"SELECT doc_id, '{name}' AS cut, md5(CASE WHEN length(text) > {limit} THEN left(text, {head}) || '{m}' "
            f"|| right(text, {tail}) ELSE text END) AS text_md5 FROM documents")


@query("b06_head_tail_cut", " UNION ALL ".join(_cut_sql(n) for n in T.TEXT_CUTS))
def _(spark, d):
    cuts = F.array(*[F.struct(F.lit(n).alias("cut"), F.md5(T.head_tail(F.col("text"), n)).alias("text_md5"))
                     for n in T.TEXT_CUTS])
    return table(spark, d, "documents").select("doc_id", F.inline(cuts))


@query("b07_flat_scores", """SELECT event_id, value AS goal, 0.0 AS relationship, 0.0 AS knowledge, value / 3 AS overall FROM events""")
def _(spark, d):
    j = F.concat(F.lit('{"goal": {"score": '), F.col("value").cast("string"),
                 F.lit('}, "relationship": {"score": "n/a"}, "other": 1}'))
    df = table(spark, d, "events").select("event_id", j.alias("j"))
    return B.flatten_scores(df, "j", ["goal", "relationship", "knowledge"]).drop("j")


@query("b08_first_speakers", f"""WITH {TURNS}, f AS (SELECT conv_id, speaker, min(pos) AS p FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p, speaker) AS rn FROM f)
SELECT conv_id, coalesce(max(CASE WHEN rn = 1 THEN speaker END), 'the first agent') AS learner,
 coalesce(max(CASE WHEN rn = 2 THEN speaker END), 'the second agent') AS partner FROM r GROUP BY 1""")
def _(spark, d):
    return B.first_speakers(turns(spark, d), "conv_id")


@query("b09_learner_first", """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN lang || '/' || source ELSE source || '/' || lang END AS goals,
 0 AS target FROM documents""")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.array("source", "lang").alias("goals"),
                                             (F.col("doc_id") % 2).cast("int").alias("target"))
    return B.learner_first(df, "target", ["goals"]).withColumn("goals", F.array_join("goals", "/"))


@query("b10_profile_repair", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'she/her' WHEN 1 THEN 'he/him' ELSE 'they/them' END AS pronoun,
 2 AS n_values, CASE WHEN c_custkey % 5 = 0 THEN 30 WHEN c_custkey % 5 = 1 THEN 30 ELSE c_custkey % 5 END AS age,
 CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 5 END AS code,
 c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'Background on their relationship: ' || c_mktsegment ELSE '' END AS scenario
FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    gender = F.when(k % 4 == 0, "Woman").when(k % 4 == 1, "male").when(k % 4 == 2, "Nonbinary")
    age = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "0").otherwise((k % 5).cast("string"))
    label = F.when(k % 3 == 0, "Friends").when(k % 3 == 1, "penpals").otherwise("family members")
    a = T.int_or_zero(age)
    return table(spark, d, "customer").select(
        "c_custkey", T.pronoun(gender).alias("pronoun"),
        F.size(T.comma_list(F.concat(F.col("c_name"), F.lit(", ,"), F.col("c_mktsegment")))).alias("n_values"),
        F.when(a == 0, 30).otherwise(a).alias("age"), T.relationship_code(label).alias("code"),
        T.with_background(F.col("c_name"), F.when(k % 2 == 0, F.col("c_mktsegment"))).alias("scenario"))


@query("b11_reader_category", f"""WITH {ITERATIONS} SELECT CASE WHEN classification = 'too_easy' THEN 'too_easy'
 WHEN classification = 'frontier' AND generated THEN 'frontier_solved'
 WHEN classification = 'frontier' THEN 'frontier_unsolved' ELSE 'beyond_frontier' END AS category, count(*) AS n
FROM it GROUP BY 1""")
def _(spark, d):
    return S.counts_by(iterations(spark, d), rules.reader_category(solved="generated"), "category")


_UMB = "CASE WHEN p IS NULL OR p = '' THEN 'unknown' " + " ".join(
    f"WHEN contains(lower(trim(p)), '{a}') THEN '{b}'" for a, b in T.UMBRELLA_LABELS) + " ELSE p END"


@query("b12_umbrella_label", f"""WITH x AS (SELECT CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Price_Negotiation ' || p_type
 WHEN 2 THEN 'moral_support' WHEN 3 THEN 'Family_dispute' WHEN 4 THEN p_name ELSE ' school' END AS p FROM part)
SELECT {_UMB} AS label, count(*) AS n FROM x GROUP BY 1""")
def _(spark, d):
    k = F.col("p_partkey") % 6
    raw = (F.when(k == 0, "").when(k == 1, F.concat(F.lit("Price_Negotiation "), "p_type")).when(k == 2, "moral_support")
           .when(k == 3, "Family_dispute").when(k == 4, F.col("p_name")).otherwise(" school"))
    return S.counts_by(table(spark, d, "part").withColumn("p", raw), T.umbrella_label(F.col("p")), "label")


@query("b13_child_pointers", """SELECT vec_id AS child, vec_id // 3 AS parent_id, (vec_id // 3) // 9 AS root,
 (vec_id // 3) % 4 + 1 AS depth, concat(CAST(vec_id // 9 AS VARCHAR), ',', CAST(vec_id // 3 AS VARCHAR)) AS ancestors
FROM embeddings""")
def _(spark, d):
    v = F.col("vec_id")
    e = table(spark, d, "embeddings")
    parents = e.select(v.alias("id"), F.floor(v / 9).alias("root"), F.lit(None).cast("bigint").alias("env"),
                       (v % 4).alias("depth"), F.array(F.floor(v / 3)).alias("ancestors"))
    out = B.child_pointers(e.select(v.alias("child"), F.floor(v / 3).alias("parent_id")), parents)
    return out.withColumn("ancestors", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ","))


@query("b14_progress_score", f"""WITH {ATTEMPTS} SELECT event_id,
 (0.6 * greatest(0, least(1, goal / 10)) + 0.2 * greatest(0, least(1, (relationship + 5) / 10))
  + 0.2 * greatest(0, least(1, coalesce(knowledge, 0) / 10))) / 1.0 AS progress FROM a""")
def _(spark, d):
    return attempts(spark, d).select("event_id", rules.progress_score().alias("progress"))


@query("b15_goal_trajectory", f"""WITH {EPISODES} SELECT scenario,
 string_agg(CAST(CAST(round(goal * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY attempt) AS trajectory FROM ep GROUP BY 1""")
def _(spark, d):
    tr = B.goal_trajectory(episodes(spark, d), "scenario")
    return tr.withColumn("trajectory", F.array_join(
        F.transform("trajectory", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ","))


@query("b15_first_last_delta", f"""WITH {EPISODES} SELECT scenario,
 coalesce(arg_max(goal, attempt), 0) - coalesce(arg_min(goal, attempt), 0) AS goal_delta,
 arg_max(coalesce(knowledge, 0), attempt) - arg_min(coalesce(knowledge, 0), attempt) AS knowledge_delta
FROM ep GROUP BY 1 HAVING count(*) >= 2""")
def _(spark, d):
    return B.first_last_delta(episodes(spark, d), "scenario", ["goal", "knowledge"])


@query("b16_canvas_scale", """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT vec_id, (x - x0) / greatest(x1 - x0, 1e-9) * 1000 AS x, (y - y0) / greatest(y1 - y0, 1e-9) * 600 AS y FROM p, l""")
def _(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"),
                                             F.col("embedding")[1].cast("double").alias("y"))
    return B.scale_to_canvas(p, "x", "y", 1000.0, 600.0)


@query("b17_title_parse", """WITH x AS (SELECT p_partkey, p_type, CASE p_partkey % 3 WHEN 0 THEN p_name || ' | ' || p_brand || ' | x'
 WHEN 1 THEN p_name || ' |' ELSE p_name END AS title FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN title ELSE p_type || ' | skills from the target agent navigating ' || p_type END AS title,
 CASE WHEN p_partkey % 3 = 0 THEN trim(split_part(title, '|', 1)) ELSE p_type END AS social_dynamic FROM x""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    raw = (F.when(k == 0, F.concat("p_name", F.lit(" | "), "p_brand", F.lit(" | x")))
           .when(k == 1, F.concat("p_name", F.lit(" |"))).otherwise(F.col("p_name")))
    title, left, _ = T.parse_title(raw, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", title.alias("title"), left.alias("social_dynamic"))


@query("b18_context_text", """WITH r AS (SELECT n_regionkey AS k, 'Rules:' || chr(10) || string_agg(CAST(rn AS VARCHAR) || '. ' || n_name, chr(10) ORDER BY rn) AS t
 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY 1),
e AS (SELECT k, 'Cases:' || chr(10) || string_agg('[' || rn || '] ' || left(s_name, 8), chr(10) ORDER BY rn) AS t
 FROM (SELECT n_regionkey AS k, s_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS rn
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rn <= 2 GROUP BY 1)
SELECT r_regionkey AS k, concat_ws(chr(10) || chr(10), r.t, e.t) AS context FROM region
LEFT JOIN r ON r.k = r_regionkey LEFT JOIN e ON e.k = r_regionkey""")
def _(spark, d):
    nation = table(spark, d, "nation")
    owners = table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    rl = rank_rows(nation.select(F.col("n_regionkey").alias("k"), "n_nationkey", F.col("n_name").alias("text")),
                   ["k"], [F.col("n_nationkey")], F.col("n_nationkey"), "n")
    ex = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("k"), F.col("s_name").alias("text"), "s_acctbal", "s_suppkey")
    ex = top_rows(ex, ["k"], [F.desc("s_acctbal"), F.col("s_suppkey")], 2, "n")
    return B.context_text(owners, "k", rl, ex, "Rules:\n", "Cases:\n", 8)


@query("b19_example_bands", f"""WITH {ITERATIONS}, x AS (SELECT CASE WHEN iteration % 10 = 0 THEN NULL ELSE classification END AS c FROM it),
u AS (SELECT CASE WHEN c IS NULL OR c = 'frontier' THEN 'frontier' WHEN c = 'too_easy' THEN 'too_easy' ELSE 'beyond_frontier' END AS band,
 false AS extra FROM x UNION ALL SELECT 'beyond_frontier', true FROM it WHERE goal < 1)
SELECT band, extra, count(*) AS n FROM u GROUP BY 1, 2""")
def _(spark, d):
    it = iterations(spark, d)
    ex = it.withColumn("classification", F.when(F.col("iteration") % 10 != 0, F.col("classification")))
    return B.split_bands(ex, it.where(F.col("goal") < 1)).groupBy("band", "extra").agg(S.n_rows().alias("n"))


@query("b20_node_roles", f"""WITH {LINEAGE} SELECT id, CASE WHEN iteration < 0 THEN 'seed' WHEN rejected THEN 'failed_int' ELSE 'generated' END AS role FROM nodes""")
def _(spark, d):
    return lineage_nodes(spark, d).select("id", rules.node_role().alias("role"))
