"""Section M over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import ledger as M, rules
from duologue.operators.shaping import exploded_attempts
from duologue.plans.frames import EPISODES, episodes, table
from duologue.plans.registry import query


def _op_text():
    i = F.col("doc_id")
    return F.concat(F.lit("EDIT "), (i % 4).cast("string"), F.lit(": Note: "), F.col("text"), F.lit("\nADD 9: Keep "),
                    F.col("lang"), F.lit(" short.\nAGREE 1: no dot\nREMOVE: Drop "), F.col("source"), F.lit("."))


@query("m01_parse_operations", r"""WITH x AS (SELECT doc_id, 'EDIT ' || doc_id % 4 || ': Note: ' || text || chr(10) || 'ADD 9: Keep ' || lang || ' short.'
 || chr(10) || 'AGREE 1: no dot' || chr(10) || 'REMOVE: Drop ' || source || '.' AS t FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(t, '((?:REMOVE|EDIT|ADD|AGREE)(?: \d+|)): (?:[a-zA-Z\s\d]+: |)(.*)', 1)) AS o,
 unnest(regexp_extract_all(t, '((?:REMOVE|EDIT|ADD|AGREE)(?: \d+|)): (?:[a-zA-Z\s\d]+: |)(.*)', 2)) AS r FROM x)
SELECT doc_id, split_part(trim(o), ' ', 1) AS op, CASE WHEN o NOT LIKE 'ADD%' THEN CAST(nullif(regexp_extract(o, '(\d+)', 1), '') AS INT) END AS num,
 regexp_replace(r, '^\s+|\s+$', '', 'g') AS rule FROM p WHERE regexp_replace(r, '^\s+|\s+$', '', 'g') LIKE '%.' AND r NOT LIKE '%ADD%' AND r NOT LIKE '%AGREE%' AND r NOT LIKE '%EDIT%'""")
def _(spark, d):
    df = table(spark, d, "documents").withColumn("t", _op_text())
    return M.parse_operations(df, "t", ["doc_id"]).select("doc_id", "op", "num", "rule")


def _log(spark, d, kinds):
    """One operation for each event of a user; three events are one step."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (e % len(kinds) + 1).cast("int"))
    return table(spark, d, "events").select(
        "user_id", F.floor(e / 300).alias("step"), e.alias("pos"), kind.alias("op"),
        F.when(kind != "ADD", (e % 5 + 1).cast("int")).alias("num"),
        F.concat(F.lit("Mind "), F.col("event_type"), F.lit(" at level "), F.floor(F.col("value") / 10).cast("string"), F.lit(".")).alias("rule"))


@query("m02_rule_ledger")
def _(spark, d):
    return M.fold(_log(spark, d, ["ADD", "EDIT", "AGREE", "ADD", "REMOVE"]), "user_id", "step", M.apply_operations)


@query("m03_vote_ledger")
def _(spark, d):
    return M.fold(_log(spark, d, ["ADD", "UPVOTE", "EDIT", "DOWNVOTE", "ADD"]), "user_id", "step", M.apply_votes, top=10)


@query("m03_parse_votes", """SELECT doc_id, 0 AS pos, 'ADD' AS op, CAST(NULL AS INTEGER) AS num, source || ' first.' AS rule FROM documents
UNION ALL SELECT doc_id, 1, 'UPVOTE', CAST(doc_id % 4 AS INTEGER), '' FROM documents UNION ALL SELECT doc_id, 3, 'EDIT', 2, lang || ' x' FROM documents
UNION ALL SELECT doc_id, 5, 'DOWNVOTE', 12, '' FROM documents""")
def _(spark, d):
    t = F.concat(F.lit("ADD  "), F.col("source"), F.lit(" first. \n\tUPVOTE "), (F.col("doc_id") % 4).cast("string"),
                 F.lit(" as said\nnothing\r\nEDIT 2 "), F.col("lang"), F.lit(" x\nDOWNVOTE two\nDOWNVOTE 12\nEDIT 3\nADD\nDONE"))
    return M.parse_votes(table(spark, d, "documents").withColumn("t", t), "t", ["doc_id"])


@query("m04_parse_entries", """SELECT doc_id, 'e' || doc_id AS entry_id, lang AS condition, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS guidance,
 CASE WHEN doc_id % 2 = 0 THEN 'WARNING' ELSE 'HEURISTIC' END AS entry_type, CASE WHEN doc_id % 3 = 0 THEN 'REL' ELSE 'GOAL' END AS dimension, source AS provenance FROM documents
UNION ALL SELECT doc_id, 'x_' || doc_id, '', '', 'HEURISTIC', 'GOAL', '' FROM documents""")
def _(spark, d):
    i = F.col("doc_id")
    t = F.concat(F.lit('lead <Entry id="e'), i.cast("string"), F.lit('">\n<Condition>\n'), F.col("lang"), F.lit("\n</Condition><Guidance>"),
                 F.col("text"), F.lit(f"\n{M.STANDING_NOTE}</Guidance><Type>"), F.when(i % 2 == 0, "warning").otherwise("TIP"), F.lit("</Type><Dimension>"),
                 F.when(i % 3 == 0, "rel").otherwise("??"), F.lit("</Dimension><Provenance>"), F.col("source"),
                 F.lit('</Provenance></Entry>\n---\n<Entry  id="x_'), i.cast("string"), F.lit('"></Entry>'))
    return M.parse_entries(table(spark, d, "documents").withColumn("t", t), "t", ["doc_id"]).drop("pos")


@query("m05_entry_merge", """WITH cur AS (SELECT user_id AS owner, event_id AS pos, 'k' || event_id % 5 AS entry_id, 'old' AS body, 'seed' AS provenance,
  row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS rn FROM events WHERE event_id % 7 = 0),
c AS (SELECT * FROM cur WHERE rn = 1),
ed AS (SELECT user_id AS owner, event_id // 100 AS step, event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'k' || event_id % 5 ELSE 'n_' || event_id % 5 END AS entry_id,
  'v' || event_id AS body, event_type AS provenance FROM events WHERE event_id % 3 <> 0),
e2 AS (SELECT owner, step, entry_id, max(pos) AS pos, arg_max(body, pos) AS body, arg_max(provenance, pos) AS provenance FROM ed GROUP BY 1, 2, 3),
v AS (SELECT e2.*, c.owner IS NOT NULL AS known, CASE WHEN c.owner IS NOT NULL OR contains(e2.entry_id, '_') THEN e2.entry_id ELSE e2.owner || '_' || e2.entry_id END AS final_id,
  c.owner IS NOT NULL OR contains(e2.entry_id, '_') AS sticky FROM e2 LEFT JOIN c ON c.owner = e2.owner AND c.entry_id = e2.entry_id),
a AS (SELECT owner, final_id, step, pos, body, provenance, known, sticky FROM v UNION ALL SELECT owner, entry_id, -1, pos, body, provenance, true, true FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, final_id ORDER BY step DESC, pos DESC) AS rn, min(step) OVER (PARTITION BY owner, final_id) AS s0 FROM a)
SELECT owner, final_id AS entry_id, body, CASE WHEN NOT known AND (NOT sticky OR s0 = step) AND NOT contains(provenance, CAST(step AS VARCHAR))
 THEN provenance || ', ' || owner || ' attempt ' || step ELSE provenance END AS provenance FROM r WHERE rn = 1""")
def _(spark, d):
    e = F.col("event_id")
    ev = table(spark, d, "events").withColumn("owner", F.col("user_id"))
    five = (e % 5).cast("string")
    cur = ev.where(e % 7 == 0).select("owner", e.alias("pos"), F.concat(F.lit("k"), five).alias("entry_id")).groupBy(
        "owner", "entry_id").agg(F.min("pos").alias("pos")).select("owner", "pos", "entry_id", F.lit("old").alias("body"), F.lit("seed").alias("provenance"))
    ed = ev.where(e % 3 != 0).select("owner", F.floor(e / 100).alias("step"), e.alias("pos"),
                                     F.concat(F.when(e % 2 == 0, "k").otherwise("n_"), five).alias("entry_id"),
                                     F.concat(F.lit("v"), e.cast("string")).alias("body"), F.col("event_type").alias("provenance"))
    return M.merge_entries(cur, ed.select("owner", "step", "pos", "entry_id"), ed, "owner").drop("place")


@query("m06_trajectories", f"""WITH {EPISODES} SELECT scenario AS scenario_id, attempt - 1 AS trial, goal AS goal_score,
 goal >= 7 AND relationship >= 0 AS success FROM ep""")
def _(spark, d):
    a = F.struct(F.col("attempt").cast("int").alias("attempt"), F.struct("goal", "relationship").alias("scores"))
    recs = episodes(spark, d).groupBy("scenario").agg(F.collect_list(a).alias("attempts")).select(
        F.col("scenario").alias("scenario_id"), F.lit("").alias("scenario"), F.lit("").alias("learner_goal"), "attempts")
    return exploded_attempts(recs).select("scenario_id", "trial", "goal_score", "success")
