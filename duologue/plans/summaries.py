"""Section E and C10/C11 over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import rules, summaries as S
from duologue.plans.frames import (ATTEMPTS, CONDITIONS, EPISODES, ITERATIONS, VOTES, attempts, conditions, episodes,
                                   iterations, table, votes)
from duologue.plans.registry import query

OK = "(goal >= 7 AND relationship >= 0 AND judge)"
GR = "(goal >= 7 AND relationship >= 0)"
DIMS = rules.DIMENSIONS


def _dim_union(src: str, by: str, where: str = "TRUE", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{d}' AS dimension, avg({d}) AS mean, stddev_pop({d}) AS std, count({d}) AS n "
        f"FROM {src} WHERE {where} GROUP BY {extra or by}" for d in DIMS)


@query("c06_rule_comparison", f"""WITH {ATTEMPTS}
SELECT {OK} AND key_ok AS full_rule, {GR} AS goal_rel_rule, goal >= 7 AS goal_rule, count(*) AS n
FROM a GROUP BY 1, 2, 3""")
def _(spark, d):
    return rules.compare_rules(attempts(spark, d))


@query("e01_type_counts", """SELECT coalesce(nullif(source, ''), nullif(lang, ''), 'unknown') AS interaction_type,
count(*) AS n FROM documents GROUP BY 1""")
def _(spark, d):
    return S.counts_by(table(spark, d, "documents"), S.filled("source", "lang"), "interaction_type")


@query("e02_sweep_totals", f"""WITH {ATTEMPTS}
SELECT count(*) AS n_total, count(*) FILTER (NOT error) AS n_completed, count(*) FILTER (error) AS n_errors,
count(*) FILTER (NOT error AND {OK}) AS n_passed, count(*) FILTER (NOT error AND NOT {OK}) AS n_failed,
count(*) FILTER (NOT error AND {OK}) / greatest(count(*) FILTER (NOT error), 1) AS pass_rate FROM a""")
def _(spark, d):
    return S.sweep_totals(attempts(spark, d), rules.success("goal_rel_judge"), F.col("error"))


@query("e02_outcome_ids", f"""WITH {ATTEMPTS}
SELECT event_id, CASE WHEN error THEN 'error' WHEN {OK} THEN 'passed' ELSE 'failed' END AS outcome FROM a""")
def _(spark, d):
    return S.outcome_rows(attempts(spark, d), "event_id", rules.success("goal_rel_judge"), F.col("error"))


@query("e02_dimension_means", f"WITH {ATTEMPTS}, b AS (SELECT *, {OK} AS passed FROM a WHERE NOT error) "
       + _dim_union("b", "passed"))
def _(spark, d):
    df = attempts(spark, d).where(~F.col("error")).withColumn("passed", rules.success("goal_rel_judge"))
    return S.dimension_stats(df, ["passed"])


@query("e03_pass_rate_by_source", f"""WITH {ATTEMPTS}
SELECT source, grouping(source) AS is_total, count(*) AS total, count(*) FILTER ({OK}) AS passed,
count(*) FILTER ({OK}) / count(*) AS pass_rate FROM a WHERE NOT error GROUP BY GROUPING SETS ((), (source))""")
def _(spark, d):
    df = attempts(spark, d).where(~F.col("error"))
    return S.pass_rate_by(df, F.col("source"), "source", rules.success("goal_rel_judge"))


_MODE = """CASE WHEN goal >= 7 AND relationship >= 0 AND NOT judge THEN 'goal_score_ok_but_judge_rejected'
WHEN goal >= 7 AND relationship < 0 THEN 'goal_ok_rel_negative'
WHEN goal < 7 AND relationship < 0 THEN 'both_goal_and_rel_failed'
WHEN goal >= 5 THEN 'goal_close_but_insufficient' WHEN goal >= 3 THEN 'goal_partial' ELSE 'goal_very_low' END"""


@query("e04_failure_modes", f"""WITH {ATTEMPTS}
SELECT {_MODE} AS mode, count(*) AS n FROM a WHERE NOT error AND NOT {OK} GROUP BY 1""")
def _(spark, d):
    ok = rules.success("goal_rel_judge")
    return S.failure_modes(attempts(spark, d), ~F.col("error") & ~ok)


@query("e05_dimension_stats_by_source", f"WITH {ATTEMPTS} " + _dim_union("a", "source", "NOT error"))
def _(spark, d):
    return S.dimension_stats(attempts(spark, d).where(~F.col("error")), ["source"])


@query("e05_hard_vs_rest", f"""WITH {ATTEMPTS}
SELECT task % 7 = 0 AS is_hard, count(*) AS n, avg(goal) AS mean_goal, stddev_pop(goal) AS std_goal,
avg(CASE WHEN goal >= 7 THEN 1.0 ELSE 0.0 END) AS success_rate FROM a WHERE NOT error GROUP BY 1""")
def _(spark, d):
    return attempts(spark, d).where(~F.col("error")).groupBy((F.col("task") % 7 == 0).alias("is_hard")).agg(
        S.n_rows().alias("n"), F.avg("goal").alias("mean_goal"), F.stddev_pop("goal").alias("std_goal"),
        F.avg(rules.success("goal").cast("double")).alias("success_rate"))


_CLS = ", ".join(f"count(*) FILTER (classification = '{c}') AS {c}" for c in rules.CLASSES)


@query("e06_class_counts_by_source", f"WITH {ITERATIONS} SELECT source, {_CLS}, count(*) AS n FROM it GROUP BY 1")
def _(spark, d):
    return S.class_counts(iterations(spark, d), ["source"])


@query("e06_lp_stats", f"""WITH {ITERATIONS} SELECT source, avg(lp_value) AS mean, stddev_pop(lp_value) AS std,
count(lp_value) AS n FROM it WHERE classification IN ('frontier', 'beyond_frontier') GROUP BY 1""")
def _(spark, d):
    return S.value_stats(iterations(spark, d).where(F.col("classification").isin("frontier", "beyond_frontier")),
                         ["source"], "lp_value")


@query("e07_operator_class_crosstab", f"""WITH {ITERATIONS},
g AS (SELECT operator, {_CLS}, count(*) AS n FROM it GROUP BY 1) """ + " UNION ALL ".join(
    f"SELECT operator, '{c}' AS child_class, {c} AS count, {c} / n AS fraction FROM g" for c in rules.CLASSES))
def _(spark, d):
    return S.crosstab_shares(iterations(spark, d), "operator")


@query("e07_direction_check", f"""WITH {ITERATIONS}, s AS (
SELECT count(*) FILTER (operator = 'escalate' AND classification = 'too_easy') AS escalate_too_easy,
 count(*) FILTER (operator = 'escalate') AS escalate_total,
 count(*) FILTER (operator = 'lateral' AND classification = 'too_easy') AS lateral_too_easy,
 count(*) FILTER (operator = 'lateral') AS lateral_total FROM it),
r AS (SELECT *, escalate_too_easy / escalate_total AS escalate_rate, lateral_too_easy / lateral_total AS lateral_rate,
 escalate_total >= 8 AND lateral_total >= 8 AS armed FROM s)
SELECT *, armed AND escalate_rate > lateral_rate AND escalate_too_easy >= 3 AS halt FROM r""")
def _(spark, d):
    return S.direction_check(iterations(spark, d))


@query("e08_extraction_yield", f"""WITH {EPISODES}, p AS (SELECT scenario, bool_or({GR}) AS s, bool_or(NOT {GR}) AS f,
 bool_or(goal >= 3 AND goal < 7) AS fr FROM ep GROUP BY 1)
SELECT count(*) FILTER (s) AS n_success_tasks, count(*) FILTER (s AND f) AS n_compare_pairs,
 count(*) FILTER (fr AND NOT s) AS n_frontier_unsolved FROM p""")
def _(spark, d):
    return S.extraction_yield(episodes(spark, d), "scenario", rules.success("goal_rel"),
                              rules.class_by_goal() == "frontier")


@query("e09_condition_summary", f"""WITH {CONDITIONS}
SELECT condition, count(*) AS n, avg(goal) AS goal_mean, avg(relationship) AS relationship_mean,
 avg(knowledge) AS knowledge_mean, avg(CASE WHEN goal >= 7 AND relationship >= 0 THEN 1.0 ELSE 0.0 END) AS success_rate_goal_rel,
 avg(CASE WHEN goal >= 7 AND relationship >= 0 AND judge THEN 1.0 ELSE 0.0 END) AS terminal_success_rate
FROM cond GROUP BY 1""")
def _(spark, d):
    return S.condition_summary(conditions(spark, d), ["goal", "relationship", "knowledge"],
                               rules.success("goal_rel"), rules.success("goal_rel_judge"))


_LP = VOTES + """,
pr AS (SELECT scenario, j, count(*) AS n, count(*) FILTER (is_error) AS err,
  count(*) FILTER (NOT is_error AND vote_order = 'A=1,B=j' AND verdict = 'B') > 0
  AND count(*) FILTER (NOT is_error AND vote_order = 'A=j,B=1' AND verdict = 'A') > 0 AS both_later
  FROM v GROUP BY 1, 2),
lp AS (SELECT scenario, sum(CASE WHEN both_later THEN 2 ELSE 0 END) AS improved_votes, sum(n) AS total_votes,
  count(*) AS n_pairs, sum(err) AS n_error_votes,
  round(sum(CASE WHEN both_later THEN 2 ELSE 0 END) / sum(n), 4) AS lp_value, sum(err) = sum(n) AS quarantine
  FROM pr GROUP BY 1)
"""


@query("e10_vote_collapse", f"WITH {_LP} SELECT * FROM lp")
def _(spark, d):
    return S.vote_collapse(votes(spark, d))


@query("e11_classification", f"""WITH {EPISODES}, {_LP},
p AS (SELECT scenario, any_value(task) AS task, min(CASE WHEN {OK} AND NOT error THEN attempt END) AS solved_at,
 count(*) FILTER (NOT error) AS n_clean, bool_or(error) AS had_error FROM ep GROUP BY 1)
SELECT p.scenario, solved_at, n_clean, CASE WHEN solved_at = 1 THEN 'too_easy'
 WHEN solved_at IS NULL AND had_error AND n_clean < 2 THEN 'discarded'
 WHEN coalesce(quarantine, false) THEN 'discarded'
 WHEN solved_at IS NOT NULL OR coalesce(lp_value, 0) > 0 THEN 'frontier' ELSE 'beyond_frontier' END AS classification
FROM p LEFT JOIN lp ON lp.scenario = p.task AND p.scenario = concat(CAST(p.task AS VARCHAR), '-0')""")
def _(spark, d):
    # Votes belong to the first episode of a user.
    lp = S.vote_collapse(votes(spark, d)).withColumn("scenario", F.concat(F.col("scenario").cast("string"), F.lit("-0")))
    return S.classify(episodes(spark, d), rules.success("goal_rel_judge"), lp, "scenario", F.col("error"))


KEYS = """kk AS (SELECT ep.*, CASE WHEN event_id % 4 = 0 THEN [1] WHEN event_id % 4 = 1 THEN [0, 2] ELSE [] END AS met,
 CASE WHEN event_id % 3 = 0 THEN [1, 2] WHEN event_id % 3 = 1 THEN [2] ELSE [] END AS tripped,
 CASE WHEN event_id % 2 = 0 THEN [2] ELSE [] END AS repaired FROM ep)"""
_OPEN = "len(list_filter(tripped, lambda x: NOT list_contains(repaired, x))) > 0"


def key_checks(df):
    e = F.col("event_id")

    def arr(*xs):
        return F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")

    return (df.withColumn("conditions_met", F.when(e % 4 == 0, arr(1)).when(e % 4 == 1, arr(0, 2)).otherwise(arr()))
            .withColumn("triggers_tripped", F.when(e % 3 == 0, arr(1, 2)).when(e % 3 == 1, arr(2)).otherwise(arr()))
            .withColumn("triggers_repaired", F.when(e % 2 == 0, arr(2)).otherwise(arr())))


@query("e12_stuck_slot", f"""WITH {EPISODES}, {KEYS}, p AS (SELECT scenario, count(*) AS n,
 count(*) FILTER ({_OPEN}) AS n_open, count(*) FILTER (len(tripped) > 0) AS n_tripped,
 bool_or(len(met) > 0) AS any_met, bool_or({OK}) AS any_solved FROM kk GROUP BY 1)
SELECT scenario, CASE WHEN n_open > 0 AND n_open >= (n + 1) // 2 THEN 'hardening_triggers_too_congruent'
 WHEN NOT any_met AND n_tripped <= n // 2 THEN 'surface_misdirection_undiscoverable'
 WHEN any_met AND NOT any_solved THEN 'cost_coupling_too_high' ELSE 'unknown' END AS stuck_knob FROM p""")
def _(spark, d):
    return S.stuck_slot(key_checks(episodes(spark, d)), "scenario", rules.success("goal_rel_judge"))


@query("c07_key_check_disagreement", f"""WITH {EPISODES}, {KEYS},
c AS (SELECT key_ok AS stored, len(met) > 0 AND NOT ({_OPEN}) AS derived FROM kk)
SELECT stored, derived, count(*) AS n FROM c GROUP BY 1, 2""")
def _(spark, d):
    df = key_checks(attempts(spark, d))
    return df.groupBy(F.col("key_ok").alias("stored"), rules.derived_key_check().alias("derived")).agg(S.n_rows().alias("n"))


CHILDREN = """ch AS (SELECT user_id % 20 AS anchor, event_id AS iteration,
 CASE event_id % 5 WHEN 0 THEN 'too_easy' WHEN 1 THEN 'frontier' WHEN 2 THEN 'frontier'
  WHEN 3 THEN 'beyond_frontier' ELSE 'generation_failed' END AS state,
 event_id % 3 AS improved, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 6 END AS total, value >= 35 AS solved FROM events),
cv AS (SELECT *, CASE WHEN state = 'frontier' THEN improved ELSE 0 END AS alpha,
 CASE state WHEN 'too_easy' THEN 6 WHEN 'frontier' THEN greatest(greatest(total, 1) - improved, 0)
  WHEN 'beyond_frontier' THEN CASE WHEN total > 0 THEN total ELSE 6 END ELSE 1 END AS beta FROM ch)"""


def children(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (F.col("user_id") % 20).alias("anchor"), e.alias("iteration"),
        F.when(e % 5 == 0, "too_easy").when((e % 5).isin(1, 2), "frontier").when(e % 5 == 3, "beyond_frontier")
        .otherwise("generation_failed").alias("terminal_state"),
        (e % 3).alias("improved"), F.when(e % 7 == 0, 0).otherwise(6).alias("total"),
        (F.col("value") >= 35).alias("solved"))


@query("e13_posterior", f"""WITH {CHILDREN} SELECT anchor, sum(alpha) AS alpha_votes, sum(beta) AS beta_votes,
 count(*) AS n_selected, count(*) FILTER (state <> 'generation_failed') AS n_children,
 count(*) FILTER (state = 'frontier' AND solved) AS n_solved FROM cv GROUP BY 1""")
def _(spark, d):
    return S.posterior(children(spark, d))


@query("e14_gini", """WITH f AS (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM f)
SELECT 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini FROM r""")
def _(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(S.n_rows().alias("x"))
    return S.gini(per, "x")


@query("e19_two_set_composition", f"""WITH {ITERATIONS},
o AS (SELECT s.generated, c.classification, coalesce(k.n, 0) AS obs, s.n AS rt, c.n AS ct, g.n AS gt
 FROM (SELECT generated, count(*) n FROM it GROUP BY 1) s, (SELECT classification, count(*) n FROM it GROUP BY 1) c,
 (SELECT count(*) n FROM it) g LEFT JOIN (SELECT generated, classification, count(*) n FROM it GROUP BY 1, 2) k
 ON k.generated = s.generated AND k.classification = c.classification),
x AS (SELECT sum((obs - rt * ct / gt) * (obs - rt * ct / gt) / (rt * ct / gt)) AS chi2 FROM o)
SELECT chi2, exp(-chi2 / 2) AS p_value FROM x""")
def _(spark, d):
    return S.two_set_composition(iterations(spark, d), "generated")


@query("e20_lp_grades", """WITH b AS (SELECT value / 100 AS lp FROM events),
g AS (SELECT list_position(x, list_min(x)) - 1 AS grade
 FROM (SELECT [abs(lp - 1.0/3.0), abs(lp - 0.5), abs(lp - 2.0/3.0), abs(lp - 1.0)] AS x FROM b))
SELECT grade, count(*) AS n FROM g GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "events").groupBy(S.nearest_grade(F.col("value") / 100).alias("grade")).agg(S.n_rows().alias("n"))


@query("e21_wilson_by_source", f"""WITH {ATTEMPTS}, s AS (SELECT source, count(*) FILTER ({OK}) AS k,
 CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY 1),
w AS (SELECT source, k, n, k / n AS p, 1 + 3.8416 / n AS dd FROM s)
SELECT source, k, n, p AS share,
 greatest(0, (p + 3.8416 / (2 * n)) / dd - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / dd) AS lo,
 least(1, (p + 3.8416 / (2 * n)) / dd + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / dd) AS hi FROM w""")
def _(spark, d):
    g = attempts(spark, d).groupBy("source").agg(
        S.n_rows(rules.success("goal_rel_judge")).alias("k"), S.n_rows().cast("double").alias("n"))
    p, lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("source", "k", "n", p.alias("share"), lo.alias("lo"), hi.alias("hi"))


@query("e24_judge_quality", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS hit,
 count(*) FILTER (toxic = 0 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp,
 count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels)
SELECT n, hit / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def _(spark, d):
    return S.judge_quality(table(spark, d, "labels"), 1 - F.col("toxic"), F.col("quality"))


@query("e24_judge_error", """SELECT count(*) AS n, avg(abs((1 - toxic) - quality)) AS mae,
 corr(1 - toxic, quality) AS pearson FROM labels""")
def _(spark, d):
    return S.judge_error(table(spark, d, "labels"), 1 - F.col("toxic"), F.col("quality"))


_FL = """fl AS (SELECT ep.*, len(met) > 0 AND NOT (%s) AS derived, event_id %% 8 = 0 AS leaked,
 CASE WHEN event_id %% 9 <> 0 THEN event_id %% 3 = 0 END AS early_yield, event_id %% 11 = 0 AS ignored_trigger
 FROM kk ep)""" % _OPEN


def flagged(df):
    e = F.col("event_id")
    return (key_checks(df).withColumn("derived", rules.derived_key_check()).withColumn("leaked", e % 8 == 0)
            .withColumn("early_yield", F.when(e % 9 != 0, e % 3 == 0)).withColumn("ignored_trigger", e % 11 == 0))


@query("e25_fidelity_by_source", f"""WITH {EPISODES}, {KEYS}, {_FL}
SELECT source, count(*) AS n, avg(CAST(leaked AS INT)) AS leaked_rate, avg(CAST(early_yield AS INT)) AS early_yield_rate,
 avg(CAST(ignored_trigger AS INT)) AS ignored_trigger_rate, count(*) FILTER (key_ok <> derived) AS n_disagree,
 count(*) FILTER ({OK} AND (leaked OR coalesce(early_yield, false) OR ignored_trigger)) AS n_solved_flagged
FROM fl GROUP BY 1""")
def _(spark, d):
    df = flagged(attempts(spark, d))
    return S.fidelity(df, ["source"], F.col("key_ok"), F.col("derived"),
                      {f: F.col(f) for f in ("leaked", "early_yield", "ignored_trigger")},
                      rules.success("goal_rel_judge"))


_CELLS = f"""WITH {EPISODES}, {KEYS}, {_FL}, c AS (SELECT task, bool_or(leaked AND judge) AS leaked_fail,
 coalesce(bool_or(early_yield AND judge AND value > 60), false) AS early_yield_fail FROM fl GROUP BY 1),
ct AS (SELECT *, CAST(leaked_fail AS INT) + CAST(early_yield_fail AS INT) AS total_failures FROM c)"""


def _cells(spark, d):
    df = flagged(attempts(spark, d)).select(
        "task", (F.col("leaked") & F.col("judge")).alias("leaked"),
        (F.col("early_yield") & F.col("judge") & (F.col("value") > 60)).alias("early_yield"))
    return S.probe_cells(df, "task", ["leaked", "early_yield"])


@query("e26_probe_cells", _CELLS + " SELECT * FROM ct")
def _(spark, d):
    return _cells(spark, d)


@query("e26_probe_verdict", _CELLS + " SELECT sum(total_failures) AS failed_cells, sum(total_failures) <= 1 AS accepted FROM ct")
def _(spark, d):
    return S.probe_verdict(_cells(spark, d))


@query("e27_go_no_go", f"""WITH {EPISODES}, p AS (SELECT scenario, bool_or(attempt = 1 AND {OK}) AS naive,
 bool_or(attempt > 1 AND {OK}) AS retry FROM ep GROUP BY 1),
s AS (SELECT count(*) AS n, count(*) FILTER (NOT naive) AS naive_fail,
 count(*) FILTER (NOT naive AND retry) AS retry_solved FROM p),
h AS (SELECT *, naive_fail / n AS headroom, retry_solved / naive_fail AS gap FROM s)
SELECT *, CASE WHEN headroom < 0.3 THEN 'no_headroom' WHEN gap >= 0.3 THEN 'go' ELSE 'no_gap' END AS decision FROM h""")
def _(spark, d):
    ok = rules.success("goal_rel_judge")
    per = episodes(spark, d).groupBy("scenario").agg(
        F.bool_or((F.col("attempt") == 1) & ok).alias("naive"), F.bool_or((F.col("attempt") > 1) & ok).alias("retry"))
    return S.go_no_go(per, F.col("naive"), F.col("retry"))


@query("e28_tag_frequency", "SELECT lang AS tag, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return S.counts_by(table(spark, d, "documents"), F.col("lang"), "tag")


@query("e29_call_usage", """SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000) AS tokens_in,
 sum(user_id) AS tokens_out, count(*) FILTER (event_id % 31 = 0) AS errors, avg(value) AS mean_ms, max(value) AS max_ms
FROM events GROUP BY 1""")
def _(spark, d):
    df = table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("ms"), (F.col("event_id") % 1000).alias("ti"),
        F.col("user_id").alias("to"), F.when(F.col("event_id") % 31 == 0, "timeout").alias("err"))
    return S.call_usage(df, "model", "ms", "err", "ti", "to")


@query("e30_solve_report", f"""WITH {EPISODES}, p AS (SELECT scenario, bool_or({OK}) AS s, arg_max(goal, attempt) AS g,
 count(*) AS k FROM ep GROUP BY 1)
SELECT count(*) AS n_tasks, avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) AS solve_rate, avg(g) AS mean_goal,
 avg(k) AS mean_attempts FROM p""")
def _(spark, d):
    return S.solve_report(episodes(spark, d), "scenario", rules.success("goal_rel_judge"), "goal")


@query("e31_amplification", """WITH s AS (SELECT c_mktsegment AS family, count(*) AS n_seeds FROM customer GROUP BY 1),
c AS (SELECT c_mktsegment AS family, count(*) AS n_children FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
j AS (SELECT s.family, n_seeds, coalesce(n_children, 0) AS n_children FROM s LEFT JOIN c USING (family)),
t AS (SELECT sum(n_seeds) AS ts, sum(n_children) AS tc FROM j)
SELECT family, n_seeds, n_children, n_children / n_seeds AS amplification,
 (n_children - n_seeds * tc / ts) * (n_children - n_seeds * tc / ts) / (n_seeds * tc / ts) AS chi2_term FROM j, t""")
def _(spark, d):
    from duologue.operators.scale import salted_join

    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("family"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return S.amplification(cust, salted_join(orders, cust, ["k"], "inner", ["o_orderkey"]), "family")


@query("e32_generation_summary", """SELECT event_type AS condition, count(*) AS n,
 avg(CASE WHEN event_id % 10 <> 0 THEN 1.0 ELSE 0.0 END) AS ok_rate,
 avg(CASE WHEN event_id % 4 = 0 THEN NULL WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(value) AS mean_seconds
FROM events GROUP BY 1""")
def _(spark, d):
    df = table(spark, d, "events").withColumn("condition", F.col("event_type"))
    return S.generation_summary(df, "condition", F.col("event_id") % 10 != 0,
                                F.when(F.col("event_id") % 4 != 0, F.col("value") > 40), F.col("value"))


@query("c11_completeness", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS n_filled, "
    f"count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') / count(*) AS fill_rate FROM "
    "(SELECT d.doc_id, lang, nullif(source, 'src0') AS source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
    for c in ("doc_id", "lang", "source", "quality", "toxic")))
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.nullif("source", F.lit("src0")).alias("source"))
    return S.completeness(docs.join(table(spark, d, "labels"), "doc_id", "left"))


@query("c10_mixed_categories", f"""WITH {ATTEMPTS}, g AS (SELECT task AS category, count(*) FILTER ({OK}) AS n_pass,
 count(*) FILTER (NOT {OK}) AS n_fail FROM a GROUP BY 1)
SELECT * FROM g WHERE n_pass >= 1 AND n_fail >= 1 AND n_pass + n_fail >= 5""")
def _(spark, d):
    from duologue.operators.checks import mixed_categories

    return mixed_categories(attempts(spark, d), F.col("task"), rules.success("goal_rel_judge"))
