"""The driver tables read as episode records, in Spark and as SQL text.

Every stand-in keeps all rows of its table. The SQL fragments are common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.operators.rules import class_by_goal
from duologue.operators.scale import rank_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> F.Column:
    """Event time as a number. `events.ts` has no zone; the session zone must not move it."""
    return F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


# One scored attempt for each event.
ATTEMPTS = """
a AS (
  SELECT event_id, user_id AS task, event_type AS source, ts, value,
         least(10.0, value / 5.0) AS goal,
         CAST(event_id % 11 - 5 AS DOUBLE) AS relationship,
         CAST(event_id % 10 AS DOUBLE) AS believability,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 11 AS DOUBLE) END AS knowledge,
         CAST(-(event_id % 4) AS DOUBLE) AS secret,
         CAST(-(event_id % 3) AS DOUBLE) AS social_rules,
         CAST(event_id % 7 - 3 AS DOUBLE) AS financial_and_material_benefits,
         event_id % 7 <> 0 AS judge,
         event_id % 5 <> 0 AS key_ok,
         event_id % 101 = 0 AS error
  FROM events)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("task"), F.col("event_type").alias("source"),
        micros().alias("ts_us"), "value",
        F.least(F.lit(10.0), F.col("value") / 5.0).alias("goal"),
        (e % 11 - 5).cast("double").alias("relationship"),
        (e % 10).cast("double").alias("believability"),
        F.when(e % 13 != 0, (e % 11).cast("double")).alias("knowledge"),
        (-(e % 4)).cast("double").alias("secret"),
        (-(e % 3)).cast("double").alias("social_rules"),
        (e % 7 - 3).cast("double").alias("financial_and_material_benefits"),
        (e % 7 != 0).alias("judge"),
        (e % 5 != 0).alias("key_ok"),
        (e % 101 == 0).alias("error"),
    )


# Episodes of at most four attempts: consecutive events of a user, four at a time.
EPISODES = ATTEMPTS + """,
ep AS (
  SELECT a.*, concat(CAST(task AS VARCHAR), '-', CAST((n - 1) // 4 AS VARCHAR)) AS scenario,
         (n - 1) % 4 + 1 AS attempt
  FROM (SELECT a.*, row_number() OVER (PARTITION BY task ORDER BY ts, event_id) AS n FROM a) a)
"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_rows(attempts(spark, sf_dir), ["task"], [F.col("ts_us"), F.col("event_id")],
                       F.col("ts_us"), "n")
    n0 = F.col("n") - 1
    return ranked.select(
        "*",
        F.concat(F.col("task").cast("string"), F.lit("-"), F.floor(n0 / 4).cast("string")).alias("scenario"),
        (n0 % 4 + 1).alias("attempt"),
    ).drop("n")


# One generation step for each event.
ITERATIONS = ATTEMPTS + """,
it AS (
  SELECT event_id AS iteration, task, source, goal,
         CASE WHEN goal >= 7 THEN 'too_easy' WHEN goal >= 3 THEN 'frontier' ELSE 'beyond_frontier' END AS classification,
         CASE event_id % 3 WHEN 0 THEN 'escalate' WHEN 1 THEN 'lateral' ELSE 'relax' END AS operator,
         event_id % 2 = 0 AS generated,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 3 AS DOUBLE) / 3 END AS lp_value
  FROM a)
"""


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return attempts(spark, sf_dir).select(
        i.alias("iteration"), "task", "source", "goal", class_by_goal().alias("classification"),
        F.when(i % 3 == 0, "escalate").when(i % 3 == 1, "lateral").otherwise("relax").alias("operator"),
        (i % 2 == 0).alias("generated"),
        F.when(i % 6 != 0, (i % 3).cast("double") / 3).alias("lp_value"),
    )


# Condition results: one mean score for each (condition, scenario).
CONDITIONS = ATTEMPTS + """,
cond AS (
  SELECT source AS condition, task AS scenario,
         avg(goal) AS goal, avg(relationship) AS relationship,
         avg(CASE WHEN event_id % 3 = 0 THEN knowledge END) AS knowledge,
         max(CASE WHEN judge THEN 1 ELSE 0 END) = 1 AS judge
  FROM a GROUP BY 1, 2)
"""


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).groupBy(
        F.col("source").alias("condition"), F.col("task").alias("scenario")
    ).agg(
        F.avg("goal").alias("goal"), F.avg("relationship").alias("relationship"),
        F.avg(F.when(F.col("event_id") % 3 == 0, F.col("knowledge"))).alias("knowledge"),
        F.max("judge").alias("judge"),
    )


# Votes: first event of each (scenario, later attempt, order).
VOTES = """
v AS (
  SELECT scenario, j, vote_order, arg_min(verdict, event_id) AS verdict, arg_min(is_error, event_id) AS is_error
  FROM (SELECT user_id AS scenario, event_id % 3 + 2 AS j,
               CASE WHEN event_id // 3 % 2 = 0 THEN 'A=1,B=j' ELSE 'A=j,B=1' END AS vote_order,
               CASE WHEN value < 20 THEN 'A' WHEN value < 50 THEN 'B' ELSE 'no_difference' END AS verdict,
               event_id % 17 = 0 AS is_error, event_id FROM events)
  GROUP BY 1, 2, 3)
"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scenario"), (e % 3 + 2).alias("j"),
        F.when(F.floor(e / 3) % 2 == 0, "A=1,B=j").otherwise("A=j,B=1").alias("vote_order"),
        F.when(F.col("value") < 20, "A").when(F.col("value") < 50, "B").otherwise("no_difference").alias("verdict"),
        (e % 17 == 0).alias("is_error"), "event_id",
    ).groupBy("scenario", "j", "vote_order").agg(
        F.min_by("verdict", "event_id").alias("verdict"), F.min_by("is_error", "event_id").alias("is_error"))


# Archive rows: one for each embedding.
ARCHIVE = """
arc AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE vec_id END AS iteration,
         vec_id // 2 AS source_id, vec_id % 2 AS perspective, label AS niche, label % 3 AS method,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)
"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.when(v % 5 == 0, F.lit(-1)).otherwise(v).cast("bigint").alias("iteration"),
        F.floor(v / 2).alias("source_id"), (v % 2).alias("perspective"), F.col("label").alias("niche"),
        (F.col("label") % 3).alias("method"), F.col("embedding"),
    )


# Lineage forest: parent = id div 3 outside the first ten rows, which are the seeds.
LINEAGE = """
nodes AS (
  SELECT vec_id AS id, CASE WHEN vec_id < 10 THEN -1 ELSE vec_id END AS iteration,
         vec_id >= 10 AND vec_id % 17 = 0 AS rejected FROM embeddings),
edges AS (SELECT vec_id // 3 AS parent, vec_id AS child FROM embeddings WHERE vec_id >= 10 AND vec_id % 23 <> 0)
"""


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.when(v < 10, F.lit(-1)).otherwise(v).cast("bigint").alias("iteration"),
        ((v >= 10) & (v % 17 == 0)).alias("rejected"), "embedding")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").where((v >= 10) & (v % 23 != 0)).select(
        F.floor(v / 3).alias("parent"), v.alias("child"))


TURNS = """
t AS (
  SELECT conv_id, turn AS pos, turn,
         CASE role WHEN 'system' THEN 'Environment' WHEN 'user' THEN 'learner' ELSE 'partner' END AS speaker,
         text AS content
  FROM conversations)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("pos"), "turn",
        F.when(F.col("role") == "system", "Environment").when(F.col("role") == "user", "learner")
        .otherwise("partner").alias("speaker"),
        F.col("text").alias("content"))

