"""Section A (and U4) on files that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.functions.vectors import hashed_embedding
from duologue.operators import rules, summaries as S
from duologue.plans.frames import ATTEMPTS, EPISODES, attempts, episodes, table
from duologue.plans.registry import query
from duologue.session import fresh_path
from duologue.sources import readers as R, sinks as K


@query("a01_seed_perspectives", """SELECT 'd' || doc_id || '_p' || p AS id, 'd' || doc_id AS source_env_id, md5(text) AS scenario_md5, 2 AS n_profiles,
 lang AS first_goal, CASE WHEN doc_id % 2 = 0 THEN 'friends' ELSE '3' END AS relationship, source AS tag, p AS target_agent_idx
FROM documents, (SELECT unnest([0, 1]) AS p)""")
def _(spark, d):
    i = F.col("doc_id")
    path = fresh_path(spark, "seeds")
    prof = F.struct(F.lit("Ann").alias("first_name"), F.array(F.lit("care"), F.lit("duty")).alias("moral_values"))
    table(spark, d, "documents").select(
        F.concat(F.lit("d"), i.cast("string")).alias("env_pk"), F.col("text").alias("scenario"), "source", F.array("lang").alias("agent_goals"),
        F.lit(3).alias("relationship_type"), F.when(i % 2 == 0, "friends").alias("relationship_label"),
        F.array(prof).alias("agent_profiles")).write.json(path)
    return R.read_seeds(spark, path).select(
        "id", "source_env_id", F.md5("scenario").alias("scenario_md5"), F.size("agent_profiles").alias("n_profiles"),
        F.col("agent_goals")[0].alias("first_goal"), "relationship", "tag", "target_agent_idx")


@query("a04_episode_records", f"""WITH {ATTEMPTS} SELECT CAST(event_id AS VARCHAR) AS scenario_id, goal FROM a WHERE NOT error""")
def _(spark, d):
    path = fresh_path(spark, "episodes")
    attempts(spark, d).select(F.col("event_id").cast("string").alias("scenario_id"), F.struct("goal").alias("scores"),
                              F.when(F.col("error"), "timeout").alias("error")).write.json(path)
    return R.read_episodes(spark, path, multi_line=False).select("scenario_id", F.col("scores.goal").alias("goal"))


@query("a02_probes", """SELECT 'p' || p_partkey AS id, p_name AS scenario, split_part(p_brand, '#', 1) AS first_name, CASE WHEN p_partkey % 2 = 0 THEN 'rival'
 ELSE 'acquaintance' END AS relationship, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS target_agent_idx FROM part""")
def _(spark, d):
    path, k = fresh_path(spark, "probes"), F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("scenario"),
                                          F.array(F.struct(F.concat(F.split("p_brand", "#")[0], F.lit("  of Mill")).alias("name"))).alias("agent_profiles"),
                                          F.when(k % 2 == 0, "rival").alias("relationship"), F.when(k % 3 == 0, 1).alias("target_agent_idx"))
    extra = spark.createDataFrame([("# a comment",), ("  ",), ('{"_format_doc": "fields"}',)], "value string")
    rows.select(F.to_json(F.struct("*")).alias("value")).unionByName(extra).write.text(path)
    return R.read_probes(spark, path).select("id", "scenario", F.trim(F.col("agent_profiles")[0]["first_name"]).alias("first_name"),
                                             "relationship", "target_agent_idx")


@query("a03_archive", """SELECT 'tasks' AS bucket, 'v' || vec_id AS id, label AS iteration FROM embeddings""")
def _(spark, d):
    path = fresh_path(spark, "archive") + ".jsonl"
    table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("label").alias("iteration"),
                                         "embedding").write.json(path)
    return R.read_archive(spark, path).select("bucket", "id", "iteration")


@query("a05_completed_records", "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 4 <> 0")
def _(spark, d):
    path = fresh_path(spark, "bank")
    e = F.col("event_id")
    K.write_records(table(spark, d, "events").select(
        e.cast("string").alias("id"), F.when(e % 4 == 0, "in_progress").otherwise("completed").alias("status")), path)
    good, _ = R.read_bank(spark, path, multi_line=False)
    return good.select("id")


@query("a06_trajectory_pool", f"WITH {EPISODES} SELECT scenario, count(*) AS n, sum(goal) AS goals FROM ep GROUP BY 1")
def _(spark, d):
    pool = R.rows_to_pool(episodes(spark, d).select("scenario", F.col("attempt").alias("trial"), "goal"), "scenario")
    return pool.select("scenario", F.size("trajectories").cast("bigint").alias("n"), F.aggregate(
        "trajectories", F.lit(0.0), lambda s, t: s + t["goal"]).alias("goals"))


@query("a08_latest_snapshot", "SELECT vec_id, label FROM embeddings")
def _(spark, d):
    path = fresh_path(spark, "snapshots")
    e = table(spark, d, "embeddings").select("vec_id", "label")
    K.write_snapshot(e.where(F.col("vec_id") % 2 == 0), path, 1)
    K.write_snapshot(e, path, 2)
    return K.read_latest(spark, path)


@query("a09_csv_report", "SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path = fresh_path(spark, "csv")
    K.write_csv(S.counts_by(table(spark, d, "events"), F.col("event_type"), "source"), path)
    return spark.read.option("header", True).schema("source string, n bigint").csv(path)


@query("a10_quarantine", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'no_candidate' ELSE 'episode_error' END AS reason FROM events WHERE event_id % 9 = 0")
def _(spark, d):
    e = F.col("event_id")
    _, bad = K.split_quarantine(table(spark, d, "events"), e % 9 == 0, F.when(e % 2 == 0, "no_candidate").otherwise("episode_error"), ["event_id"])
    return bad


@query("a11_lineage_export", "SELECT vec_id AS id, vec_id // 3 AS parent_id, vec_id // 27 AS root_seed_env_pk, vec_id % 4 AS lineage_depth, 'lateral' AS mutation_operator, 'frontier' AS classification, 'generated' AS source FROM embeddings")
def _(spark, d):
    v = F.col("vec_id")
    arc = table(spark, d, "embeddings").select(
        v.alias("id"), F.floor(v / 3).alias("parent_id"), F.floor(v / 27).alias("root_seed_env_pk"), (v % 4).alias("lineage_depth"),
        F.lit("lateral").alias("mutation_operator"), F.lit("frontier").alias("classification"), F.lit("generated").alias("source"), "embedding")
    return K.lineage_export(arc)


@query("a13_embedding_cache", """WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0)
SELECT 'hit' AS part, count(*) AS n FROM documents WHERE text IN (SELECT text FROM c)
UNION ALL SELECT 'to_embed', count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM c)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where(F.col("doc_id") % 3 == 0).select(F.sha2("text", 256).alias("text_key"), hashed_embedding(F.col("text"), 4).alias("embedding")).dropDuplicates(["text_key"])
    hit, miss = K.cached_embeddings(docs, cache, "text")

    def n(df, part):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))

    return n(hit, "hit").unionByName(n(miss, "to_embed"))


@query("a14_reader_mart", f"""WITH {EPISODES}, s AS (SELECT scenario AS id, bool_or(goal >= 7) AS solved, count(*) AS n_attempts,
 CASE WHEN bool_or(attempt = 1 AND goal >= 7) THEN 'too_easy' WHEN max(goal) >= 3 THEN 'frontier' ELSE 'beyond_frontier' END AS c FROM ep GROUP BY 1)
SELECT id, CASE WHEN c = 'too_easy' THEN c WHEN c = 'frontier' AND solved THEN 'frontier_solved' WHEN c = 'frontier' THEN 'frontier_unsolved' ELSE 'beyond_frontier' END AS category, n_attempts FROM s""")
def _(spark, d):
    g = F.col("goal")
    a = F.struct(F.col("attempt").cast("int").alias("attempt"), F.struct("goal").alias("scores"), (g >= 7).alias("solved"))
    bank = episodes(spark, d).groupBy(F.col("scenario").alias("id")).agg(
        F.collect_list(a).alias("attempts"), F.when(F.bool_or((F.col("attempt") == 1) & (g >= 7)), "too_easy").when(
            F.max(g) >= 3, "frontier").otherwise("beyond_frontier").alias("classification"))
    mart = R.reader_mart(bank.withColumn("scenario_title", F.lit("")).withColumn("scenario", F.col("id")))
    return mart.select("id", "category", F.col("n_attempts").cast("bigint").alias("n_attempts"))


@query("a15_rebuilt_aggregates", f"""WITH {ATTEMPTS} SELECT source, count(*) AS n FROM a WHERE NOT error GROUP BY 1""")
def _(spark, d):
    path = fresh_path(spark, "aggregates")
    K.rebuild(S.counts_by(attempts(spark, d).where(~F.col("error")), F.col("source"), "source"), path)
    return spark.read.parquet(path)
