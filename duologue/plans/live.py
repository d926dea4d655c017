"""Section N: the driver tables as file streams; each result equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import rules
from duologue.plans.frames import ATTEMPTS, attempts, table
from duologue.plans.registry import query
from duologue.plans.summaries import CHILDREN, children
from duologue.streaming import jobs as S


def _stream(spark, d, name="events"):
    return S.file_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema)


class _Streamed:
    """Lets the stand-in frames read a stream instead of a table."""

    def __init__(self, spark):
        self._spark = spark
        self.read = self

    def parquet(self, path):
        return S.file_stream(self._spark, path, self._spark.read.parquet(path).schema)


@query("s01_latest_versions", """WITH v AS (SELECT user_id AS id, event_id AS version, value, CASE WHEN event_id % 4 = 0 THEN 'in_progress' ELSE 'completed' END AS status FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM v) SELECT id, version, value, status FROM r WHERE rn = 1 AND status <> 'in_progress'""")
def _(spark, d):
    v = _stream(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value",
                                 F.when(F.col("event_id") % 4 == 0, "in_progress").otherwise("completed").alias("status"))
    return S.completed_only(S.latest_versions(v, "id", "version"))


@query("s02_rolling_summary", f"""WITH {ATTEMPTS} SELECT source, count(*) AS total, count(*) FILTER (error) AS errors,
 count(*) FILTER (NOT error AND goal >= 7 AND relationship >= 0 AND judge) AS passed FROM a GROUP BY 1""")
def _(spark, d):
    a = attempts(_Streamed(spark), d)
    return S.last_batch(S.run_to_table(S.rolling_summary(a, "source", rules.success("goal_rel_judge"), F.col("error")), "complete"))


@query("s03_bounded_slope", f"""WITH {ATTEMPTS}, r AS (SELECT task, goal, event_id, row_number() OVER (PARTITION BY task ORDER BY event_id DESC) AS rn FROM a),
w AS (SELECT task, list(goal ORDER BY event_id) AS x FROM r WHERE rn <= 10 GROUP BY 1)
SELECT CAST(task AS VARCHAR) AS key, len(x) AS n, CASE WHEN len(x) < 4 THEN 0 ELSE list_avg(x[len(x) // 2 + 1:]) - list_avg(x[:len(x) // 2]) END AS slope FROM w""")
def _(spark, d):
    a = attempts(spark, d).select("task", "event_id", "goal")
    parts = [a.where(F.col("event_id") % 3 == k) for k in range(3)]
    slopes = S.fed(parts, lambda stream, out, checkpoint: S.stateful(S.bounded_slope(stream, "task", "event_id", "goal"), out, checkpoint))
    return S.last_value(slopes, ["key"])


_NEAR = "list_cosine_similarity(q.e, v.e)"


@query("s04_admission", f"""WITH u AS MATERIALIZED (SELECT vec_id AS id, vec_id % 4 AS b, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS MATERIALIZED (SELECT q.id, v.id AS nid FROM u q JOIN u v ON v.b < q.b WHERE {_NEAR} > 0.3),
a0 AS (SELECT id FROM u WHERE b = 0),
a1 AS (SELECT id FROM a0 UNION ALL SELECT id FROM u WHERE b = 1 AND id NOT IN (SELECT p.id FROM p JOIN a0 ON a0.id = nid)),
a2 AS (SELECT id FROM a1 UNION ALL SELECT id FROM u WHERE b = 2 AND id NOT IN (SELECT p.id FROM p JOIN a1 ON a1.id = nid)),
a3 AS (SELECT id FROM a2 UNION ALL SELECT id FROM u WHERE b = 3 AND id NOT IN (SELECT p.id FROM p JOIN a2 ON a2.id = nid)),
w AS (SELECT q.id, round(greatest(coalesce(max({_NEAR}), 0), 0), 6) AS within_batch_dupe FROM u q LEFT JOIN u v ON v.id < q.id AND v.b = q.b GROUP BY 1)
SELECT id, id IN (SELECT id FROM a3) AS admitted, within_batch_dupe FROM w""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    log = S.fed([e.where(F.col("vec_id") % 4 == k) for k in range(4)],
                lambda stream, out, checkpoint: S.admit(stream, "vec_id", "embedding", 0.3, "vec_id", out, checkpoint))
    return log.select("id", "admitted", F.round("within_batch_dupe", 6).alias("within_batch_dupe"))


@query("s05_posterior_stream", f"WITH {CHILDREN} SELECT anchor, sum(alpha) AS alpha_votes, sum(beta) AS beta_votes, count(*) AS n_selected FROM cv GROUP BY 1")
def _(spark, d):
    return S.last_batch(S.run_to_table(S.posterior_stream(children(_Streamed(spark), d)), "complete"))


@query("s06_every_n_rows", """WITH c AS (SELECT event_id % 4 AS batch, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT batch, n, sum(n) OVER (ORDER BY batch) AS total FROM c) SELECT total, total // 700 > (total - n) // 700 AS fired FROM t""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id")
    ticks = S.fed([e.where(F.col("event_id") % 4 == k) for k in range(4)],
                  lambda stream, out, checkpoint: S.every_n_rows(stream, 700, lambda total: None, out, checkpoint))
    return ticks.select("total", "fired")


def _in_order(spark, d, repeats: bool = False):
    """events in four parts by event time; with ``repeats`` some rows of each part come again in the next."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    quarter = F.least(F.floor(F.dayofmonth("ts") / 8), F.lit(3))
    for k in range(4):
        part = e.where(quarter == k)
        yield part.unionByName(e.where((quarter == k - 1) & (F.col("event_id") % 10 == 0))) if repeats and k else part


def _appended(work):
    return lambda stream, out, checkpoint: S.run_to_table(work(stream), "append", None, out, checkpoint)


@query("sx_01_tumbling_windows", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents
FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, d):
    w = S.fed(_in_order(spark, d), _appended(lambda e: S.tumbling(
        e, "ts", "1 hour", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))))
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "cents")


@query("sx_02_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, d):
    w = S.fed(_in_order(spark, d), _appended(lambda e: S.sessions(e, "ts", "6 hours", "1 hour", ["user_id"], F.count(F.lit(1)).alias("n"))))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("sx_03_repeats_within_watermark", "SELECT event_id, user_id FROM events")
def _(spark, d):
    return S.fed(_in_order(spark, d, True), _appended(lambda e: S.without_repeats(e, "ts", "1 hour", ["event_id"]))).select("event_id", "user_id")
