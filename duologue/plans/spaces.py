"""E16, E17, F8, K1, K2 over the driver tables; the grid queries use two given axes, so SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators import spaces as X
from duologue.plans.frames import ARCHIVE, archive
from duologue.plans.registry import query
from duologue.session import fresh_path

_XY = """WITH p AS (SELECT vec_id AS id, vec_id // 10 AS iteration, label % 3 AS method, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
c AS (SELECT p.*, greatest(0, least(9, floor((x - x0) / (x1 - x0) * 10))) AS cx, greatest(0, least(9, floor((y - y0) / (y1 - y0) * 10))) AS cy FROM p, l)"""


def _xy(spark, d):
    return archive(spark, d).select("id", F.floor(F.col("id") / 10).alias("iteration"), "method",
                                    F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("e16_cell_coverage", _XY + " SELECT count(DISTINCT (cx, cy)) AS n_cells, count(*) AS n_rows, count(DISTINCT (cx, cy)) / 100 AS coverage FROM c")
def _(spark, d):
    return X.coverage(_xy(spark, d), 10)


@query("e17_occupancy", _XY + " SELECT method, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, count(*) AS n, least(count(*), 10) AS shown FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    return X.occupancy(_xy(spark, d), 10, "method")


@query("e17_coverage_by_method", _XY + " SELECT method, count(DISTINCT (cx, cy)) AS n_cells, count(*) AS n_rows, count(DISTINCT (cx, cy)) / 100 AS coverage FROM c GROUP BY 1")
def _(spark, d):
    return X.coverage(_xy(spark, d), 10, ["method"])


@query("f08_coverage_growth", _XY + """, f AS (SELECT cx, cy, min(iteration) AS iteration FROM c GROUP BY 1, 2),
n AS (SELECT iteration, count(*) AS k FROM f GROUP BY 1), s AS (SELECT iteration, count(*) AS m FROM p GROUP BY 1)
SELECT s.iteration, sum(m) OVER w AS archive_size, sum(coalesce(k, 0)) OVER w / 100 AS coverage FROM s LEFT JOIN n USING (iteration)
WINDOW w AS (ORDER BY s.iteration ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return X.coverage_growth(_xy(spark, d), "iteration", 10)


@query("k01_pca_coverage")
def _(spark, d):
    return X.coverage(X.project(archive(spark, d), "embedding", ["id", "method"]), 10, ["method"])


@query("k01_explained_variance")
def _(spark, d):
    return X.explained_variance(archive(spark, d), "embedding")


@query("k02_niches")
def _(spark, d):
    return X.niches(archive(spark, d), "id", "embedding").groupBy("niche").agg(F.count(F.lit(1)).alias("n"))


_DIST = "list_distance(a.e, f.c)"


@query("k02_managed", f"""WITH {ARCHIVE}, f AS (SELECT id AS niche, e AS c FROM arc WHERE id < 8),
a0 AS (SELECT a.id, arg_min(f.niche, {_DIST}) AS niche FROM arc a, f WHERE a.id % 2 = 0 GROUP BY 1),
m AS (SELECT a0.niche, i, avg(e[i]) AS x FROM a0 JOIN arc USING (id), range(1, 65) r(i) GROUP BY ALL),
n AS (SELECT niche, list(x ORDER BY i) AS c FROM m GROUP BY 1),
g AS (SELECT f.niche, coalesce(n.c, f.c) AS c FROM f LEFT JOIN n USING (niche)),
a1 AS (SELECT a.id, arg_min(f.niche, {_DIST}) AS niche FROM arc a, g f WHERE a.id % 2 = 1 GROUP BY 1)
SELECT id, niche FROM a0 UNION ALL SELECT id, niche FROM a1""")
def _(spark, d):
    a = archive(spark, d)
    first = [r.embedding for r in a.where("id < 8").orderBy("id").select("embedding").collect()]
    manager = X.NicheManager(spark, fresh_path(spark, "niches"), first)
    for k in range(2):  # the first batch moves the centroids before the second comes
        manager.assign(a.where(F.col("id") % 2 == k), "id", "embedding")
    return manager.rows().select("id", "niche")
