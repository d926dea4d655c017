"""Similarity parts of section D, E18, G8 and J7 over the driver tables.

Similarities are rounded to 6 places before comparing, ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.functions.vectors import cosine, hashed_embedding
from duologue.operators import similarity as V
from duologue.plans.frames import ARCHIVE, archive, table
from duologue.plans.registry import query

_P = f"""WITH {ARCHIVE},
u AS (SELECT id, iteration, source_id, perspective, niche, method, e, sqrt(list_dot_product(e, e)) AS nm FROM arc)"""
_SIM = "list_dot_product(q.e, v.e) / (q.nm * v.nm)"


@query("d10_top_k_neighbours", _P + f""", p AS (SELECT q.id, v.id AS nid, {_SIM} AS sim FROM u q JOIN u v ON v.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, nid) AS rank FROM p)
SELECT id, rank, nid, round(sim, 6) AS sim FROM r WHERE rank <= 5""")
def _(spark, d):
    v = V.vectors(archive(spark, d), "id", "embedding")
    return V.top_k(v, v, 5, V.Rule(not_self=True)).select("id", "rank", "nid", F.round("sim", 6).alias("sim"))


@query("d10_inferred_parents", _P + f""", p AS (SELECT q.id, v.id AS nid, v.iteration AS nord, {_SIM} AS sim FROM u q JOIN u v
 ON v.iteration < q.iteration AND v.id <> q.id WHERE q.iteration >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, nord, nid) AS rank FROM p)
SELECT id, rank, nid, round(sim, 6) AS sim FROM r WHERE rank <= 3""")
def _(spark, d):
    v = V.vectors(archive(spark, d), "id", "embedding", order=F.col("iteration"))
    return V.top_k(v.where(F.col("ord") >= 0), v, 3, V.Rule(not_self=True, earlier=True)).select(
        "id", "rank", "nid", F.round("sim", 6).alias("sim"))


@query("d11_retrieve_one_perspective", _P + f""", one AS (SELECT coalesce(max(id) FILTER (perspective = 1), min(id)) AS id FROM u GROUP BY source_id),
c AS (SELECT u.* FROM u JOIN one USING (id)), p AS (SELECT q.id, v.id AS nid, {_SIM} AS sim FROM u q JOIN c v ON TRUE),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, nid) AS rank FROM p)
SELECT id, rank, nid, round(sim, 6) AS sim FROM r WHERE rank <= 5""")
def _(spark, d):
    a = archive(spark, d)
    return V.retrieve_one_perspective(a, a, 5, 1).select("id", "rank", "nid", F.round("sim", 6).alias("sim"))


@query("d12_other_lineage_neighbours", _P + f""", c AS (SELECT q.id, v.source_id, coalesce(max(v.id) FILTER (v.perspective = q.perspective), min(v.id)) AS nid
 FROM u q JOIN u v ON v.id // 9 <> q.id // 9 AND v.source_id <> q.source_id GROUP BY 1, 2),
p AS (SELECT c.id, c.nid, {_SIM} AS sim FROM c JOIN u q ON q.id = c.id JOIN u v ON v.id = c.nid),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, nid) AS rank FROM p)
SELECT id, rank, nid, round(sim, 6) AS sim FROM r WHERE rank <= 4 UNION ALL SELECT id, 0, id, 1.0 FROM u""")
def _(spark, d):
    return V.neighbours_other_lineage(archive(spark, d), 5, "id", "embedding", F.floor(F.col("id") / 9), F.col("source_id"), F.col("perspective")).select(
        "id", "rank", "nid", F.round("sim", 6).alias("sim"))


_SEM = _P + f""", p AS (SELECT q.id, v.id AS nid, {_SIM} AS sim FROM u q JOIN u v ON v.method = 0
 WHERE q.method <> 0 AND {_SIM} > 0.3)"""


def _sides(spark, d):
    a = archive(spark, d)
    return (V.vectors(a.where(F.col("method") != 0), "id", "embedding"),
            V.vectors(a.where(F.col("method") == 0), "id", "embedding"))


@query("d14_semantic_overlaps", _SEM + " SELECT id, nid, round(sim, 6) AS sim FROM p")
def _(spark, d):
    return V.above(*_sides(spark, d), 0.3, expand=True).select("id", "nid", F.round("sim", 6).alias("sim"))


@query("d14_contamination", _SEM + """, e AS (SELECT count(DISTINCT a.source_id) AS n FROM u a JOIN u b ON b.source_id = a.source_id WHERE a.method <> 0 AND b.method = 0)
 SELECT (SELECT n FROM e) AS n_exact, count(*) AS n_semantic, 0.3 AS threshold, (SELECT n FROM e) > 0 OR count(*) > 0 AS contaminated FROM p""")
def _(spark, d):
    q, c = _sides(spark, d)
    sources = archive(spark, d).select("source_id", "method")  # the two perspectives of a source may fall on both sides
    exact = sources.where("method <> 0").select("source_id").distinct().join(sources.where("method = 0"), "source_id", "left_semi")
    return V.contamination_summary(exact, V.counted(q, c, 0.3), 0.3)


@query("d15_near_duplicates", _SEM + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, nid) AS rn FROM p)
SELECT id, nid, round(sim, 6) AS sim FROM r WHERE rn = 1""")
def _(spark, d):
    return V.duplicates(*_sides(spark, d), 0.3).select("id", "nid", F.round("sim", 6).alias("sim"))


@query("d16_within_batch", _P + f""" SELECT q.id, round(greatest(coalesce(max({_SIM}), 0), 0), 6) AS within_batch_dupe
FROM u q LEFT JOIN u v ON v.id < q.id GROUP BY 1""")
def _(spark, d):
    v = V.vectors(archive(spark, d), "id", "embedding", order=F.col("id"))
    return V.batch_duplicates(v).select("id", F.round("within_batch_dupe", 6).alias("within_batch_dupe"))


@query("d17_nearest_seed_distance", _P + f""" SELECT q.id, round(1 - max({_SIM}), 6) AS distance FROM u q JOIN u v ON v.iteration < 0
WHERE q.iteration >= 0 GROUP BY 1""")
def _(spark, d):
    a = archive(spark, d)
    gen, seeds = (V.vectors(a.where(c), "id", "embedding") for c in (F.col("iteration") >= 0, F.col("iteration") < 0))
    return V.nearest_distance(gen, seeds).select("id", F.round("distance", 6).alias("distance"))


@query("d17_self_distance", _P + f""" SELECT q.id, round(1 - max({_SIM}), 6) AS distance FROM u q JOIN u v ON v.id <> q.id GROUP BY 1""")
def _(spark, d):
    v = V.vectors(archive(spark, d), "id", "embedding")
    return V.nearest_distance(v, v, True).select("id", F.round("distance", 6).alias("distance"))


@query("d21_target_side", _P + f""", j AS (SELECT q.id, q.id % 4 = 0 AS generated, {_SIM} AS s0, list_dot_product(q.e, w.e) / (q.nm * w.nm) AS s1
 FROM u q JOIN u v ON v.id = q.id // 2 JOIN u w ON w.id = q.id // 3)
SELECT id, CASE WHEN generated OR s0 >= s1 THEN 0 ELSE 1 END AS target FROM j""")
def _(spark, d):
    a = archive(spark, d).select("id", F.col("embedding").alias("e"))
    j = a.withColumn("k0", F.floor(F.col("id") / 2)).withColumn("k1", F.floor(F.col("id") / 3))
    j = j.join(a.select(F.col("id").alias("k0"), F.col("e").alias("e0")), "k0").join(
        a.select(F.col("id").alias("k1"), F.col("e").alias("e1")), "k1")
    return V.target_side(j, "e", "e0", "e1", F.col("id") % 4 == 0).select("id", "target")


@query("e18_mean_pairwise_distance", _P + f""" SELECT q.niche, any_value(c.n) AS n, avg(1 - {_SIM}) AS mean_distance FROM u q
 JOIN u v ON v.niche = q.niche AND v.id <> q.id JOIN (SELECT niche, count(*) AS n FROM u GROUP BY 1) c ON c.niche = q.niche GROUP BY 1""")
def _(spark, d):
    return V.mean_pairwise_distance(archive(spark, d), ["niche"], "embedding")


@query("g08_top_overlaps", _SEM + " SELECT id, nid, round(sim, 6) AS sim FROM p ORDER BY sim DESC, id, nid LIMIT 10")
def _(spark, d):
    return V.closest_pairs(*_sides(spark, d), 10, 0.3).select("id", "nid", F.round("sim", 6).alias("sim"))


@query("j07_repeated_sources", """SELECT user_id AS trial, event_id % 50 AS source, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("trial"), (F.col("event_id") % 50).alias("source"))
    return V.repeated_sources(t, "trial", "source")


@query("i01_cosine_conventions", _P + """ SELECT q.id, round(list_dot_product(q.e, v.e) / (q.nm * v.nm), 6) AS plain,
 round(list_dot_product(q.e, v.e) / (q.nm * v.nm + 1e-9), 6) AS eps FROM u q JOIN u v ON v.id = q.id // 2""")
def _(spark, d):
    a = archive(spark, d).select("id", F.col("embedding").alias("e"))
    j = a.withColumn("k", F.floor(F.col("id") / 2)).join(a.select(F.col("id").alias("k"), F.col("e").alias("f")), "k")
    return j.select("id", F.round(cosine(F.col("e"), F.col("f")), 6).alias("plain"),
                    F.round(cosine(F.col("e"), F.col("f"), "epsilon"), 6).alias("eps"))


@query("u05_hashed_embedding", r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\W+')) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM w WHERE w <> ''),
c AS (SELECT doc_id, h % 16 AS i, sum(CASE WHEN (h >> 24) & 1 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY 1, 2),
g AS (SELECT d.doc_id, CAST(r.i AS INTEGER) AS i, coalesce(c.s, 0) AS s FROM documents d, range(16) r(i) LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = r.i),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS norm FROM g GROUP BY 1)
SELECT doc_id, i, round(CASE WHEN norm = 0 THEN 0 ELSE s / norm END, 6) + 0.0 AS value FROM g JOIN n USING (doc_id)""")
def _(spark, d):
    e = table(spark, d, "documents").select("doc_id", F.posexplode(hashed_embedding(F.col("text"), 16)).alias("i", "value"))
    return e.withColumn("value", F.round("value", 6) + 0.0)
