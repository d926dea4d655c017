"""Section H over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.operators.spaces import pooled_texts
from duologue.plans.frames import table
from duologue.plans.registry import query


@query("h01_pooled_texts", """WITH p AS (SELECT 'docs' AS archive, doc_id AS id, md5(text) AS h FROM documents
 UNION ALL SELECT 'bench', item_id, md5(text) FROM benchmark),
u AS (SELECT h, first(archive ORDER BY archive, id) AS unique_archive, first(id ORDER BY archive, id) AS unique_id FROM p GROUP BY 1)
SELECT archive, id, unique_archive, unique_id FROM p JOIN u USING (h)""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("h"))
    _, mapped = pooled_texts({"docs": docs, "bench": bench}, "h")
    return mapped.select("archive", "id", "unique_archive", "unique_id")


@query("h02_union_of_methods", """SELECT 'a' AS method, vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE label % 2 = 0
UNION ALL SELECT 'b', vec_id, CAST(embedding[1] AS DOUBLE) FROM embeddings WHERE label % 2 = 1""")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("x", F.col("embedding")[0].cast("double"))
    a, b = (e.where(F.col("label") % 2 == m).select(F.lit(n).alias("method"), "vec_id", "x") for m, n in ((0, "a"), (1, "b")))
    return a.unionByName(b)


@query("h03_id_sets", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'first_only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def _(spark, d):
    o = table(spark, d, "orders")
    a = o.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("k"))
    b = o.where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_custkey").alias("k"))

    def n(df, part):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))

    return n(a.intersect(b), "both").unionByName(n(a.union(b).distinct(), "either")).unionByName(n(a.subtract(b), "first_only"))


@query("h04_existing_types", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("source") != "").select("source").distinct()
