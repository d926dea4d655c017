"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duologue.llm import chat, classifier, collision, divergence, impact, language, licences, maincontent, neardup, packing, resampling, segments, suffixes
from duologue.llm.common import table
from duologue.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op2_harmonic_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"),
                        added=packing.added_tokens(packing.vocabulary("byte_bpe_50k.json")))


@query("op9_co_training")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return classifier.classify(docs, table(spark, sf_dir, "labels")).drop("text", "source", "lang")


@query("op3_signature_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)


@query("op6_deep_shallow_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_collision_counting")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op8_impact_ordered", sql="""
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op10_elias_fano_trie")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.scores(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op1_licence_sentences", sql=licences.scan_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_minimum_cut")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op5_gumbel_segmentations")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmentations(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_source_divergence", sql=divergence.audit_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op11_offset_masks", sql=chat.digests_sql(" UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in CONTROL_TURNS)))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(extra)))


@query("op12_importance_resampling", sql=resampling.resample_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
