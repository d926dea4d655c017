"""From raw documents to packed training sequences: quality filter, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its result is written as Parquet and
read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm import classifier, neardup, packing, suffixes
from duologue.llm.common import fresh_path
from duologue.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject as low in quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.classify(docs.select(COLUMNS), labels).where("keep").select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    groups = neardup.near_duplicates(docs, words=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches of 100 bytes and more that occur earlier; what nothing is left of goes."""
    kept = suffixes.remove_repeats(docs, with_text=True, carry=("lang", "source"))
    left = kept.where((F.col("n_removed") == 0) | (F.trim(F.translate("kept", "\n\r\t", "   ")) != ""))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece."""
    return packing.pack(docs, added=packing.added_tokens(packing.vocabulary("byte_bpe_50k.json")))


STAGES = [("quality classifier", good_documents), ("n-gram Jaccard join", without_near_duplicates),
          ("suffix-array dedup", without_repeats), ("packing", packed)]

#: The classifier and the suffix stage cannot be stated in SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
