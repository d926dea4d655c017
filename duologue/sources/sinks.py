"""Sinks: record folders, snapshots, CSV reports, quarantine, caches. Spark's commit protocol makes a write all or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, status: str = "status") -> None:
    """Records as JSON lines in one folder for each status. Records written before stay; one written again under its id
    takes the place of the old one when they are read (``readers.read_bank``), whatever status it had."""
    stamped = df.withColumn("written_at", F.current_timestamp().cast("double"))
    stamped.write.mode("append").partitionBy(status).json(path)


def write_snapshot(df: DataFrame, path: str, iteration: int) -> None:
    """A snapshot for each iteration; writing one again replaces it. A pointer names the one written last."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot_iter={iteration}")
    df.sparkSession.range(1).select(F.lit(iteration).cast("bigint").alias("snapshot_iter")).coalesce(1).write.mode("overwrite").json(
        f"{path}/_latest")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that the pointer names; no other folder is looked at."""
    last = spark.read.schema("snapshot_iter bigint").json(f"{path}/_latest").head()[0]
    return spark.read.parquet(f"{path}/snapshot_iter={last}")


def write_csv(df: DataFrame, path: str) -> None:
    """Result table with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def split_quarantine(df: DataFrame, bad: Column, reason: Column, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A10: (good rows, quarantined rows with their reason). An unknown flag counts as good."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag).select(*keep, reason.alias("reason"))


def lineage_export(archive: DataFrame) -> DataFrame:
    """Id with its lineage pointers."""
    return archive.select("id", "parent_id", "root_seed_env_pk", "lineage_depth", "mutation_operator", "classification", "source")


def cached_embeddings(rows: DataFrame, cache: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached vector, texts still to embed). The key is the digest of the text."""
    keyed = rows.withColumn("text_key", F.sha2(F.col(text), 256))
    c = cache.select("text_key", "embedding")
    return keyed.join(c, "text_key", "inner"), keyed.join(c, "text_key", "left_anti").select("text_key", text).dropDuplicates(["text_key"])


def rebuild(df: DataFrame, path: str) -> None:
    """Aggregates are rebuilt from the records and replaced as a whole."""
    df.write.mode("overwrite").parquet(path)
