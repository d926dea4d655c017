"""Sort, limit and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.operators.scale import rank_rows, top_rows


def sample_outcomes(df: DataFrame, category: str, passed: Column, order: str, n_fail: int = 5, n_pass: int = 3) -> DataFrame:
    """G1: first failed and first passed records of each category."""
    flagged = df.withColumn("passed", passed)
    t = top_rows(flagged, [category, "passed"], [F.col(order)], max(n_fail, n_pass))
    return t.where(F.col("rn") <= F.when(F.col("passed"), n_pass).otherwise(n_fail))


def representative(df: DataFrame, group: Column, name: str, id_col: str, score: str) -> DataFrame:
    """The record with the lowest score of each group."""
    return df.groupBy(group.alias(name)).agg(F.min_by(F.struct(id_col, score), F.struct(score, id_col)).alias("__v")).select(
        name, "__v.*")


def top_labels(df: DataFrame, label: Column, k: int, other: str = "other") -> DataFrame:
    """Keep the k most frequent labels, the rest become one; k labels are a bounded list."""
    base = df.withColumn("label", label)
    keep = base.groupBy("label").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "label").limit(k)
    keep = keep.select("label", F.lit(True).alias("__keep"))
    return base.join(F.broadcast(keep), "label", "left").withColumn(
        "label", F.when(F.col("__keep"), F.col("label")).otherwise(other)).drop("__keep")


def newest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Newest n rows."""
    return df.orderBy(*order).limit(n)


def equal_sizes(rows: DataFrame, method: str, iteration: str = "iteration", id_col: str = "id") -> DataFrame:
    """Cut every method to the smallest one; seeds (iteration < 0) stay first, then by iteration."""
    ranked = rank_rows(rows, [method], [F.col(iteration), F.col(id_col)], F.col(iteration), "rn", then=F.col(id_col))
    smallest = rows.groupBy(method).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("__n"))  # one row
    return ranked.crossJoin(F.broadcast(smallest)).where(F.col("rn") <= F.col("__n")).drop("__n")


def rank_candidates(cands: DataFrame, scores: DataFrame, slot: str, pos: str) -> DataFrame:
    """By score, highest first; a missing score is 0, equal scores keep the input order.

    A slot with any failed score keeps the input order.
    """
    j = cands.join(scores, [slot, pos], "left")
    bad = j.groupBy(slot).agg(F.bool_or(F.coalesce("error", F.lit(False))).alias("__bad"))
    j = j.join(bad, slot).withColumn("__s", F.when(F.col("__bad"), F.lit(0.0)).otherwise(-F.coalesce("score", F.lit(0.0))))
    return rank_rows(j, [slot], [F.col("__s"), F.col(pos)], F.col("__s"), "place", then=F.col(pos)).drop("__s", "__bad")


def relevant_in_order(entries: DataFrame, by: Sequence[str], score: str, pos: str, k: int) -> DataFrame:
    """The k most relevant entries, to be read in their original order (``place``)."""
    best = top_rows(entries, by, [F.desc(score), F.col(pos)], k, "relevance_rank")
    # At most k rows for each group are left.
    return top_rows(best, by, [F.col(pos)], k, "place")


def custom_order(col: Column, order: Sequence[str]) -> Column:
    """Position in a given order, unknown values last."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), col)
    return F.when(pos > 0, pos - 1).otherwise(len(order)).cast("int")
