"""Ordered computations; see scale.py for how the order axis is split over tasks."""

from __future__ import annotations

from itertools import count

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.operators.scale import near_rows, rank_rows, running_sums
from duologue.operators.summaries import wilson
from duologue.session import cut, fresh_path


def sliding_share(series: DataFrame, order: str, hit: Column, width: int = 21) -> DataFrame:
    """centred sliding share with its Wilson band; the frame is cut at both ends."""
    half = width // 2
    ranked = rank_rows(series.select(F.col(order), hit.cast("int").alias("__y")), [], [F.col(order)], F.col(order), "i")
    w = near_rows(ranked, [], "i", half, half, {"k": lambda w: F.sum("__y").over(w), "n": lambda w: F.count("__y").over(w)})
    p, lo, hi = wilson(F.col("k"), F.col("n"))
    return w.select("i", p.alias("mean"), lo.alias("lo"), hi.alias("hi"))


def window_slope(values: Column) -> Column:
    """mean of the second half minus mean of the first half; fewer than four values give 0."""
    n = F.size(values)
    mid = F.floor(n / 2).cast("int")

    def mean(a: Column, k: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / k

    return F.when(n < 4, F.lit(0.0)).otherwise(
        mean(F.slice(values, mid + 1, n - mid), n - mid) - mean(F.slice(values, F.lit(1), mid), mid))


def learning_slope(df: DataFrame, kind: str, order: Sequence[Column], split: Column, value: Column,
                   width: int = 10) -> DataFrame:
    """slope over the last ``width`` values of each type, after every record."""
    key = F.coalesce(F.nullif(F.col(kind).cast("string"), F.lit("")), F.lit("_default"))
    base = df.withColumn("__k", key).withColumn("__v", value)
    ranked = rank_rows(base, ["__k"], order, split, "i")
    out = near_rows(ranked, ["__k"], "i", width - 1, 0, {"__w": lambda w: F.collect_list("__v").over(w)})
    return out.withColumn("slope", window_slope(F.col("__w"))).drop("__w", "__v", "__k")


def recency_weight(rows: DataFrame, choices: DataFrame, key: str, now: int | Column) -> DataFrame:
    """a new row starts at 1 and gains 1 each step; a chosen row restarts at 0.

    No loop is needed: the weight is the number of steps since the last choice.
    """
    last = choices.groupBy(key).agg(F.max("step").alias("__last"))
    now = now if isinstance(now, Column) else F.lit(now)
    return rows.join(last, key, "left").select(
        key, F.when(F.col("__last").isNotNull(), now - F.col("__last")).otherwise(1 + now - F.col("added")).alias("weight"))


def running_counters(steps: DataFrame, order: str, counters: dict[str, Column]) -> DataFrame:
    """counters after each step."""
    return running_sums(steps, [], [F.col(order)], {n: c.cast("bigint") for n, c in counters.items()}, F.col(order))


def half_means(series: DataFrame, order: str, value: Column) -> DataFrame:
    """means of the first n div 2 rows and of the rest."""
    ranked = rank_rows(series.select(F.col(order), value.cast("double").alias("__v")), [], [F.col(order)], F.col(order), "i")
    n = series.agg(F.count(F.lit(1)).alias("__n"))  # one row
    early = F.col("i") <= F.floor(F.col("__n") / 2)
    return ranked.crossJoin(F.broadcast(n)).agg(
        F.avg(F.when(early, F.col("__v"))).alias("first_half"), F.avg(F.when(~early, F.col("__v"))).alias("second_half"))


def child_priors(children: DataFrame, roots: DataFrame, mass: float = 4.0) -> DataFrame:
    """prior of each child = its parent's posterior before the child's own outcome, capped in mass.

    children(id, parent, iteration, alpha, beta), roots(id, prior_alpha, prior_beta). The votes of earlier
    siblings do not depend on priors, so they come from one prefix sum; priors then follow one depth at a
    time. Each depth is written into one folder, which is read as one table at the end.
    """
    before = running_sums(children, ["parent"], [F.col("iteration"), F.col("id")],
                          {"a0": F.col("alpha"), "b0": F.col("beta")}, F.col("iteration"), inclusive=False, then=F.col("id"))
    before = cut(before.select("id", "parent", "a0", "b0"))
    level = roots.select("id", F.col("prior_alpha").cast("double"), F.col("prior_beta").cast("double"))
    folder = fresh_path(before.sparkSession, "priors")
    for depth in count():
        p = level.select(F.col("id").alias("parent"), F.col("prior_alpha").alias("pa"), F.col("prior_beta").alias("pb"))
        a, b = F.col("pa") + F.col("a0"), F.col("pb") + F.col("b0")
        m = a + b
        scale = F.when((F.lit(mass) > 0) & (m > mass), F.lit(mass) / m).otherwise(F.lit(1.0))
        next_ = before.join(p, "parent").select("id", (a * scale).alias("prior_alpha"), (b * scale).alias("prior_beta"))
        next_.write.parquet(f"{folder}/depth={depth}")
        level = before.sparkSession.read.schema(next_.schema).parquet(f"{folder}/depth={depth}")
        if level.isEmpty():
            return before.sparkSession.read.schema(next_.schema).parquet(folder).select("id", "prior_alpha", "prior_beta")
