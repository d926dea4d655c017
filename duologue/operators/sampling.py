"""Seeded sampling and selection. Draws depend on the seed and the row key only, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.functions.draws import beta_draws_udf
from duologue.functions.vectors import dot, unit
from duologue.operators.scale import rank_rows


def draw_key(seed: int | str, *keys: Column) -> Column:
    """Hex digest that orders rows at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def digest_number(digest: Column) -> Column:
    """First 32 bits of a digest."""
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def uniform(digest: Column) -> Column:
    """Uniform number strictly inside (0, 1)."""
    return (digest_number(digest) + 0.5) / F.lit(4294967296.0)


def exact_sample(df: DataFrame, key: str, n: int, seed: int | None) -> DataFrame:
    """Exactly n rows without replacement; without a seed the first n."""
    order = [F.col(key)] if seed is None else [draw_key(seed, F.col(key)), F.col(key)]
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, key: str, seed: int | str, out: str = "rn") -> DataFrame:
    """1-based position in a seeded shuffle."""
    d = df.withColumn("__d", draw_key(seed, F.col(key)))
    return rank_rows(d, [], [F.col("__d"), F.col(key)], digest_number(F.col("__d")), out).drop("__d")


def folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Shuffle, then stride."""
    return shuffled(df, key, seed).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def chunks(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Random chunks of near-equal size, at most k rows each."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))  # one row
    size = F.ceil(F.col("__n") / F.ceil(F.col("__n") / k))
    return shuffled(df, key, seed).crossJoin(F.broadcast(n)).withColumn(
        "chunk", F.floor((F.col("rn") - 1) / size).cast("bigint")).drop("rn", "__n")


def weighted_sample(df: DataFrame, key: str, weight: Column, k: int, seed: int) -> DataFrame:
    """K rows without replacement with chance by weight: smallest -ln(u) / w."""
    e = -F.ln(uniform(draw_key(seed, F.col(key)))) / weight
    return df.where(weight > 0).withColumn("__e", e).orderBy("__e", key).limit(k).drop("__e")


def farthest_points(df: DataFrame, key: str, vec: str, k: int, start: int) -> DataFrame:
    """Greedy farthest points by cosine from a start row, for small k.

    One pass a round; only the picked vectors (k of them) are held by the driver.
    """
    rows = df.select(F.col(key).alias("id"), unit(F.col(vec)).alias("vec"))
    first = rows.where(F.col("id") == start).head()
    picked = [first] if first else []
    while picked and len(picked) < k:
        sims = [dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in p["vec"]])) for p in picked]
        nearest = F.greatest(*sims) if len(sims) > 1 else sims[0]
        best = rows.where(~F.col("id").isin([p["id"] for p in picked])).agg(
            F.min_by(F.struct("id", "vec"), F.struct(F.round(nearest, 9), F.col("id"))).alias("b")).head()["b"]
        if best is None:
            break
        picked.append(best)
    return df.sparkSession.createDataFrame([(p["id"], i) for i, p in enumerate(picked)], "id bigint, place int")


def thompson(arms: DataFrame, key: str, alpha: Column, beta: Column, rounds: int, seed: int) -> DataFrame:
    """For each round draw a Beta value for every arm and take the largest."""
    draws = arms.select(F.col(key), beta_draws_udf(rounds)(alpha, F.greatest(beta, F.lit(1e-9)), F.xxhash64(
        F.lit(seed), F.col(key))).alias("d"))
    return draws.select(key, F.posexplode("d").alias("round", "draw")).groupBy("round").agg(
        F.max_by(F.struct(key, "draw"), F.struct(F.col("draw"), -F.col(key))).alias("b")).select("round", "b.*")


def uniform_choice(arms: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """J6 baseline: every arm is equally likely in each round."""
    r = arms.select(F.col(key), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    d = draw_key(seed, F.col("round"), F.col(key))
    return r.groupBy("round").agg(F.min_by(key, F.struct(d, F.col(key))).alias(key))
