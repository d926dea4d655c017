"""Permutation tests whose work is spread over blocks of rows.

A random relabelling picks m of the N values. Drawing first how many fall in each block and then which
ones inside it gives the same law. The counts come from halving the blocks again and again with a
hypergeometric draw at each node, seeded by the node: a block follows the log2(blocks) draws on its own
path, so blocks agree without talking and only their sums travel.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.operators.scale import rank_rows

BLOCK = 10_000


def hypergeometric(rng: np.random.Generator, left: int, right: int, take: int) -> int:
    """How many of ``take`` draws fall on the left side. Beyond the generator's range the law is summed outwards from its
    mode, by the ratios of neighbouring probabilities, until they no longer count."""
    if left + right < 1_000_000_000:
        return int(rng.hypergeometric(left, right, take))
    lo, hi = max(0, take - right), min(left, take)
    mode = min(hi, max(lo, (take + 1) * (left + 1) // (left + right + 2)))
    p = left / (left + right)
    reach = int(40 * (take * p * (1 - p)) ** 0.5) + 40
    up = np.arange(mode, min(hi, mode + reach), dtype=np.float64)  # from k to k + 1
    down = np.arange(mode, max(lo, mode - reach), -1, dtype=np.float64)  # from k to k - 1
    above = np.cumprod((left - up) / (up + 1) * (take - up) / (right - take + up + 1))
    below = np.cumprod(down / (left - down + 1) * (right - take + down) / (take - down + 1))
    law = np.r_[below[::-1], 1.0, above]
    at = int(np.searchsorted(np.cumsum(law), rng.random() * law.sum(), "right"))
    return mode - len(below) + min(at, len(law) - 1)


@lru_cache(maxsize=100_000)  # blocks of a task share the upper nodes of their paths
def left_share(seed: int, perm: int, node: int, left: int, right: int, take: int) -> int:
    return hypergeometric(np.random.Generator(np.random.PCG64([seed, perm, node])), left, right, take)


def _subset_sums(values: DataFrame, m: int, n: int, n_perm: int, seed: int) -> DataFrame:
    """(perm, s): sum of m of the n values ``x`` (numbered 1..n in ``i``) for each permutation."""
    n_blocks = max(1, -(-n // BLOCK))

    def rows_in(lo: int, hi: int) -> int:
        return min(hi * BLOCK, n) - lo * BLOCK

    def taken(perm: int, block: int) -> int:
        lo, hi, take, node = 0, n_blocks, m, 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = left_share(seed, perm, node, rows_in(lo, mid), rows_in(mid, hi), take)
            if block < mid:
                hi, take, node = mid, left, 2 * node
            else:
                lo, take, node = mid, take - left, 2 * node + 1
        return take

    def sums(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        x = pdf.sort_values("i")["x"].to_numpy(dtype=np.float64)
        out = np.empty(n_perm)
        for p in range(n_perm):
            take = taken(p, block)
            rng = np.random.Generator(np.random.PCG64([seed, p, block, 7]))
            out[p] = rng.permutation(x)[:take].sum()
        return pd.DataFrame({"perm": np.arange(n_perm), "s": out})

    blocks = values.withColumn("block", F.floor((F.col("i") - 1) / BLOCK).cast("int"))
    per_block = blocks.groupBy("block").applyInPandas(sums, "perm int, s double")
    return per_block.groupBy("perm").agg(F.sum("s").alias("s"))


def mean_difference(df: DataFrame, value: Column, in_first: Column, order: Column, n_perm: int = 1000,
                    seed: int = 0) -> DataFrame:
    """|difference of means| and p = (hits + 1) / (n_perm + 1); null where a group is empty."""
    base = df.select(value.cast("double").alias("x"), in_first.alias("f"), order.alias("o"))
    t = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("m"), F.sum("x").alias("sx"),
                 F.sum(F.when(F.col("f"), F.col("x"))).alias("sf")).head()
    n, m = t["n"], t["m"]
    if not 0 < m < n:
        return df.sparkSession.sql("SELECT CAST(NULL AS double) AS observed, CAST(NULL AS bigint) AS hits, CAST(NULL AS double) AS p_value")
    obs = abs(t["sf"] / m - (t["sx"] - t["sf"]) / (n - m))
    sums = _subset_sums(rank_rows(base, [], [F.col("o")], F.col("o"), "i"), m, n, n_perm, seed)
    gap = F.abs(F.col("s") / m - (F.lit(t["sx"]) - F.col("s")) / (n - m))
    return sums.agg(F.lit(obs).alias("observed"), F.count_if(gap >= obs - 1e-12).alias("hits")).withColumn(
        "p_value", (F.col("hits") + 1) / F.lit(n_perm + 1))


def trend(df: DataFrame, hit: Column, order: str, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """Correlation of a 0/1 series with its position, two-sided permutation p; null where the series does not vary."""
    base = df.select(hit.cast("int").alias("y"), F.col(order).alias("o"))
    ranked = rank_rows(base, [], [F.col("o")], F.col("o"), "i")
    t = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("m"),
                   F.sum(F.when(F.col("y") == 1, F.col("i") - 1)).alias("s")).head()
    n, m = int(t["n"]), int(t["m"] or 0)
    if not 0 < m < n:
        return df.sparkSession.sql("SELECT CAST(NULL AS double) AS r, CAST(NULL AS bigint) AS hits, CAST(NULL AS double) AS p_value")
    mean_i = (n - 1) / 2
    # Variances do not change under relabelling: r is linear in the summed positions of the ones.
    sxx, syy = n * (n * n - 1) / 12, m - m * m / n
    scale = (sxx * syy) ** 0.5
    obs = (t["s"] - m * mean_i) / scale
    pos = ranked.select("i", (F.col("i") - 1).cast("double").alias("x"))
    r = (F.col("s") - m * mean_i) / scale
    return _subset_sums(pos, m, n, n_perm, seed).agg(
        F.lit(obs).alias("r"), F.count_if(F.abs(r) >= abs(obs) - 1e-12).alias("hits")).withColumn(
        "p_value", (F.col("hits") + 1) / F.lit(n_perm + 1))


def trend_statistic(df: DataFrame, hit: Column, order: str) -> DataFrame:
    """E22 without the test: Pearson correlation of the series with its position."""
    ranked = rank_rows(df.select(hit.cast("int").alias("y"), F.col(order).alias("o")), [], [F.col("o")], F.col("o"), "i")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("i").cast("double"), F.col("y").cast("double")).alias("r"))
