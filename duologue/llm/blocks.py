"""Queries against all rows, in blocks: every task gets one block of candidates and one of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, vec array<double>) without null ids, null vectors and null or non-finite components; repeated rows count once."""
    v = F.col("vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite))
    if not zero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.groupBy("id").agg(F.min("vec").alias("vec"))


def searched(vectors: DataFrame, every: int, k: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple],
             score_type: str, cand_block: int, query_block: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query (ids divisible by ``every``).

    ``work(query ids, queries, candidate ids, candidates)`` gives (query row, candidate row, score) of the k best or more
    in its block. A query is not its own candidate. Ties go to the smaller id.
    """
    n = max(1, -(-vectors.count() // cand_block))
    is_query = F.col("id") % every == 0
    m = max(1, -(-vectors.where(is_query).count() // query_block))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, float).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "vec"])

    rows = vectors.mapInArrow(packed, "id long, vec binary")
    upto = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    own = lambda x, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(x)).cast("int")
    cands = rows.select("id", "vec", own(n, 1).alias("c"), upto(m).alias("q"), F.lit(0).alias("side"))
    queries = rows.where(is_query).select("id", "vec", upto(n).alias("c"), own(m, 2).alias("q"), F.lit(1).alias("side"))

    def matrix(values: list[bytes], width: int) -> np.ndarray:
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), float).reshape(len(values), width // 8)

    def pair(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("id", "ascending")])
        side, ids, vec = t["side"].to_numpy(), t["id"].to_numpy(), t["vec"].to_pylist()
        cut_at, width = int((side == 0).sum()), max(map(len, vec))
        cand, quer = matrix(vec[:cut_at], width), matrix(vec[cut_at:], width)
        if len(cand) and len(quer):
            q, c, s = work(ids[cut_at:], quer, ids[:cut_at], cand)
        else:
            q = c = s = np.array([], np.int64)
        kind = pa.int64() if score_type == "long" else pa.float64()
        return pa.table({"query_id": pa.array(ids[cut_at:][q], pa.int64()), "vec_id": pa.array(ids[:cut_at][c], pa.int64()),
                         "score": pa.array(s, kind)})

    best = cands.unionByName(queries).groupBy("c", "q").applyInArrow(pair, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
