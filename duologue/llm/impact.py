"""Exact top-k inner products with an impact-ordered index, score at a time.

Components become floor(scale * x). For each dimension of a block of candidates the index holds segments of rows whose
value has the same quantised level. A query takes the segments in the order of falling contribution to its score
(largest values first where its own component is positive, smallest first where it is negative) and adds each to the
accumulators of its rows, counted from the least contribution the dimension can make. What rows can still gain is at
most the sum over dimensions of what the next segment would add, so rows that cannot reach the k-th best any more are
proven out; the search stops when few are left or all segments are done, and what is left is scored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from duologue.llm.blocks import first_k, searched, usable

LEVELS = 24
FEW = 64


class Index:
    """Impact-ordered segments of a block: for each dimension, rows by level and each level's least and largest value."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.dims: list[list[tuple[np.ndarray, int, int]]] = []
        for d in range(values.shape[1]):
            v = values[:, d]
            lo, hi = int(v.min()), int(v.max())
            level = (v - lo) * LEVELS // (hi - lo + 1)
            order = np.argsort(level, kind="stable")
            ends = np.searchsorted(level[order], np.arange(LEVELS + 1))
            segs = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a]
            self.dims.append([(rows, int(v[rows].min()), int(v[rows].max())) for rows in segs])

    def best(self, query: np.ndarray, own: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best; row ``own`` (or -1) is left out."""
        n = len(self.values)
        plan, rest = [], 0  # segments as (contribution, dimension, rows, least gain, uncertainty, next gain)
        for d in np.flatnonzero(query).tolist():
            w, segs = int(query[d]), self.dims[d]
            gains = [(w * lo, w * hi, rows) if w > 0 else (w * hi, w * lo, rows) for rows, lo, hi in segs]
            gains.sort(key=lambda g: -g[1])
            base = gains[-1][0]
            rest += gains[0][1] - base
            for i, (lo, hi, rows) in enumerate(gains):
                after = gains[i + 1][1] - base if i + 1 < len(gains) else 0
                plan.append((hi - base, rows, lo - base, hi - lo, after))
        plan.sort(key=lambda s: -s[0])
        got, loose = np.zeros(n), np.zeros(n)  # whole numbers below 2**53
        if own >= 0:
            got[own] = -np.inf
        left = np.arange(n)
        step = max(1, len(plan) // 12)
        for at in range(0, len(plan) if n > FEW else 0, step):  # several segments at a time, then a look at what is proven
            top, rows, least, spread, after = zip(*plan[at: at + step], strict=True)
            where, size = np.concatenate(rows), [len(r) for r in rows]
            got += np.bincount(where, np.repeat(np.array(least, float), size), n)
            loose += np.bincount(where, np.repeat(np.array(spread, float), size), n)
            rest -= sum(top) - sum(after)
            kth = np.partition(got, n - k)[n - k] if n > k else -np.inf
            alive = got + loose + rest >= kth
            if at + step >= len(plan) or np.count_nonzero(alive) <= FEW:
                left = np.flatnonzero(alive)
                break
        if own >= 0:
            left = left[left != own]
        score = self.values[left] @ query
        at = first_k(score, ids[left], k)
        return left[at], score[at]


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, cand_block: int = 16_384, query_block: int = 4096,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products; queries are the ids divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; a shorter vector
    counts as filled up with zeros; repeated rows count once. All candidates are returned where there are fewer than k. Scores
    are exact while sums of products stay below 2**53.
    """

    def work(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cands: np.ndarray) -> tuple:
        index = Index(np.floor(scale * cands).astype(np.int64))
        whole = np.floor(scale * queries).astype(np.int64)
        own = np.searchsorted(ids, query_ids)
        own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == query_ids), own, -1)
        got = [index.best(q, int(o), ids, k) for q, o in zip(whole, own, strict=True)]
        return (np.repeat(np.arange(len(got)), [len(r) for r, _ in got]), np.concatenate([r for r, _ in got]),
                np.concatenate([s for _, s in got]))

    return searched(usable(vectors, id_col, vec_col, zero=True), every, k, work, "long", cand_block, query_block)
