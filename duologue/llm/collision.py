"""Approximate nearest neighbours by collision counting over single projections.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |v|^2) for candidates and 0 for
queries, with M the largest norm. Each of ``projections`` random lines keeps the candidates of a block as a sorted array.
A window centred on the query grows on every line from round to round (virtual rehashing: no table is built again), and
a candidate's count is the number of windows it has been in. Candidates whose count reaches the threshold are verified
with their exact inner product. While fewer than k are
found the windows grow by a factor; then they go straight to the width at which the search ends. It ends when a vector at the distance of the k-th best found would have reached
the threshold by now with probability ``sure``, or when every candidate has been verified.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.blocks import first_k, searched, usable


def chance(distance: float, half: float, lines: int, threshold: int) -> float:
    """Probability that a vector at a distance is in at least ``threshold`` of the windows of half width ``half``."""
    p = erf(half / (distance * sqrt(2))) if distance > 0 else 1.0
    return sum(comb(lines, j) * p**j * (1 - p) ** (lines - j) for j in range(threshold, lines + 1))


def reach(lines: int, threshold: int, sure: float) -> float:
    """Half width of the windows, for distance 1, at which the chance is ``sure``."""
    lo, hi = 0.0, 10.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chance(1.0, mid, lines, threshold) < sure else (lo, mid)
    return hi


class Lines:
    """Sorted projections of a block of candidates."""

    def __init__(self, points: np.ndarray, lines: np.ndarray):
        place = points @ lines
        order = np.argsort(place, axis=0).T  # as wide as bincount wants it, so that nothing is cast for each window
        place = np.take_along_axis(place.T, order, 1)
        # The lines end to end, so that one search finds a place on each of them.
        n, self.step = len(points), 4 * float(np.abs(place).max()) + 4
        self.shift = np.arange(len(place)) * self.step
        self.begin, self.end = np.arange(len(place)) * n, np.arange(1, len(place) + 1) * n
        self.order, self.place = order.ravel(), (place + self.shift[:, None]).ravel()

    def find(self, at: np.ndarray) -> np.ndarray:
        """The number of candidates before a place on each line, counted over the lines end to end; rows of ``at`` are places on all lines."""
        inside = np.clip(at, -self.step / 2, self.step / 2)
        return np.clip(self.place.searchsorted(inside + self.shift), self.begin, self.end)

    def near(self, query: np.ndarray, points: np.ndarray, cands: np.ndarray, q: np.ndarray, q2: float, own: int, ids: np.ndarray,
             k: int, threshold: int, per_distance: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
        """``query``: its projections; ``q2``: M^2 + |q|^2, so the distance of a candidate is sqrt(q2 - 2 score)."""
        n = len(cands)
        count, tested = np.zeros(n, np.int64), np.zeros(n, bool)
        if own >= 0:
            tested[own] = True
        lo = hi = self.find(query)
        half = per_distance * sqrt(max(q2, 1e-12)) / 4  # narrower ones hold nothing that these do not hold
        rows, score = np.array([], np.int64), np.array([])
        while True:
            a, b = self.find(np.stack([query - half, query + half]))
            a, b = np.minimum(a, lo), np.maximum(b, hi)
            grown = [self.order[x:y] for x, y in zip([*a.tolist(), *hi.tolist()], [*lo.tolist(), *b.tolist()], strict=True) if x < y]
            lo, hi = a, b
            if grown:
                count += np.bincount(np.concatenate(grown), minlength=n)
            new = np.flatnonzero((count >= threshold) & ~tested)
            if len(new):
                tested[new] = True
                found = cands[new] @ q if 3 * len(new) < n else (cands @ q)[new]
                rows, score = np.r_[rows, new], np.r_[score, found]
                if len(rows) > 8 * k:  # what may still be among the best, rounding allowed for
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9 * max(1.0, q2)
                    rows, score = rows[keep], score[keep]
            if tested.all():
                break
            if len(rows) >= k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                enough = per_distance * sqrt(max(q2 - 2 * kth, 0.0))
                if half >= enough:
                    break
                half = enough  # better ones found on the way only make less enough
            else:
                half *= growth
        score = (cands[rows] * q).sum(1)  # equal vectors get equal scores, in whatever round they were found
        best = first_k(score, ids[rows], k)
        return rows[best], score[best]


def search(vectors: DataFrame, every: int = 20, k: int = 20, projections: int = 64, share: float = 0.4, sure: float = 0.95,
           growth: float = 1.25, seed: int = 7, cand_block: int = 16_384, query_block: int = 4096,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: nearest found by inner product for the ids divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; a shorter
    vector counts as filled up with zeros; repeated rows count once. All candidates are returned where there are at most k.
    """
    vecs = usable(vectors, id_col, vec_col, zero=False)
    norm2 = vecs.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).head()[0] or 0.0
    threshold = max(1, round(share * projections))
    per_distance = reach(projections, threshold, sure)

    def work(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cands: np.ndarray) -> tuple:
        lines = np.random.default_rng(seed).standard_normal((cands.shape[1] + 1, projections))
        more = np.sqrt(np.maximum(0.0, norm2 - (cands * cands).sum(1)))
        points = np.c_[cands, more]
        index, place = Lines(points, lines), np.c_[queries, np.zeros(len(queries))] @ lines
        own = np.searchsorted(ids, query_ids)
        own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == query_ids), own, -1)
        got = [index.near(place[i], points, cands, q, norm2 + float(q @ q), int(own[i]), ids, k, threshold, per_distance, growth)
               for i, q in enumerate(queries)]
        return (np.repeat(np.arange(len(got)), [len(r) for r, _ in got]), np.concatenate([r for r, _ in got]),
                np.concatenate([s for _, s in got]))

    return searched(vecs, every, k, work, "double", cand_block, query_block)
