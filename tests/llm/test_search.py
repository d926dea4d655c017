import math

import numpy as np
import pytest

from duologue.llm import collision, impact


def table(spark, seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base[: n // 3] = base[0] + rng.standard_normal((n // 3, dim)) * 0.05
    base[n // 3: n // 3 + 30] = base[1]
    rows = [(int(i), [float(np.float32(x)) for x in v], "z") for i, v in zip(rng.permutation(3 * n)[:n], base, strict=True)]
    rows += [(5001, None, "a"), (5020, [math.nan] * dim, "a"), (5040, [None] + [1.0] * (dim - 1), "a"), (5060, [math.inf] * dim, "a"),
             (5100, [0.0] * dim, "a"), (None, [1.0] * dim, "a"), rows[0]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(rows, every, k, zero, scale=None):
    ok = {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()
          and (zero or np.any(v))}
    if scale:
        ok = {i: np.floor(scale * v) for i, v in ok.items()}
    out = {}
    for q in ok:
        if q % every == 0:
            best = sorted((-float(ok[c] @ ok[q]), c) for c in ok if c != q)[:k]
            out[q] = [(c, -s) for s, c in best]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("block", [16_384, 60])
def test_impact_is_exact(spark, block):
    rows, df = table(spark, 1)
    got = collected(impact.search(df, every=10, cand_block=block, query_block=25))
    assert got == brute(rows, 10, 5, True, 256)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0]), (50, [0.5, -2.0])], "vec_id long, embedding array<float>")
    assert collected(impact.search(df)) == {0: [(3, 65536), (50, 32768 - 262144)], 50: [(3, 32768), (0, 32768 - 262144)]}
    assert collected(collision.search(df))[0] == [(3, 1.0), (50, -3.5)]
    for search in (impact.search, collision.search):
        assert search(df.where("false")).count() == 0
        assert search(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("block", [16_384, 100])
def test_recall_of_collision_counting(spark, block):
    rows, df = table(spark, 2, 1500, 24)
    got, want = collected(collision.search(df, cand_block=block)), brute(rows, 20, 20, False)
    assert set(got) == set(want)
    hit = total = 0
    for q, best in want.items():
        least = best[-1][1] - 1e-9
        assert all(a >= b - 1e-12 for (_, a), (_, b) in zip(got[q], got[q][1:], strict=False)) and len(got[q]) == len(best)
        hit += sum(s >= least for _, s in got[q])
        total += len(best)
    assert hit >= 0.95 * total


def test_few_rounds_on_vectors_without_structure(monkeypatch):
    x, asked, find = np.random.default_rng(4).normal(size=(3000, 32)), [], collision.Lines.find
    monkeypatch.setattr(collision.Lines, "find", lambda self, at: asked.append(1) or find(self, at))
    lines, m2 = np.random.default_rng(7).standard_normal((33, 64)), float((x * x).sum(1).max())
    index = collision.Lines(np.c_[x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))], lines)
    points, wide = np.c_[x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))], collision.reach(64, 26, 0.95)
    found = 0
    for i in range(20):
        rows, _ = index.near(np.r_[x[i], 0.0] @ lines, points, x, x[i], m2 + float(x[i] @ x[i]), i, np.arange(3000), 20, 26, wide, 1.25)
        score = x @ x[i]
        score[i] = -np.inf
        found += len(set(rows.tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert len(asked) <= 20 * 9 and found >= 0.95 * 400
