import random

import numpy as np
import pytest

from duologue.llm import neardup


def brute(docs, k, percent):
    """Components over all pairs."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 11, 14, 20, 45, 120, 400]))]
        if rng.random() < 0.3:
            base += passage
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            new = list(rng.choice(docs[-3:]))
            for _ in range(rng.randint(0, 1 + len(new) // 25)):
                at = rng.randrange(len(new) + 1)
                new[at: at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            docs.append(new)
    texts = [rng.choice([" ", "  ", "\n"]).join(d) for d in docs]
    texts = [t.upper() if rng.random() < 0.1 else t for t in texts] + [None, "", " \n", "solo", "SOLO", "é É", "É é"]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def run(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_same_as_all_pairs(spark, seed, k, percent):
    docs = corpus(seed)
    assert run(spark, docs, words=k, percent=percent) == brute(docs, k, percent)


def test_clusters_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    docs = corpus(4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    for i in range(60):  # a chain: neighbours are linked, ends are not
        base[rng.randrange(100)] = f"v{i}"
        docs.append((2000 + i, " ".join(base)))
    assert run(spark, docs, words=3, percent=90) == brute(docs, 3, 90)


def test_trees_find_every_component():
    rng = np.random.default_rng(3)
    for trial in range(20):
        sets = []
        for _ in range(60):
            base = rng.integers(0, 1 << 60, 40).astype(np.uint64) if not sets or rng.random() < 0.4 else sets[rng.integers(len(sets))]
            new = base.copy()
            hit = rng.integers(0, len(new), rng.integers(0, 4))
            new[hit] = rng.integers(0, 1 << 60, len(hit)).astype(np.uint64)
            sets.append(np.unique(new))
        got = neardup.Links(60)
        for a, b in neardup.block_links(list(range(60)), sets, [0] * 60, 80):
            got.tie(a, b)
        want = neardup.Links(60)
        for a in range(60):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    want.tie(a, b)
        assert all((got.find(a) == got.find(b)) == (want.find(a) == want.find(b)) for a in range(60) for b in range(a))


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "A B C D")], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (None, 1, None)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_keys_are_enough_for_every_class():
    from fractions import Fraction
    from math import comb

    def all_dirty(m, parts, d):  # by inclusion and exclusion
        return sum((-1) ** k * comb(m, k) * Fraction(parts - k, parts) ** d for k in range(m + 1))

    for c in range(14):
        d = neardup.difference(c, 80)
        if d > 8 and d < 200:
            parts, want = neardup.wide_plan(c, d, 80)
            assert float(all_dirty(parts, parts, d) ** (want // parts) * all_dirty(want % parts, parts, d)) <= neardup.LOSS
