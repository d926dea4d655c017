import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from duologue.llm import language


def test_elias_fano_against_search():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 10**9), (500, 501), (3000, 10**12), (2000, 300)):
        v = np.sort(rng.integers(0, top, n))
        ef = language.EliasFano(*(lambda b, *a: (b, n, *a))(*language.EliasFano.parts(v)))
        if n:
            assert (ef.access(np.arange(n)).astype(np.int64) == v).all()
        x = np.r_[v, v + 1, rng.integers(0, top + 5, 300)]
        assert (ef.find(x) == np.searchsorted(v, x)).all()


def corpus(n=120):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["The", "É"]
    docs = []
    for i in range(n):
        w, out = rng.choice(words), []
        for _ in range(rng.randint(0, 60)):
            out.append(w)
            w = words[(words.index(w) * 7 + 3) % 62] if w in words and rng.random() < 0.6 else rng.choice(words + ["the"] * 30)
        docs.append((i * 3 - 5, rng.choice([" ", "\n\t"]).join(out)))
    return docs + [(9001, None), (9002, ""), (9003, "the " * 400), (None, "the w1"), (9004, "unseen-once words here")]


def brute(docs, mu):
    split = [(d, (t or "").encode().lower().split() + [b"</s>"], zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2) for d, t in docs]
    c, pair = Counter(), Counter()
    for _, toks, out in split:
        if not out:
            c.update(toks)
            pair.update(zip([b"<s>", *toks], toks, strict=False))
    n, v = sum(c.values()), len(c)
    ctx = Counter()
    for (p, _), k in pair.items():
        ctx[p] += k
    p0 = {w: (k + 1) / (n + v + language.CLASSES) for w, k in c.items()}  # all seen words are among the most frequent
    rows = {}
    for d, toks, out in split:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks)
        score = sum(math.log10((pair[p, w] + mu * p0.get(w, 1 / (n + v + language.CLASSES))) / (ctx[p] + mu))
                    for p, w in zip([b"<s>", *toks], toks, strict=False))
        rows[d] = (out, len(toks), sum(c[w] > 0 for w in toks), n, base, score)
    return rows


@pytest.mark.parametrize("shard_tokens", [3_000_000, 300])
def test_same_as_counting(spark, shard_tokens):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in language.scores(df, mu=20.0, shard_tokens=shard_tokens, unit_tokens=500).collect()}
    want = brute(docs, 20.0)
    assert set(got) == set(want)
    for d, (out, n, known, total, base, score) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert score - 0.0013 * n <= r.score <= score + 1e-6


def test_word_level_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(language, "HEAD", 10)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    counts = language.word_counts(df)
    level = language.word_level(counts)
    words = np.array([r.word for r in counts.collect()], np.int64).view(np.uint64)
    total = (10 ** level.log_p0(words)).sum() + language.CLASSES * 10 ** -level.total  # about one unseen word a class
    assert total == pytest.approx(1, abs=0.02)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert language.scores(df.where("false")).count() == 0
    held = [i for i in range(60) if language.held_out(i)]
    rows = language.scores(spark.createDataFrame([(held[0], "a b")], "doc_id long, text string")).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and rows[0].n_tokens == 3 and rows[0].held_out


@pytest.mark.parametrize("shard_tokens", [3_000_000, 300])
def test_every_seen_word_has_its_own_count(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(language, "HEAD", 5)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language.scores(df, mu=20.0, shard_tokens=shard_tokens, unit_tokens=500).collect()}
    for d, (_, n, known, _, base, score) in brute(docs, 20.0).items():
        assert got[d].n_known == known and got[d].base_score == pytest.approx(base, rel=1e-9)
        assert score - 0.0013 * n <= got[d].score <= score + 1e-6
