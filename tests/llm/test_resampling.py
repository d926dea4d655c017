import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from duologue.llm import resampling

KIND = "doc_id long, text string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def slow(docs, target, buckets, percent, least):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(at(f) for _, t in docs for f in features(t)[1])
    t = Counter(at(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    k = percent * len(able) // 100
    out = [(*r[1:], n + 1 if n < k else None) for n, r in enumerate(able)] + [(*r[1:], None) for r in rows if r[0] < least]
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "Émile", "naïve", "x1", "42", "don't", "A", "漢字", "zebra", "in", "of"]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(30)]
    docs = [(i, "\n".join(rng.choices(lines + ["", " ", "--"], k=rng.randrange(0, 12))) or None) for i in range(n)]
    return docs + [(n, "word " * 50_000), (n + 1, "q" * 80_000 + " tail"), (n + 2, "\x00a\x7fb\r\nc d"), (None, lines[0] * 9), (5, docs[5][1]), (5, lines[1])]


@pytest.mark.parametrize("buckets, percent, least", [(10_000, 25, 20), (7, 60, 1)])
def test_against_slow(spark, buckets, percent, least):
    docs, target = made(300, 1), ["The zebra in the naïve\nx1 of 42", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], KIND).repartition(6)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, percent=percent, least_words=least, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow(docs, target, buckets, percent, least)


def test_small_stretches(spark):
    """Lines and documents that fall into different stretches of work give the same counts and weights."""
    docs = made(60, 2)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], KIND).coalesce(1)
    from pyspark.sql import functions as F

    texts = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    whole, cut = (resampling.bucket_counts(texts.select("text"), 100, words=w) for w in (1 << 20, 3))
    assert whole.tolist() == cut.tolist()
    gain = resampling.gains(whole, whole[::-1])
    a, b = (sorted(map(tuple, resampling.weights(texts, gain, words=w).collect()), key=repr) for w in (1 << 20, 3))
    assert a == b


def test_checksums_of_pairs():
    w, words = resampling.Words(10_000), [b"a", "é".encode(), b"x" * 70_000, b"mid" * 9]
    n = w.numbers(iter(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert w.pair(n[[i]], n[[j]])[0] == zlib.crc32(a + b" " + b) % 10_000


def test_empty(spark):
    empty = spark.createDataFrame([], KIND)
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, goal).count() == 0
    rows = resampling.resample(spark.createDataFrame([(1, "a b " * 20, "x")], KIND), empty, percent=100).collect()
    assert len(rows) == 1 and rows[0].rank == 1
