import random
import re
from collections import Counter, defaultdict

import pytest

from duologue.llm import divergence

KIND = "term string, lang string, source string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, least, scale, top):
    terms = lambda t: Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    groups, langs, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        c = terms(text)
        groups[lang or "", source or ""].update(c)
        langs[lang or ""].update(c)
        seen[lang or ""].update(c.keys())
    kept = {lang: {w for w, n in c.items() if n >= least} for lang, c in seen.items()}
    for lang in langs:
        kept.setdefault(lang, set())

    def share(c, v):
        total = sum(c[w] for w in v)
        return {w: 1 + scale * (c[w] + 1) // (total + len(v)) for w in v}

    p = {g: share(c, kept[g[0]]) for g, c in groups.items()}
    q = {lang: share(c, kept[lang]) for lang, c in langs.items()}
    f = lambda a, b: (a - b) ** 2 // b
    out = []
    for (lang, source), own in p.items():
        pairs = [(sum(f(own[w], other[w]) for w in own), s) for (x, s), other in p.items() if x == lang and s != source]
        more = [(f(own[w], q[lang][w]), w) for w in own if groups[lang, source][w] and own[w] > q[lang][w]]
        for part, found, most in (("pair", pairs, None), ("term", more, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(found[:most])]
    return sorted(out)


def made(n, seed, sources=6):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("The", "é", "漢", "ZEB", "ö") for b in ("a", "B", "ç", "xy", " ")] + ["don't", "a1b", "42", "_"]
    docs = [(rng.choice(["en", "fr"]), f"s{int(rng.random() ** 2 * sources)}", " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for _ in range(n)]
    return docs + [("en", None, None), (None, "s1", "alone words"), ("de", "x", ""), ("de", "y", "123"), ("en", "s0", "Thea " * 30_000), docs[0], docs[0],
                   ("it", "only", "uno due"), ("it", "only", "uno due"), ("it", "only", "uno due tre")]


@pytest.mark.parametrize("least, scale, top, sources", [(3, 10**9, 200, 6), (1, 1000, 4, 40)])
def test_against_slow(spark, least, scale, top, sources):
    docs = made(250, 1, sources)
    df = spark.createDataFrame([("clash", *d) for d in docs], KIND).repartition(5)
    got = divergence.audit(df, least_docs=least, scale=scale, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == slow(docs, least, scale, top)


def test_small_blocks(spark):
    docs = made(120, 2, 9)
    df = spark.createDataFrame([("clash", *d) for d in docs], KIND)
    assert sorted(tuple(r) for r in divergence.audit(df, block=2, at_once=5).collect()) == slow(docs, 3, 10**9, 200)


def test_tallies_leave_in_parts(spark):
    docs = made(80, 3)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("clash", *d) for d in docs], KIND).select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    add = lambda d: sorted(map(tuple, d.groupBy("lang", "source", "term").agg(F.sum("tf"), F.sum("df")).collect()))
    assert add(divergence.tallies(df, most=2)) == add(divergence.tallies(df))


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], KIND)).count() == 0
