import random

import numpy as np
import pytest

from duologue.llm import classifier

KIND = "doc_id long, text string, lang string, source string, keep string"


def made(n, seed):
    """Documents with their verdict: junk by its layout, toxic by its words, else clean."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    words, bad = [word() for _ in range(400)], ["zzvile", "zzscum", "zzrot"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        kind = rng.random()
        if kind < 0.15:
            text = [w + "&&&" for w in text]
        elif kind < 0.3:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "en", "er"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), f"s{rng.randrange(4)}", kind))
    return rows


def test_held_out_documents(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame([(*r[:4], "x") for r in rows], KIND).repartition(4)
    labels = spark.createDataFrame([(r[0], int(r[4] >= 0.15), int(0.15 <= r[4] < 0.3), None) for r in rows if r[0] % 2],
                                   "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in classifier.classify(docs, labels, labelled=600, pool=300).collect()}
    assert len(got) == 1500
    free = [r for r in rows if r[0] % 2 == 0]
    right = np.mean([got[r[0]].keep == (r[4] >= 0.3) for r in free])
    kept = np.mean([got[r[0]].keep for r in free if r[4] >= 0.3])
    assert right > 0.97 and kept > 0.98
    assert all(0 <= r.reject <= 1 and (r.reject < 0.5) == r.keep for r in got.values())
    again = {r.doc_id: r.reject for r in classifier.classify(docs.repartition(3), labels, labelled=600, pool=300).collect()}
    assert all(again[d] == pytest.approx(r.reject, abs=1e-9) for d, r in got.items())


def test_odd_rows(spark):
    rows = made(200, 2)
    odd = [(None, "text", None, None, "x"), (9001, None, None, None, "x"), (9002, "", "en", "s1", "x"), (9003, "a " * 100_000, "en", "s1", "x"),
           (9004, "same", "en", "s1", "x"), (9004, "same", "en", "s1", "x")]
    docs = spark.createDataFrame([(*r[:4], "x") for r in rows] + odd, KIND)
    labels = spark.createDataFrame([(r[0], int(r[4] >= 0.15), int(0.15 <= r[4] < 0.3)) for r in rows] + [(5, None, None), (None, 1, 0), (9001, None, 1)],
                                   "doc_id long, quality int, toxic int")
    got = classifier.classify(docs, labels)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and got.count() == 206
    same = [r.reject for r in got.where("doc_id = 9004").collect()]
    assert len(same) == 2 and same[0] == same[1]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", "x"), (2, None, None, None, "x")], KIND)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in classifier.classify(docs, none).collect()] == [True, True]
    assert classifier.classify(docs.where("false"), none).count() == 0
    bad = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.keep for r in classifier.classify(docs, bad).collect()] == [False, False]
