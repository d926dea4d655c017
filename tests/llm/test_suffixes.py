import hashlib
import random

import numpy as np
import pytest

from duologue.llm import suffixes


def brute(docs, length):
    seen, out = {}, {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i: i + length] in seen:
                gone[i: i + length] = True
            else:
                seen[raw[i: i + length]] = (d, i)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        edge = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), edge, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=50):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.45:
                p = rng.choice(passages)
                a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
                parts.append(p[a:b])
            elif kind < 0.55:
                parts.append(rng.choice(["ab", "x", "na na ", "\n"]) * rng.randint(40, 150))
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 40))))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], texts[4][:-7], texts[5][11:], None, "", "é" * 300, "a" * 99, "a" * 100, "a" * 101]
    return list(zip(rng.sample(range(-100, 5000), len(texts)), texts, strict=True))


def run(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, **kw).collect()}


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 100), (3, 64)])
def test_same_as_all_strings(spark, seed, length):
    docs = corpus(seed)
    assert run(spark, docs, length=length) == brute(docs, length)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", 6)
    docs = corpus(5)
    assert run(spark, docs) == brute(docs, 100)


def test_pieces_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab c") for _ in range(3000))
    whole = suffixes.records(raw, 100, suffixes.Powers())
    monkeypatch.setattr(suffixes, "PIECE", 700)
    parts = suffixes.records(raw, 100, suffixes.Powers())
    covers = lambda r: {(int(q) - u, int(h)) for h, b, q in zip(*r, strict=True) for u in range(b & 127, (b >> 7 & 127) + 1)}
    assert covers(parts) == covers(whole) and len(covers(whole)) == 2901


def test_order_of_suffixes():
    rng = random.Random(1)
    rows = [bytes(rng.choice(b"ab") for _ in range(3)) * 3 + bytes(rng.choice(b"ab\0") for _ in range(91)) for _ in range(150)]
    rows += [r[:60] + rng.choice([b"a", b"b"]) * 40 for r in rows] + rows[:20]
    group = np.array([rng.randrange(3) for _ in rows])
    text = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 100)
    got = suffixes.deep_shallow(group, text)
    assert sorted(got.tolist()) == list(range(len(rows)))
    assert [(group[i], rows[i]) for i in got] == sorted((group[i], rows[i]) for i in range(len(rows)))


def test_repeated_rows_nulls_and_empty_table(spark):
    t = "word " * 60
    df = spark.createDataFrame([(2, t), (2, t), (None, t), (7, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_bytes - r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert got == [(-1, 300, 300), (2, 300, 5), (2, 300, 5), (7, 300, 0)]
    assert suffixes.remove_repeats(df.where("false")).count() == 0
    kept = {r.doc_id: r.kept for r in suffixes.remove_repeats(df.where("doc_id = 7"), with_text=True).collect()}
    assert kept == {7: "word "}
