import math
import re
from collections import Counter

import numpy as np
import pytest

from duologue.llm import segments as S


@pytest.fixture(scope="module")
def lattices():
    return S.Lattices(S.Vocabulary(S.model_path(), 0.5))


def every_path(lat, text):
    """All segmentations of a text with their probabilities, by recursion over the vocabulary."""
    v = lat.v
    names = {v.bytes[i].decode(): i for i in range(len(v.bytes)) if i not in set(v.byte.tolist()) and i > 2}
    whole = " " + text

    def go(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for n in range(1, min(16, len(rest)) + 1):
            i = names.get(rest[:n])
            if i is not None:
                ids, sc = (i,), v.score[i]
            elif n == 1:
                ids = tuple(v.byte[list(rest[0].encode())].tolist())
                sc = len(ids) * v.score[v.byte[0]]
            else:
                continue
            out += [((*ids, *more), sc + s) for more, s in go(rest[n:])]
        return out

    paths = go(whole)
    top = max(s for _, s in paths)
    total = top + math.log(sum(math.exp(s - top) for _, s in paths))
    return {ids: s - total for ids, s in paths}


def drawn(lat, text, k, seeds):
    for seed in seeds:
        yield [(tuple(S.ids_of(lat, st).tolist()), lp, top, inc) for st, lp, top, inc in S.sampled(lat, [text], [seed], k, 5)[0]]


@pytest.mark.parametrize("text", ["the a", "tion x", "a  b"])
def test_draws_follow_the_lattice(lattices, text):
    want = every_path(lattices, text)
    first, within, weight, runs = Counter(), Counter(), 0.0, 4000
    for got in drawn(lattices, text, 3, range(runs)):
        assert len({g[0] for g in got}) == len(got) == min(3, len(want))
        assert all(lp == pytest.approx(want[ids], abs=1e-9) for ids, lp, _, _ in got)
        assert all(a[2] > b[2] for a, b in zip(got, got[1:], strict=False))
        first[got[0][0]] += 1
        within.update(g[0] for g in got)
        weight += sum(math.exp(lp - inc) for _, lp, _, inc in got)
    for ids, lp in want.items():
        p = math.exp(lp)
        assert abs(first[ids] / runs - p) < 5 * math.sqrt(p * (1 - p) / runs) + 1e-3
    assert weight / runs == pytest.approx(1, abs=0.03)  # p / inclusion sums to one on average
    second = Counter(g[1][0] for g in drawn(lattices, text, 2, range(5000, 5000 + runs)) if len(g) > 1)
    for ids, lp in want.items():  # the second of a sequence of draws without replacement
        q = sum(math.exp(o) * math.exp(lp) / (1 - math.exp(o)) for other, o in want.items() if other != ids)
        assert abs(second[ids] / runs - q) < 5 * math.sqrt(q * (1 - q) / runs) + 2e-3


def test_all_segmentations_of_a_short_text(lattices):
    want = every_path(lattices, "ab")
    got = next(drawn(lattices, "ab", 500, [3]))
    assert {g[0] for g in got} == set(want) and all(g[3] == 0 for g in got)


def test_rows(spark, monkeypatch):
    texts = ["", None, "word", "two  words\n\nline ▁ é 日本 \x01 🙂", "x" * 5000, " lead", "tail ", "the of and " * 3000, "the of and " * 3000]
    rows = [(i, t, 0.0) for i, t in enumerate(texts)] + [(None, "word", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    a = {(r.doc_id, r["rank"]): r for r in S.segmentations(df.repartition(1), k=3).collect()}
    b = {(r.doc_id, r["rank"]): r for r in S.segmentations(df.repartition(4), k=3, batch_chars=10).collect()}
    assert set(a) == set(b) and all(r.round_trip for r in a.values())
    for key, r in a.items():  # sums are taken in another order
        assert r.ids == b[key].ids and all(r[c] == pytest.approx(b[key][c], rel=1e-6, abs=1e-9) for c in ("log_prob", "score", "log_inclusion"))
    assert a[0, 1].n_pieces == 0 and a[1, 1].log_inclusion == 0 and (0, 2) not in a
    assert a[7, 1].ids != a[8, 1].ids and len({tuple(a[7, k].ids) for k in (1, 2, 3)}) == 3
    assert S.segmentations(df.where("false")).count() == 0
    lat = S.Lattices(S.Vocabulary(S.model_path(), 1.0))
    assert lat.v.decode(a[3, 2].ids) == texts[3]
    p = np.array([r.log_inclusion for r in a.values()])
    assert (np.isfinite(p) & (p <= 0)).all()


def chunks_of(lat, texts):
    """The chunks of each text, read back from their lattices."""
    begin, many = lat.starts(texts)
    own = []
    for b in begin.tolist():
        stop = b + int(np.flatnonzero(lat.letter[b:lat.positions] == 0)[0])
        own.append("".join(map(chr, lat.letter[b:stop].tolist())))
    at = np.r_[0, np.cumsum(many)]
    return [own[a:b] for a, b in zip(at, at[1:], strict=False)]


TEXTS = ["", "the end ", " of a1b2 12,5%--x  \n\n(y) é▁日本", "  ", "a\n", "ab ba abba baab", "tail ", "x" * 300 + " 1", "the end "]


def test_chunks_are_those_of_the_pattern():
    lat = S.Lattices(S.Vocabulary(S.model_path(), 1.0))
    m, sp = re.escape("".join(chr(c) for c in range(128) if lat.v.mark[c])), S.SPACE
    pattern = re.compile(f"{sp}+[{m}]*[^{sp}{m}]*|[{m}]+[^{sp}{m}]*|[^{sp}{m}]+")
    want = [pattern.findall(sp + t.replace(sp, S.STAND_IN).replace(" ", sp)) if t else [] for t in TEXTS]
    assert chunks_of(lat, TEXTS) == want
    assert chunks_of(lat, TEXTS[::-1]) == want[::-1]  # all known by now
    many = [f"{x} w{x}" for x in range(40_000)]  # more chunks than the first table has room for
    assert [c[0] for c in chunks_of(lat, many[-50:] + many)[:50]] == [S.SPACE + x.split()[0] for x in many[-50:]]
    assert lat.chunks > 1 << 16


def test_chunks_with_one_hash_stay_apart():
    lat = S.Lattices(S.Vocabulary(S.model_path(), 1.0))
    want, factor = chunks_of(lat, TEXTS), lat.factor
    lat.clear()
    lat.factor = 1  # the hash of a chunk is that of its letters in any order
    assert chunks_of(lat, TEXTS) == want and lat.factor not in (1, factor)


def test_branches_are_looked_at_only_where_one_can_be_among_the_best(monkeypatch):
    lat = S.Lattices(S.Vocabulary(S.model_path(), 1.0))
    seen, plain = [], S.truncated
    monkeypatch.setattr(S, "truncated", lambda location, u, top: seen.append(location.size) or plain(location, u, top))
    texts = ["the quick brown fox jumps over a lazy dog and runs " * 500, "of " * 4000]
    few = S.sampled(lat, texts, [1, 2], 4, 1)
    steps = sum(len(g[0]) for own in few for g in own)
    assert sum(seen) < steps / 2  # all steps, if each branch is scored
    monkeypatch.setattr(S, "SPREAD", np.inf)  # all branches
    for a, b in zip(few, S.sampled(lat, texts, [1, 2], 4, 1), strict=True):
        assert all((x[0] == y[0]).all() and x[1:] == y[1:] for x, y in zip(a, b, strict=True)) and len(a) == len(b) == 4


def test_a_full_cache_keeps_what_is_met_often(lattices, monkeypatch):
    lat = S.Lattices(lattices.v)
    texts = ["often often often " + " ".join(f"w{x}x{y}" for x in range(20)) for y in range(6)]
    want = [[(lat.piece[st].tolist(), *rest) for st, *rest in got] for got in S.sampled(lat, texts, list(range(6)), 2, 5)]
    monkeypatch.setattr(S, "MOST", 60)
    before = lat.positions
    lat.starts(["often"])
    assert 0 < lat.chunks and lat.positions <= 30 < 60 < before
    monkeypatch.setattr(lat, "add", lambda *_: pytest.fail("a chunk met often is built again"))
    lat.starts(["often often"])
    monkeypatch.undo()
    monkeypatch.setattr(S, "MOST", 60)
    for text, key, had in zip(texts, range(6), want, strict=True):
        got = S.sampled(lat, [text], [key], 2, 5)[0]
        assert [(lat.piece[st].tolist(), *rest[:2]) for st, *rest in got] == [(p, pytest.approx(x), pytest.approx(y)) for p, x, y, *_ in had]
