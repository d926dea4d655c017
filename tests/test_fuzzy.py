"""The q-gram bound and the lanes against comparing everything, on planted near copies and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from duologue.functions import fuzzy as Z
from duologue.operators import checks as C


def plain(a, b):
    """partial_ratio by its definition."""
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            prev = 0
            for j, d in enumerate(y, 1):
                prev, row[j] = row[j], prev + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    def one(a, b):
        m, n = len(a), len(b)
        windows = [b[i:i + m] for i in range(n - m + 1)] + [b[:k] for k in range(1, m)] + [b[n - k:] for k in range(1, m)]
        return max(200 * lcs(a, w) / (m + len(w)) for w in windows)

    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def texts_with_copies(seed, n=40, size=60):
    rng = random.Random(seed)
    words = ["the", "there", "and", "hand", "é", "sand", "er", "error", "漢字", "a", "in", "ing"]
    out = []
    for _ in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(3, size)))
        items = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(4)]
        for share in (0, 0.05, 0.1, 0.15, 0.2):
            at = rng.randrange(len(text))
            part = list(text[at:at + rng.randrange(4, 90)])
            for _ in range(int(len(part) * share)):
                k = rng.randrange(len(part))
                part[k:k + 1] = rng.choice([[], ["x"], [part[k], "y"]])
                if not part:
                    part = ["z"]
            items.append("".join(part))
        items += [text[:30] + "qqq", "qqq" + text[-30:], "", text, text + "!", "ab", text[:5]]
        out.append((text, items))
    return out + [("", ["", "a"]), ("a", ["a", "b", "long item"]), ("aaaa" * 20, ["aaaab", "baaa", "aaaaaaa"])]


@pytest.mark.parametrize("cutoff", [60.0, 75.0, 85.0, 90.0, 99.0])
def test_items_as_by_full_comparison(cutoff):
    data = texts_with_copies(int(cutoff))
    got = Z.near_items([items for _, items in data], [text for text, _ in data], cutoff)
    for (text, items), found in zip(data, got):
        assert found == [Z.partial_ratio(i, text) > cutoff for i in items]


def test_definition():
    data = texts_with_copies(1, 12, 14)
    got = Z.near_items([items for _, items in data], [text for text, _ in data], 85.0)
    near = 0
    for (text, items), found in zip(data, got):
        want = [plain(i, text) > 85 for i in items]
        assert found == want and [Z.partial_ratio(i, text, 85.0) > 85 for i in items] == want
        near += sum(want)
    assert near > 30


def test_long_pairs_are_settled_by_their_grams():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    far, near = 0, 0
    for _ in range(40):
        a = " ".join(word() for _ in range(150))
        b = " ".join(word() for _ in range(180))
        far += not Z.within_reach(a, b, 90.0)
        c = list(a)
        for _ in range(len(c) // 25):
            c[rng.randrange(len(c))] = "z"
        c = "start " + "".join(c) + " end"
        near += Z.within_reach(a, c, 90.0)
        assert Z.partial_ratio(a, c, 90.0) > 90
    assert far == 40 and near == 40


def test_key_leaks_rows(spark):
    data = texts_with_copies(4, 15, 30)
    rows = [(n, items[:8], items[8:] + [None], text.upper()) for n, (text, items) in enumerate(data)] + [(900, None, [], "some text"), (901, ["a b"], None, None)]
    df = spark.createDataFrame(rows, "k int, conditions array<string>, triggers array<string>, t string")
    got = {(r.k, r.kind, r.item): r.leaks for r in C.key_leaks(df, "k", "conditions", "triggers", F.col("t"), F.substring("t", 1, 40)).collect()}
    want = {}
    for k, conditions, triggers, t in rows:
        for kind, own, seen in (("movement_condition", conditions, t), ("hardening_trigger", triggers, (t or "")[:40])):
            for i in own or []:
                want[k, kind, i] = Z.partial_ratio((i or "").lower(), (seen or "").lower()) > 85
    assert got == want and 20 < sum(want.values()) < len(want) - 20


@pytest.mark.parametrize("cutoff", [30.0, 60.0, 75.0, 90.0, 100.0])
def test_decisions_as_by_full_comparison(cutoff):
    for text, items in texts_with_copies(int(cutoff) + 1):
        for i in items:
            assert Z.reaches(i, text, cutoff) == Z.reaches(text, i, cutoff) == (Z.partial_ratio(i, text) >= cutoff)
            assert Z.over(i, text, cutoff) == (Z.indel_ratio(i, text) > cutoff)


def test_a_stretch_settles_its_windows(monkeypatch):
    """A long text far from the short one is walked less than twice; one that does not matter is not looked at."""
    rng = random.Random(3)
    a, b = "".join(rng.choices("abcdefghij", k=400)), "".join(rng.choices("abklmnopqrstuvwxyz" * 2 + "cdefghij", k=20_000))
    runs, init = [], Z._Run.__init__
    monkeypatch.setattr(Z._Run, "__init__", lambda self, *x: init(self, *x) or runs.append(self))
    assert Z.reaches(a, b, 60.0) == (Z.partial_ratio(a, b) >= 60)
    assert len(runs) > 2 and sum(r.at - r.start for r in runs) < 2 * len(b)


def test_only_declared_slots_are_compared(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    def count(cutoff):
        @F.pandas_udf("boolean")
        def has(a, b):
            asked.add(int((a != "").sum()))
            return (a == b)

        return has

    monkeypatch.setattr(C, "reaches_udf", count)
    rows = [(1, ["b"], "one text", "one text"), (2, ["x"], "one text", "other"), (3, None, "a", "b"), (4, [" B "], "far", "other")]
    df = spark.createDataFrame(rows, "k int, d array<string>, t string, p string").withColumn("n", F.array().cast("array<string>"))
    got = {r.k: r.issues for r in C.key_delta(df, {"b": ("t", "p")}, "d", "n", "n", "t", "p").collect()}
    assert got == {1: ["slots_unchanged"], 2: ["no_key_slot"], 3: ["no_key_slot"], 4: ["text_drifted"]}
    assert asked.value == 2


def test_reordered_text_is_settled_before_all_windows(monkeypatch):
    said = ["one two three", "four five six", "seven eight nine", "ten eleven twelve", "north south east", "red green blue"]
    a, b = ". ".join(said), ". ".join(reversed(said))
    want = Z.partial_ratio(a, b)
    assert Z.within_reach(a, b, 80.0) and want < 80  # the same q-grams, in another order
    monkeypatch.setattr(Z, "_best_window", lambda *_: pytest.fail("all windows were compared"))
    assert Z.partial_ratio(a, b, 80.0) == 0.0


def test_a_shorter_window_at_the_end_is_found():
    """The bound of a window between the shortest and the whole one may be below that of both."""
    item, text = "and ertied.", "a, eaing, orhend ero on of eslyan ertire."
    assert plain(item, text) > 85 and Z.near_items([[item]], [text], 85.0) == [[True]]
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc d", k=rng.randrange(8, 60))) for _ in range(60)]
    items = [[t[-k:-1 - k // 9] + "d" for k in range(4, 30, 3)] + ["a" + t[1 + k // 9:k] for k in range(4, 30, 3)] for t in texts]
    for cutoff in (75.0, 85.0):
        assert Z.near_items(items, texts, cutoff) == [[plain(i, t) > cutoff for i in own] for own, t in zip(items, texts)]


def test_diagonals_leave_few_windows(monkeypatch):
    """Sentences of the same invented words: what is walked is a small part of the text for each of them; results are the same held in parts."""
    rng = random.Random(11)
    words = ["".join(rng.choices("aaabcdeeeefghiiiklmnnooprrssttuvwy", k=rng.randrange(2, 9))) for _ in range(400)]
    said = [" ".join(rng.choices(words, k=rng.randrange(3, 18))) + "." for _ in range(240)]
    text, items, text_of_one = " ".join(said[:120]), said[100:] + ["x" * 40], "la " * 300
    walked, shared = [], Z._Search._shared
    monkeypatch.setattr(Z._Search, "_shared", lambda self, of, start, size: walked.append(int(size.sum())) or shared(self, of, start, size))
    assert Z.near_items([items], [text], 85.0) == [want := [Z.partial_ratio(i, text) > 85 for i in items]] and sum(want) >= 20
    assert sum(walked) < len(text) * len(items) / 4
    got = Z.near_items([items, [text_of_one]], [text, "la " * 4000], 85.0)
    assert got == [want, [True]]
    for limit in ("HELD", "LETTERS", "LANES"):
        monkeypatch.setattr(Z, limit, 64)
    assert Z.near_items([items, [text_of_one]], [text, "la " * 4000], 85.0) == got
