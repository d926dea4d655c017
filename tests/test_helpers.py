"""Small helpers: edit similarity, ledgers, permutation tests, draws, hand-checked constants."""

import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from duologue.functions.fuzzy import indel_ratio, partial_ratio
from duologue.operators import ledger as M, permutation as P, sampling as J, spaces as X
from duologue.operators.joins import md5_mod


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_partial(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    best = 0.0
    pairs = [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]
    for s, l in pairs:
        m, n = len(s), len(l)
        wins = [l[i:i + m] for i in range(n - m + 1)] + [l[:i] for i in range(1, m)] + [l[n - i:] for i in range(1, m)]
        best = max([best] + [200.0 * lcs(s, w) / (m + len(w)) for w in wins])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=25))
def test_partial_ratio(a, b):
    want = brute_partial(a, b)
    assert partial_ratio(a, b) == pytest.approx(want)
    for cut in (60.0, 85.0, 90.0):
        assert partial_ratio(a, b, cut) == pytest.approx(want if want >= cut - 1e-9 else 0.0)
    assert indel_ratio(a, b) == pytest.approx(100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b)))


def test_rule_batches():
    rules = M.apply_operations([], [("ADD", None, "Be kind."), ("ADD", None, "Ask first.")], False)
    assert rules == [["Be kind.", 2], ["Ask first.", 2]]
    rules = M.apply_operations(rules, [("EDIT", 2, "Ask first. Always."), ("ADD", None, "Be kind. Now."), ("AGREE", 1, "nothing.")], False)
    # The edit repeats a known rule, so it agrees; the add holds a known rule, so it goes; the last has no match.
    assert rules == [["Ask first.", 3], ["Be kind.", 2]]
    rules = M.apply_operations(rules, [("EDIT", 2, "Stay calm."), ("REMOVE", 1, "Ask first."), ("EDIT", 9, "No place.")], True)
    assert rules == [["Stay calm.", 3]]  # three off when the list is full
    assert M.apply_votes([["a", 1]], [("DOWNVOTE", 1, ""), ("ADD", None, "b"), ("EDIT", 2, "c"), ("UPVOTE", 7, "")]) == [["c", 2]]


def test_fold_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), s, p, rng.choice(["ADD", "EDIT", "AGREE", "REMOVE"]), rng.randrange(1, 4), f"Rule {rng.randrange(6)}.")
            for s in range(40) for p in range(3)]
    df = spark.createDataFrame(rows, "run string, step bigint, pos bigint, op string, num int, rule string")
    got = {}
    for r in M.fold(df.repartition(7), "run", "step", M.apply_operations).collect():
        got.setdefault(r["run"], []).append((r["place"], r["rule"], r["count"]))
    for run in "xyz":
        rules = []
        for s in range(40):
            ops = [(o, n, t) for u, st_, p, o, n, t in rows if u == run and st_ == s]
            if ops:
                rules = M.apply_operations(rules, ops, len(rules) >= 15)
        assert sorted(got.get(run, [])) == [(i + 1, t, c) for i, (t, c) in enumerate(rules)]


def test_permutation_p_value_is_close_to_exhaustive(spark, monkeypatch):
    from itertools import combinations

    monkeypatch.setattr(P, "BLOCK", 4)  # several blocks share one permutation
    x = [1.0, 2.0, 9.0, 4.0, 7.5, 8.0, 3.0, 0.5, 6.0, 5.0]
    first = [0, 1, 0, 1, 0, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([(i, v, bool(f)) for i, (v, f) in enumerate(zip(x, first))], "i bigint, x double, f boolean")
    r = P.mean_difference(df, F.col("x"), F.col("f"), F.col("i"), 2000, 1).head()
    a = [v for v, f in zip(x, first) if f]
    obs = abs(sum(a) / 5 - (sum(x) - sum(a)) / 5)
    hits = [abs(sum(c) / 5 - (sum(x) - sum(c)) / 5) >= obs - 1e-12 for c in combinations(x, 5)]
    assert r["observed"] == pytest.approx(obs)
    assert r["p_value"] == pytest.approx(sum(hits) / len(hits), abs=0.03)
    t = P.trend(df, F.col("f"), "i", 500, 1).head()
    s = P.trend_statistic(df, F.col("f"), "i").head()
    assert t["r"] == pytest.approx(s["r"]) and 0 < t["p_value"] <= 1


def test_farthest_points(spark):
    vecs = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [-1.0, 0.0], [0.5, 0.5]]
    df = spark.createDataFrame(list(enumerate(vecs)), "id bigint, e array<double>")
    got = [r["id"] for r in J.farthest_points(df, "id", "e", 3, 0).orderBy("place").collect()]
    assert got == [0, 3, 2]


def test_thompson_prefers_the_better_arm(spark):
    arms = spark.createDataFrame([(1, 50.0, 2.0), (2, 2.0, 50.0)], "id bigint, a double, b double")
    runs = [sorted(map(tuple, J.thompson(arms.repartition(n), "id", F.col("a"), F.col("b"), 20, 9).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and all(r[1] == 1 for r in runs[0])


def test_weighted_sample_follows_weights(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0))
    got = J.weighted_sample(df, "id", F.col("w"), 200, 5).where("id < 1000").count()
    assert 160 <= got <= 195


def test_niches(spark):
    assert [X.niche_count(n) for n in (3, 10, 100, 1000)] == [3, 8, 12, 15]
    v = spark.createDataFrame([([0.0, 1.0],), ([5.0, 5.0],)], "e array<double>")
    got = [r[0] for r in v.select(X.assign_niche(F.col("e"), [[0.0, 0.0], [5.0, 4.0], [0.0, 0.0]])).collect()]
    assert got == [0, 1]
    assert v.select(X.assign_niche(F.col("e"), [])).head()[0] == 0


def test_hand_checked_constants(spark):
    one = spark.range(1)
    assert one.select(md5_mod(F.lit("abc"), F.lit(120).cast("bigint"))).head()[0] == 10
    assert math.exp(-63 / 2) == pytest.approx(2.0879679116459336e-14)


def test_stuck_slot_needs_verdicts(spark):
    from duologue.operators import summaries as S

    kind = "k string, solved boolean, conditions_met array<bigint>, triggers_tripped array<bigint>, triggers_repaired array<bigint>"
    df = spark.createDataFrame([("a", False, [], [1], None), ("a", False, None, None, None), ("a", False, None, None, None),
                                ("b", True, None, None, None)], kind)
    assert {r.k: r.stuck_knob for r in S.stuck_slot(df, "k", F.col("solved")).collect()} == {
        "a": "hardening_triggers_too_congruent", "b": "unknown"}


def test_turns_lose_all_white_space(spark):
    from duologue.operators.shaping import clean_turns

    df = spark.createDataFrame([("Ann", '\t"hello"\n'), ("Bob", "\xa0 \n")], "speaker string, content string")
    assert [r.content for r in clean_turns(df).collect()] == ["hello"]


def test_one_row_of_combined_rules(spark):
    from duologue.operators.joins import fold_rules

    rows, folds = spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1, 0)], "id bigint, fold bigint")
    rules, all_ = spark.createDataFrame([(0, "x")], "fold bigint, rules string"), spark.createDataFrame([("all",)], "rules string")
    assert {tuple(r) for r in fold_rules(rows, folds, rules, all_, "id").collect()} == {(1, 0, "x"), (2, None, "all")}
    with pytest.raises(Exception, match="more than one row"):
        fold_rules(rows, folds, rules, all_.union(all_), "id").collect()


def test_permutation_edges(spark):
    from duologue.operators import permutation as P

    df = spark.createDataFrame([(float(i), i, False) for i in range(5)], "x double, i bigint, f boolean")
    assert P.mean_difference(df, F.col("x"), F.col("f"), F.col("i"), 10).head().p_value is None
    assert P.trend(df, F.col("f"), "i", 10).head().p_value is None


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(1)
    from duologue.operators.permutation import hypergeometric

    got = np.array([hypergeometric(rng, 600_000_000, 1_400_000_000, 1_000_000) for _ in range(300)])
    sd = (1e6 * 0.3 * 0.7) ** 0.5
    assert abs(got.mean() - 300_000) < 5 * sd / 300**0.5 and 0.8 * sd < got.std() < 1.2 * sd
    assert all(7 <= hypergeometric(rng, 10, 2_000_000_000, 1_999_999_997 + 10) <= 10 for _ in range(20))


def test_cycles_are_errors(spark):
    from duologue.operators.lineage import longest_from

    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "parent bigint, child bigint")
    with pytest.raises(ValueError, match="cycle"):
        longest_from(spark.createDataFrame([(0,)], "id bigint"), edges)


def test_package_reaches_executors(tmp_path):
    """A query with Python workers, from another folder and without a path set for them."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from duologue.session import local_session\n"
            "s = local_session('2', '1g'); q = e.queries()\n"
            "print('ROWS', q['d17_self_distance'](s, '/root/testdata/sf0.001').count(), q['m02_rule_ledger'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_near_copies_are_clones_whatever_their_names(spark):
    from duologue.operators import checks

    text = "At the market Sasha asks the seller for a lower price, and they talk until the evening comes. " * 3
    rows = [(1, ["Emily"], ["Sasha"], text.replace("lower", "better"), text), (2, ["Sasha"], ["sasha "], text.replace("lower", "better"), text),
            (3, ["Emily"], ["Sasha"], "Two friends plan a trip to the mountains.", text), (4, ["Sasha"], ["Sasha"], "", text),
            (5, text.split(" "), text.split(" "), text + "And more.", text)]
    df = spark.createDataFrame(rows, "id int, c array<string>, p array<string>, ct string, pt string")
    got = {r.id: (r.is_clone, r.passes) for r in checks.surface_novelty(df, "c", "p", "ct", "pt").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (True, False)}


def test_planted_near_copy_in_the_query(spark, tmp_path):
    from duologue.plans.registry import load_all

    text = "At the market Sasha asks the seller for a lower price, and they talk until the evening comes. " * 3
    docs = [(0, text), (1, text.replace("lower", "better")), (2, "Two friends plan a trip with Boris to the far mountains.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.is_clone, r.passes) for r in load_all()["c02_surface_novelty"].run(spark, str(tmp_path)).collect()}
    assert got == {1: (True, False), 2: (False, True)}
