"""The cell search against full numpy products: copies, clusters, zero vectors, small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duologue.operators import nearest
from duologue.operators.nearest import Rule, above, best_match, duplicates, top_k, vectors
from duologue.operators.similarity import mean_pairwise_distance


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + 0.15 * rng.normal(size=(300, 8))
    x[:90] = x[0]  # a third of the rows are copies
    return x


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 50)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 60)
    monkeypatch.setattr(nearest, "FAN", 4)
    monkeypatch.setattr(nearest, "NEXT", 2)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, e array<double>")


def sims(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def brute(x, k, allowed):
    s = np.round(sims(x), 9)
    out = set()
    for i in range(len(x)):
        c = sorted((-s[i, j], j) for j in range(len(x)) if allowed(i, j))[:k]
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(c)}
    return out


@pytest.mark.parametrize("rule, allowed", [
    (Rule(), lambda i, j: True),
    (Rule(not_self=True), lambda i, j: i != j),
    (Rule(earlier=True), lambda i, j: j < i),
    (Rule(other_group=True), lambda i, j: i % 7 != j % 7),
    (Rule(not_self=True, earlier=True), lambda i, j: j < i),
])
def test_top_k_is_exact(spark, data, rule, allowed):
    v = vectors(frame(spark, data), "id", "e", group=F.col("id") % 7, order=F.col("id"))
    got = {(r["id"], r["rank"], r["nid"]) for r in top_k(v, v, 4, rule).collect()}
    assert got == brute(data, 4, allowed)


def test_threshold_pairs_stand_for_copies(spark, data):
    v = vectors(frame(spark, data), "id", "e")
    q, c = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    got = above(q, c, 0.9)
    s = sims(data)
    want = sum(s[i, j] > 0.9 for i in range(0, 300, 2) for j in range(1, 300, 2))
    assert got.agg(F.sum(F.col("copies") * F.col("n_copies"))).head()[0] == want
    assert got.count() < want / 3  # copies are not multiplied out


def test_duplicates_and_empty_corpus(spark, data):
    x = np.vstack([data, np.zeros((1, 8))])
    v = vectors(frame(spark, x), "id", "e")
    corpus = v.where("id % 2 = 1 and id < 300")
    s = sims(data)
    want = {i for i in range(0, 300, 2) if max(s[i, 1::2]) > 0.92}
    assert {r["id"] for r in duplicates(v.where("id % 2 = 0"), corpus, 0.92).collect()} == want
    assert duplicates(v, v.where("id < 0"), 0.92).count() == 0
    assert best_match(v.where("id < 0"), corpus).count() == 0


def test_mean_pairwise_distance(spark, data):
    df = frame(spark, data).withColumn("g", F.when(F.col("id") < 299, F.col("id") % 3).otherwise(9))
    got = {r["g"]: r["mean_distance"] for r in mean_pairwise_distance(df, ["g"], "e").collect()}
    s = sims(data)
    for g in range(3):
        ids = [i for i in range(299) if i % 3 == g]
        sub = s[np.ix_(ids, ids)]
        want = 1 - (sub.sum() - len(ids)) / (len(ids) * (len(ids) - 1))
        assert got[g] == pytest.approx(want, abs=1e-9)
    assert got[9] is None


def plain(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<double>, grp bigint, ord bigint")


def test_pairs_of_copies(spark):
    e = [1.0, 0.0]
    q, c = plain(spark, [(1, e, 0, 0), (2, e, 0, 0)]), plain(spark, [(7, e, 0, 0), (8, e, 0, 0)])
    assert {(r.id, r.nid) for r in above(q, c, 0.9, expand=True).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert [(r.copies, r.n_copies) for r in above(q, c, 0.9).collect()] == [(2, 2)]
    g = plain(spark, [(1, e, 0, 0), (2, e, 1, 1), (3, e, 1, 2)])
    assert {(r.id, r.nid) for r in above(g, g, 0.9, Rule(other_group=True), expand=True).collect()} == {(1, 2), (1, 3), (2, 1), (3, 1)}
    assert {(r.id, r.nid) for r in above(g, g, 0.9, Rule(earlier=True), expand=True).collect()} == {(2, 1), (3, 1), (3, 2)}
    assert above(g, g, 0.9, Rule(not_self=True), expand=True).count() == 6
    with pytest.raises(ValueError, match="expand"):
        above(g, g, 0.9, Rule(not_self=True))


def test_ties_go_to_the_earlier_row(spark):
    e = [1.0, 0.0]
    c = plain(spark, [(3, e, 0, 3), *[(i, e, 0, -1) for i in (5, 10, 15, 20, 25)]])
    q = plain(spark, [(99, e, 0, 50)])
    assert [r.nid for r in top_k(q, c, 3, Rule(earlier=True)).orderBy("rank").collect()] == [5, 10, 15]
    assert [r.nid for r in top_k(q, c, 6, Rule(earlier=True)).orderBy("rank").collect()] == [5, 10, 15, 20, 25, 3]


@pytest.mark.parametrize("k, min_sim", [(1, None), (10, None), (10, 0.9), (5, 0.9999999), (400, 0.3)])
def test_closest_pairs(spark, data, k, min_sim):
    x = np.vstack([data[80:], data[:5]])  # few copies
    v = vectors(frame(spark, x), "id", "e")
    whole = sims(x)
    s = np.round(whole, 9)
    pairs = [(-s[i, j], i, j) for i in range(0, len(x), 2) for j in range(1, len(x), 2) if min_sim is None or whole[i, j] > min_sim] if k < 400 else None
    got = [(r.id, r.nid) for r in nearest.closest_pairs(v.where("id % 2 = 0"), v.where("id % 2 = 1"), k, min_sim).orderBy(F.desc(F.round("sim", 9)), "id", "nid").collect()]
    if pairs is not None:
        assert got == [(i, j) for _, i, j in sorted(pairs)[:k]]
    else:
        assert len(got) == 400


def test_depth_follows_the_rows(spark, data):
    small, large = (nearest.Tree(vectors(frame(spark, data[90:90 + n]), "id", "e")) for n in (50, 210))
    assert small.depth == 0 and large.depth >= 1
    assert large.rows.count() == 210 and large.sizes.agg(F.sum("n")).head()[0] == 210
    assert large.rows.select("cell").distinct().count() == large.sizes.count()


def test_equal_rows_that_no_pivot_can_split(spark):
    x = [[1.0, 0.0]] * 60 + [[0.0, 1.0]]
    c = plain(spark, [(i, e, i, 0) for i, e in enumerate(x)])
    got = top_k(c.where("id >= 59"), c, 2, Rule(other_group=True))  # copies of 60 groups stay apart
    assert {(r.id, r.rank, r.nid) for r in got.collect()} == {(59, 1, 0), (59, 2, 1), (60, 1, 0), (60, 2, 1)}


def test_neighbours_of_other_lineages(spark, data):
    from duologue.operators.similarity import neighbours_other_lineage

    rng = np.random.default_rng(8)
    n = 60
    x = data[90:90 + n]
    root, source, side = rng.integers(0, 6, n), rng.integers(0, 25, n), rng.integers(0, 2, n)
    df = spark.createDataFrame([(i, [float(a) for a in x[i]], int(root[i]), int(source[i]), int(side[i])) for i in range(n)], "id bigint, e array<double>, r int, s int, p int")
    got = {(r["id"], r["rank"], r["nid"]) for r in neighbours_other_lineage(df, 4, "id", "e", F.col("r"), F.col("s"), F.col("p")).collect()}
    sim, want = np.round(sims(x), 9), {(i, 0, i) for i in range(n)}
    for q in range(n):
        seen = {}
        for i in range(n):  # the order of the archive
            if root[i] != root[q] and source[i] != source[q]:
                if source[i] not in seen or side[i] == side[q]:
                    seen[source[i]] = i
        near = sorted(seen.values(), key=lambda i: (-sim[q, i], i))[:3]
        want |= {(q, r + 1, i) for r, i in enumerate(near)}
    assert got == want
    few = df.where("id < 5").withColumn("r", F.lit(1))
    assert neighbours_other_lineage(few, 4, "id", "e", F.col("r"), F.col("s"), F.col("p")).count() == 5


@pytest.mark.parametrize("tree", [True, False])
def test_grid_and_tree_agree(spark, data, tree, monkeypatch):
    asked = []
    monkeypatch.setattr(nearest, "_prunes", lambda *_: asked.append(1) or tree)
    monkeypatch.setattr(nearest, "PIECE_ROWS", 40)
    v = vectors(frame(spark, data), "id", "e", group=F.col("id") % 7, order=F.col("id"))
    got = {(r["id"], r["rank"], r["nid"]) for r in top_k(v, v, 4, Rule(earlier=True)).collect()}
    assert got == brute(data, 4, lambda i, j: j < i) and asked
    s = sims(data)
    pairs = {(r["id"], r["nid"]) for r in above(v.where("id >= 80"), v.where("id >= 85"), 0.97, Rule(not_self=True), expand=True).collect()}
    assert pairs == {(i, j) for i in range(80, 300) for j in range(85, 300) if i != j and s[i, j] > 0.97}


def test_what_is_moved_grows_with_the_rows(spark, monkeypatch):
    """On vectors without structure every leaf is open; twice the rows must not move four times the vectors."""
    monkeypatch.setattr(nearest, "PIECES", 3, raising=False)
    monkeypatch.setattr(nearest, "PIECE_ROWS", 100, raising=False)
    x = np.random.default_rng(2).normal(size=(1600, 64))
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    took = []
    for n in (800, 1600):
        v = vectors(frame(spark, x[:n]), "id", "e")
        before = moved()
        assert top_k(v, v, 2, Rule(not_self=True)).count() == 2 * n
        took.append(moved() - before)
    assert took[1] < 2.6 * took[0]


def test_pieces_do_not_grow_with_the_rows():
    assert nearest._pieces(4_000) == nearest._pieces(10_000) == nearest._pieces(600_000) <= 6


def test_no_whole_tree_where_a_few_rows_do_not_prune(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 32))
    v, made, tree = vectors(frame(spark, x), "id", "e"), [], nearest.Tree
    monkeypatch.setattr(nearest, "Tree", lambda rows, rule: made.append(rows.count()) or tree(rows, rule))
    got = {(r["id"], r["rank"], r["nid"]) for r in top_k(v, v, 2, Rule(not_self=True)).collect()}
    assert got == brute(x, 2, lambda i, j: i != j) and max(made) < 200


def test_null_components_only_leave_out_their_row(spark):
    c = plain(spark, [(1, [1.0, 0.0], 0, 0), (2, [float("nan"), 0.0], 0, 0), (3, [0.0, 1.0], 0, 0)])
    got = {(r.id, r.nid) for r in top_k(c, c, 1, Rule(not_self=True)).collect()}
    assert got == {(1, 3), (3, 1)}
    assert nearest.counted(c, c, 0.9).agg(F.sum(F.col("copies") * F.col("n_copies"))).head()[0] == 2
