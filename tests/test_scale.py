"""The splitting helpers against brute force, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from duologue.operators.scale import SaltedEdges, near_rows, number_rows, rank_rows, running_sums, salted_join, top_rows, with_slice


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(("hot" if rng.random() < 0.6 else rng.choice([None, "a", "b"])), rng.randrange(10_000), i, rng.randrange(5))
            for i in range(3000)]


def frame(spark, rows, parts=8):
    return spark.createDataFrame(rows, "k string, o bigint, id bigint, v bigint").repartition(parts)


def expected(rows):
    out, pos, tot = {}, {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        pos[k] = pos.get(k, 0) + 1
        tot[k] = tot.get(k, 0) + v
        out[i] = (pos[k], tot[k])
    return out


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("slices", [4, 97])
def test_running_sums_and_ranks(spark, rows, parts, slices):
    df = frame(spark, rows, parts)
    got = running_sums(df, ["k"], [F.col("o"), F.col("id")], {"n": F.lit(1), "t": F.col("v")}, F.col("o"), slices=slices)
    assert {r["id"]: (r["n"], r["t"]) for r in got.collect()} == expected(rows)
    got = rank_rows(df, ["k"], [F.col("o"), F.col("id")], F.col("o"), "rn", slices)
    assert {r["id"]: r["rn"] for r in got.collect()} == {i: x[0] for i, x in expected(rows).items()}


def test_exclusive_sums(spark, rows):
    got = running_sums(frame(spark, rows), ["k"], [F.col("o"), F.col("id")], {"t": F.col("v")}, F.col("o"), inclusive=False)
    want = {i: x[1] for i, x in expected(rows).items()}
    by_id = {r[2]: r[3] for r in rows}
    assert {r["id"]: r["t"] + by_id[r["id"]] for r in got.collect()} == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, o bigint, id bigint, v bigint")
    assert rank_rows(df, ["k"], [F.col("o")], F.col("o")).count() == 0


def test_heavy_value_is_cut_again(spark):
    df = spark.range(4000).withColumn("o", F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 50))
    cut = with_slice(df, F.col("o"), 16, F.col("id"))
    assert cut.where("o = -1").groupBy("__slice").count().agg(F.max("count")).head()[0] < 1000
    assert cut.where("o <> -1").agg(F.min("__slice")).head()[0] > cut.where("o = -1").agg(F.max("__slice")).head()[0]
    got = rank_rows(df, [], [F.col("o"), F.col("id")], F.col("o"), slices=16, then=F.col("id")).collect()
    want = sorted(got, key=lambda r: (r["o"], r["id"]))
    assert [r["rn"] for r in want] == list(range(1, 4001))


def test_all_orders_equal(spark):
    df = spark.range(500).withColumn("o", F.lit(7))
    got = rank_rows(df, [], [F.col("o"), F.col("id")], F.col("o"))
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, 501))


@pytest.mark.parametrize("block", [1, 13, 8192])
def test_near_rows(spark, block):
    vals = [random.Random(5).randrange(9) for _ in range(200)]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(vals)], "i bigint, v bigint")
    got = near_rows(df, [], "i", 9, 3, {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count("v").over(w)}, block)
    for r in got.collect():
        win = vals[max(0, r["i"] - 10):r["i"] + 3]
        assert (r["s"], r["n"]) == (sum(win), len(win))
    assert got.count() == 200


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    left = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (99, "q")], "k bigint, w string")
    got = salted_join(left, right, ["k"], how, ["id"], salts=8)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_edges_with_a_hub(spark):
    e = spark.range(4000).select(F.when(F.col("id") < 3500, 0).otherwise(F.col("id") % 9).alias("parent"), (F.col("id") + 10).alias("child"))
    g = SaltedEdges(e, salts=4)
    assert g.salts == 4
    front = spark.createDataFrame([(0, "s"), (0, "t"), (4, "s")], "parent bigint, seed string")
    want = sorted(map(tuple, e.join(front, "parent").select("parent", "child", "seed").collect()))
    assert sorted(map(tuple, g.children_of(front).select("parent", "child", "seed").collect())) == want


def test_top_rows_limits_before_the_shuffle(spark, rows):
    df = top_rows(frame(spark, rows), ["k"], [F.col("o"), F.col("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert df.count() == 3 * len({r[0] for r in rows})


def test_number_rows(spark):
    df = number_rows(spark.range(0, 1000, 1, 7), "n")
    assert all(r["id"] + 1 == r["n"] for r in df.collect())
