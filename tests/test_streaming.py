"""Streams read in slices give the batch result."""

import pytest
from pyspark.sql import functions as F

from duologue.operators import summaries as S
from duologue.streaming import jobs as J


@pytest.fixture(scope="module")
def sliced(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("in") / "events")
    df = spark.range(600).select("id", (F.col("id") % 7).alias("k"), (F.col("id") * 37 % 11).cast("double").alias("v"),
                                 F.when(F.col("id") % 3 == 0, "too_easy").otherwise("frontier").alias("terminal_state"),
                                 (F.col("id") % 4).alias("improved"), F.lit(6).alias("total"))
    for i in range(4):
        df.where(F.floor(F.col("id") / 150) == i).coalesce(1).write.mode("append").parquet(d)
    return d, spark.read.parquet(d)


def stream(spark, sliced):
    return J.file_stream(spark, sliced[0], sliced[1].schema, files_per_batch=1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rolling_summary(spark, sliced):
    got = J.last_batch(J.run_to_table(J.rolling_summary(stream(spark, sliced), "k", F.col("v") > 5, F.col("id") % 10 == 0), "complete"))
    want = sliced[1].groupBy("k").agg(S.n_rows().alias("total"), S.n_rows(F.col("id") % 10 == 0).alias("errors"),
                                      S.n_rows((F.col("id") % 10 != 0) & (F.col("v") > 5)).alias("passed"))
    assert rows(got) == rows(want)


def test_posterior(spark, sliced):
    got = J.last_batch(J.run_to_table(J.posterior_stream(stream(spark, sliced), "k"), "complete"))
    want = S.posterior(sliced[1].withColumn("solved", F.lit(True)), "k").select("k", "alpha_votes", "beta_votes", "n_selected")
    assert rows(got) == rows(want)


def test_bounded_slope(spark, sliced):
    table = J.stateful(J.bounded_slope(stream(spark, sliced), "k", "id", "v"))
    assert table.select("batch").distinct().count() == 4
    for r in J.last_value(table, ["key"]).collect():
        vals = [x["v"] for x in sliced[1].where(F.col("k") == int(r["key"])).orderBy("id").collect()][-10:]
        assert r["n"] == 10 and r["slope"] == pytest.approx(sum(vals[5:]) / 5 - sum(vals[:5]) / 5)


def test_latest_versions(spark, sliced):
    got = J.latest_versions(stream(spark, sliced).select("k", "id", "v"), "k", "id")
    want = sliced[1].groupBy("k").agg(F.max("id").alias("id")).join(sliced[1].select("k", "id", "v"), ["k", "id"])
    assert rows(got.select("k", "id", "v")) == rows(want)


def test_admission_remembers_earlier_batches(spark, tmp_path):
    d = str(tmp_path / "vecs")
    schema = "id bigint, e array<double>"
    for i, vecs in enumerate([[[1.0, 0.0], [1.0, 0.01]], [[0.999, 0.0], [0.0, 1.0]]]):
        spark.createDataFrame([(i * 2 + j, v) for j, v in enumerate(vecs)], schema).coalesce(1).write.mode("append").parquet(d)
    got = {r["id"]: r for r in J.admit(J.file_stream(spark, d, schema, 1), "id", "e", 0.9, "id").collect()}
    first = {i for i in got if got[i]["batch"] == 0}
    assert all(got[i]["admitted"] for i in first)
    late = set(got) - first
    # The near copy of an admitted row is turned down, the other one is not.
    assert sorted(got[i]["admitted"] for i in late) == [False, True]
    assert max(got[i]["within_batch_dupe"] for i in {0, 1}) > 0.99


def test_every_n_rows(spark, sliced):
    fired = []
    got = J.every_n_rows(stream(spark, sliced), 250, fired.append).orderBy("batch").collect()
    assert [r["total"] for r in got] == [150, 300, 450, 600] and fired == [300, 600]


def parts(sliced, n=3):
    return [sliced[1].where(F.col("id") % n == i) for i in range(n)]


def test_slope_goes_on_after_a_stop(spark, sliced):
    """Every part is a run of its own, which finds the state of the one before."""
    table = J.fed(parts(sliced), lambda s, out, checkpoint: J.stateful(J.bounded_slope(s, "k", "id", "v"), out, checkpoint))
    assert table.select("batch").distinct().count() == 3
    for r in J.last_value(table, ["key"]).collect():
        vals = [x["v"] for x in sliced[1].where(F.col("k") == int(r["key"])).orderBy("id").collect()][-10:]
        assert r["n"] == 10 and r["slope"] == pytest.approx(sum(vals[5:]) / 5 - sum(vals[:5]) / 5)


def test_ticks_go_on_after_a_stop(spark, sliced):
    fired = []
    got = J.fed(parts(sliced), lambda s, out, checkpoint: J.every_n_rows(s, 250, fired.append, out, checkpoint)).orderBy("batch").collect()
    assert [r["total"] for r in got] == [200, 400, 600] and fired == [400, 600]


def test_admission_goes_on_after_a_stop(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 120)] + 0.05 * rng.normal(size=(120, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, e array<double>")
    got = J.fed([df.where(F.col("id") % 4 == k) for k in range(4)],
                lambda s, out, checkpoint: J.admit(s, "id", "e", 0.99, "id", out, checkpoint, pivots=5)).collect()
    kept = [i for i in range(120) if i % 4 == 0]
    for b in (1, 2, 3):
        kept += [i for i in range(b, 120, 4) if (u[i] @ u[kept].T).max() <= 0.99]
    assert sorted(r.id for r in got if r.admitted) == sorted(kept) and 20 < len(kept) < 100
    assert {r.id: r.batch for r in got} == {i: i % 4 for i in range(120)}
