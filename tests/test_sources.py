"""Readers and sinks on small hand-made files."""

import json

from pyspark.sql import functions as F

from duologue.functions.models import call_model, neutral_votes, needs_revote
from duologue.operators.joins import fill_columns, one_perspective, zip_longest
from duologue.sources import readers as R, sinks as K


def put(path, *objects, raw=()):
    path.write_text("\n".join([json.dumps(o) for o in objects] + list(raw)))
    return str(path)


def test_seeds(spark, tmp_path):
    p = put(tmp_path / "s.jsonl", {
        "env_pk": "e1", "scenario": "A", "source": "src", "codename": "", "agent_goals": ["g"], "relationship_type": 3,
        "agent_profiles": [{"first_name": "Ann", "age": None, "moral_values": ["care", "duty"]}]})
    with open(p, "a") as f:
        f.write("\n\n" + json.dumps({"scenario": "B", "relationship_label": "friends", "agent_profiles": [
            {"first_name": "", "moral_values": "x"}, {"first_name": "Bo"}, ]}) + "\n")
    got = {r["id"]: r for r in R.read_seeds(spark, p).collect()}
    assert set(got) == {"e1_p0", "e1_p1", "seed_2_p0", "seed_2_p1"}
    a, b = got["e1_p0"], got["seed_2_p1"]
    assert [x["first_name"] for x in a["agent_profiles"]] == ["Ann", "Agent2"]
    assert a["agent_profiles"][0]["moral_values"] == "care, duty" and a["agent_profiles"][0]["age"] == 0
    assert a["agent_goals"] == ["g", ""] and a["relationship"] == "3" and a["tag"] == "src" and a["iteration"] == -1
    assert [x["first_name"] for x in b["agent_profiles"]] == ["Unknown", "Bo"] and b["target_agent_idx"] == 1
    assert R.read_seeds(spark, p, limit=1, both_perspectives=False).count() == 1
    d = tmp_path / "many"
    d.mkdir()
    put(d / "a.jsonl", {"scenario": "first"})
    (d / "b.jsonl").write_text("\n".join(json.dumps({"env_pk": f"k{i}", "scenario": "later " * 50}) for i in range(300)))
    one = R.read_seeds(spark, str(d), limit=1, both_perspectives=False).collect()
    assert [(r["id"], r["scenario"]) for r in one] == [("seed_1_p0", "first")]  # by file name, not by size
    assert R.read_seeds(spark, str(d)).count() == 602


def test_probes(spark, tmp_path):
    p = put(tmp_path / "p.jsonl", {"_format_doc": "x"}, {
        "id": "p1", "scenario": "S", "agent_profiles": [{"name": "Ann  Lee Poe"}, {"name": "Bo"}], "structured_goals": [
            {"outcome": "o", "constraint": "c", "shortcut": "s"}, None]}, raw=["# note", ""])
    rows = R.read_probes(spark, p).collect()
    assert len(rows) == 1 and rows[0]["relationship"] == "acquaintance" and rows[0]["target_agent_idx"] == 0
    assert [(x["first_name"], x["last_name"]) for x in rows[0]["agent_profiles"]] == [("Ann", "Lee Poe"), ("Bo", "")]
    assert rows[0]["structured_goals"][1] is None
    p = put(tmp_path / "q.jsonl", {"scenario": 'talks about "_format_doc" here'}, {"scenario": "T"})
    ids = [r["id"] for r in R.read_probes(spark, p).collect()]
    assert len(ids) == 2 and all(i.startswith("probe_") and len(i) == 18 for i in ids)


def test_archive_keys(spark, tmp_path):
    new = put(tmp_path / "a.json", {"tasks": [{"id": "t1", "iteration": 3}], "failed_tasks": [{"id": "f1"}]})
    old = put(tmp_path / "b.json", {"successful": [{"id": "s1", "embedding": [1.0, 2.0]}]})
    lines = put(tmp_path / "c.jsonl", {"id": "l1"}, {"id": "l2"})
    assert {(r["bucket"], r["id"]) for r in R.read_archive(spark, new).collect()} == {("tasks", "t1"), ("failed_tasks", "f1")}
    assert [r["id"] for r in R.read_archive(spark, old).collect()] == ["s1"]
    assert R.read_archive(spark, lines).count() == 2
    assert R.read_archive(spark, str(tmp_path / "gone.json")).count() == 0
    assert R.read_archive(spark, str(tmp_path / "x.csv")).count() == 0


def test_record_folders(spark, tmp_path):
    d = tmp_path / "bank"
    d.mkdir()
    for i, s in enumerate(["completed", "in_progress", None]):
        put(d / f"r{i}.json", {"id": f"r{i}", "status": s, "scenario": "long " * 30, "classification": "frontier", "attempts": [
            {"attempt": 2, "scores": {"goal": 8.0}, "solved": True}, {"attempt": 1, "scores": {"goal": 3.0}, "solved": False}]})
    (d / "bad.json").write_text('{"id": "x", ')
    good, bad = R.read_bank(spark, str(d))
    assert {r["id"] for r in good.collect()} == {"r0", "r2"} and bad.count() == 1
    mart = R.reader_mart(good).collect()
    assert mart[0]["goal_trajectory"] == [3.0, 8.0] and mart[0]["category"] == "frontier_solved"
    e = tmp_path / "ep"
    e.mkdir()
    put(e / "1.json", {"scenario_id": "a", "scores": {"goal": 7}, "seed_idx": 1})
    put(e / "2.json", {"scenario_id": "b", "scores": {}, "error": "boom"})
    assert [r["scenario_id"] for r in R.read_episodes(spark, str(e)).collect()] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "completed"), (2, "in_progress")], "id bigint, status string")
    K.write_records(df, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").glob("status=*")} == {"status=completed", "status=in_progress"}
    K.write_records(spark.createDataFrame([(2, "completed"), (3, "completed")], "id bigint, status string"), str(tmp_path / "r"))
    kept, _ = R.read_bank(spark, str(tmp_path / "r"), multi_line=False)
    assert {r["id"] for r in kept.collect()} == {"1", "2", "3"}  # 2 was in progress, 1 was not written again
    for i in (1, 2, 10):
        K.write_snapshot(df.limit(i), str(tmp_path / "s"), i)
    K.write_snapshot(df.limit(1), str(tmp_path / "s"), 10)
    assert K.read_latest(spark, str(tmp_path / "s")).count() == 1
    good, bad = K.split_quarantine(df, F.col("id") == 2, F.lit("why"), ["id"])
    assert (good.count(), bad.collect()[0]["reason"]) == (1, "why")


def test_pool_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 5.0), (2, 0, 1.0)], "task_idx bigint, trial bigint, goal double")
    pool = R.rows_to_pool(rows).agg(F.map_from_entries(F.collect_list(F.struct(F.col("task_idx").cast("string"), "trajectories"))).alias("m"))
    assert sorted(map(tuple, R.pool_to_rows(pool, "m").collect())) == sorted(map(tuple, rows.collect()))


def test_model_calls(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client(texts):
        with open(log, "a") as f:
            f.write("x")
        if "boom" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "boom")], "id string, t string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"]) for r in call_model(df, "id", "t", client, batch=2, tries=3, first_delay=0.0).collect()}
    assert got["1"] == ("A", None) and got["2"] == ("B", None)
    assert got["3"][0] is None and "down" in got["3"][1]
    assert len(open(log).read()) == 4  # one good batch, three tries of the other
    v = spark.createDataFrame([("s", " A ", None), ("s", "x", None), ("s", None, "down")], "scenario string, answer string, error string")
    n = neutral_votes(v)
    assert [r["verdict"] for r in n.collect()] == ["A", "no_difference", "no_difference"]
    lp = spark.createDataFrame([("s", 0.0, 1)], "scenario string, lp_value double, n_error_votes int")
    assert needs_revote(n, lp).count() == 1


def test_join_edges(spark):
    rows = spark.createDataFrame([(1, "old"), (2, ""), (3, None)], "k bigint, t string")
    new = spark.createDataFrame([(1, "n1"), (2, "n2")], "k bigint, t string")
    assert {r["k"]: (r["t"], r["t_filled"]) for r in fill_columns(rows, new, "k", ["t"]).collect()} == {
        1: ("old", False), 2: ("n2", True), 3: (None, False)}
    assert {r["k"]: r["t"] for r in fill_columns(rows, new, "k", ["t"], True).collect()} == {1: "n1", 2: "n2", 3: None}
    one = spark.createDataFrame([("s", 0, 1), ("s", 1, 0), ("s", 2, 1), ("t", 3, 0), ("t", 4, 0)], "src string, pos bigint, side int")
    got = one_perspective(one, "src", "pos", F.col("side") == 1, ["pos"])
    assert {r["src"]: r["pos"] for r in got.collect()} == {"s": 2, "t": 3}
    l = spark.createDataFrame([("g", 1), ("g", 2)], "g string, l bigint")
    r = spark.createDataFrame([("g", 7)], "g string, r bigint")
    z = zip_longest(l.withColumn("o", F.col("l")), r.withColumn("o", F.col("r")), ["g"], "o", ["l"], ["r"])
    assert sorted((x["n"], x["l"], x["r"]) for x in z.collect()) == [(1, 1, 7), (2, 2, None)]
