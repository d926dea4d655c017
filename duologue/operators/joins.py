"""Equi-joins: assembly, hold-out, pairing, paired comparison, contrast, resume, merge.

Lookup sides carry no broadcast hint: Spark broadcasts them when their size, known or measured at run
time, allows it, and splits skewed partitions of the probe side otherwise (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.operators.scale import rank_rows


def first_per_key(df: DataFrame, key: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """F7 keep-first as an aggregate: combines on the map side, no per-key sort."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*values), order).alias("__v")).select(*key, "__v.*")


def last_per_key(df: DataFrame, key: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("__v")).select(*key, "__v.*")


def assemble(envs: DataFrame, episodes: DataFrame, agents: DataFrame, relations: DataFrame) -> DataFrame:
    """Environment with the agents of its first episode and their shared story.

    envs(env, ...), episodes(env, order, a1, a2), agents(agent, ...), relations(a1, a2, pos, story).
    Unknown agents keep their id only; of several stories for an unordered pair the last non-empty wins.
    """
    first = first_per_key(episodes, ["env"], F.col("order"), ["a1", "a2"])
    base = envs.join(first, "env", "inner")
    info = [c for c in agents.columns if c != "agent"]
    for side in ("a1", "a2"):
        one = agents.select(F.col("agent").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in info],
                            F.lit(True).alias(f"{side}_known"))
        base = base.join(one, side, "left").withColumn(
            f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
    told = relations.where(F.col("story").isNotNull() & ~F.col("story").isin("", "nan")).select(
        F.least("a1", "a2").alias("lo"), F.greatest("a1", "a2").alias("hi"), "pos", "story")
    story = last_per_key(told, ["lo", "hi"], F.col("pos"), ["story"])
    base = base.withColumn("lo", F.least("a1", "a2")).withColumn("hi", F.greatest("a1", "a2"))
    return base.join(story, ["lo", "hi"], "left").drop("lo", "hi").withColumn(
        "story", F.coalesce("story", F.lit("")))


def assembly_misses(assembled: DataFrame) -> DataFrame:
    return assembled.agg(F.count(F.lit(1)).alias("n"),
                         F.sum((~F.col("a1_known")).cast("int") + (~F.col("a2_known")).cast("int")).alias("missing_agents"),
                         F.count_if(F.col("story") == "").alias("missing_stories"))


def without_held_out(df: DataFrame, key: str, *held_out: DataFrame) -> DataFrame:
    """Drop every key found in any hold-out file."""
    keys = held_out[0].select(key)
    for h in held_out[1:]:
        keys = keys.unionByName(h.select(key))
    return df.join(keys.distinct(), key, "left_anti")


def md5_mod(text: Column, n: Column) -> Column:
    """The md5 digest read as one big number, modulo n, folded in 16-bit steps."""
    digest = F.md5(text)
    steps = F.sequence(F.lit(0), F.lit(7))
    return F.aggregate(
        steps, F.lit(0).cast("bigint"),
        lambda acc, i: (acc * 65536 + F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")) % n)


def hash_pairing(envs: DataFrame, pool: DataFrame, key: str, code: str, pos: str, seed: str = "") -> DataFrame:
    """D3: pick one pool row for each environment by md5 of its key.

    Candidates share the environment's code; where none does, the whole pool counts. Both lists are
    numbered first, so the pick is an equi-join on (code, number) and no candidate list is built.
    """
    numbered = rank_rows(pool, [], [F.col(pos)], F.col(pos), "i_all")
    numbered = rank_rows(numbered, [code], [F.col(pos)], F.col(pos), "i_code")
    sizes = pool.groupBy(code).agg(F.count(F.lit(1)).alias("n_code"))
    total = pool.agg(F.count(F.lit(1)).alias("n_all"))  # one row
    e = envs.join(sizes, code, "left").crossJoin(F.broadcast(total))
    text = F.concat(F.lit(seed), F.col(key).cast("string"))
    e = e.withColumn("pick", md5_mod(text, F.coalesce("n_code", "n_all").cast("bigint")) + 1)
    values = [c for c in pool.columns if c != code]
    own = e.where(F.col("n_code").isNotNull()).join(
        numbered.select(code, F.col("i_code").alias("pick"), *values), [code, "pick"], "inner")
    any_ = e.where(F.col("n_code").isNull()).join(
        numbered.select(F.col("i_all").alias("pick"), *values), ["pick"], "inner")
    cols = [*envs.columns, *values]
    return own.select(*cols).unionByName(any_.select(*cols))


def rescore(old: DataFrame, new: DataFrame, key: str, ok_old: Column, ok_new: Column) -> DataFrame:
    """Old rows with new scores; rows without a new score keep theirs and count as missing."""
    j = old.join(new.withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    status = F.when(~hit, "missing").when(ok_old.eqNullSafe(ok_new), "unchanged").otherwise("changed")
    return j.select(key, F.when(hit, ok_new).otherwise(ok_old).alias("success"), status.alias("status"))


def calibrate(seeds: DataFrame, calibration: DataFrame, key: str, frontier=(2.0, 1.0), default=(1.0, 1.0)) -> DataFrame:
    """Calibrated seeds with a softer prior for frontier ones; seeds without a record drop out."""
    f = F.col("classification") == "frontier"
    return seeds.join(calibration, key, "inner").select(
        "*", F.when(f, frontier[0]).otherwise(default[0]).alias("prior_alpha"),
        F.when(f, frontier[1]).otherwise(default[1]).alias("prior_beta"))


def uncalibrated(seeds: DataFrame, calibration: DataFrame, key: str) -> DataFrame:
    """Calibration rows without a seed and calibrated rows without a class."""
    lost = calibration.join(seeds, key, "left_anti").select(key, F.lit("no_seed").alias("problem"))
    blank = calibration.where(F.col("classification").isNull()).join(seeds, key, "left_semi").select(
        key, F.lit("no_class").alias("problem"))
    return lost.unionByName(blank)


def paired_deltas(results: DataFrame, base: str, dims: Sequence[str], rates: dict[str, Column],
                  condition: str = "condition", key: str = "scenario") -> DataFrame:
    """Mean difference to the base condition over shared keys; a missing score counts as 0."""
    cols = {d: F.coalesce(d, F.lit(0.0)) for d in dims} | {n: r.cast("double") for n, r in rates.items()}
    flat = results.select(condition, key, *[c.alias(n) for n, c in cols.items()])
    b = flat.where(F.col(condition) == base).select(key, *[F.col(n).alias(f"__b_{n}") for n in cols])
    # A key occurs once for each condition, so it cannot be hot.
    return flat.where(F.col(condition) != base).join(b, key, "inner").groupBy(condition).agg(
        F.count(F.lit(1)).alias("n_paired"), *[F.avg(F.col(n) - F.col(f"__b_{n}")).alias(f"{n}_delta") for n in cols])


def contrast_pairs(attempts: DataFrame, task: str, success: Column, trial: str, values: Sequence[str]) -> DataFrame:
    """Each success with each failure of the same task.

    A task holds at most K attempts, so its pairs are few by construction (K*K/4 at most).
    """
    a = attempts.withColumn("__ok", success)
    s = a.where("__ok").select(task, F.col(trial).alias("success_trial"), *[F.col(v).alias(f"success_{v}") for v in values])
    f = a.where(~F.col("__ok")).select(task, F.col(trial).alias("fail_trial"), *[F.col(v).alias(f"fail_{v}") for v in values])
    return f.join(s, task, "inner")


def improvement_pairs(attempts: DataFrame, task: str, success: Column, trial: str, goal: str) -> DataFrame:
    """Tasks never solved: first failure against the best later one, kept if the goal rose."""
    base = attempts.groupBy(task).agg(
        F.bool_or(success).alias("__s"), F.min(trial).alias("base_trial"), F.min_by(goal, trial).alias("base_goal"))
    open_ = base.where(~F.col("__s")).drop("__s")
    later = attempts.join(open_, task, "inner").where(F.col(trial) > F.col("base_trial"))
    best = later.groupBy(task).agg(
        F.first("base_trial").alias("base_trial"), F.first("base_goal").alias("base_goal"),
        F.max_by(F.struct(F.col(trial).alias("best_trial"), F.col(goal).alias("best_goal")),
                 F.struct(F.col(goal), -F.col(trial))).alias("__b"))
    return best.select(task, "base_trial", "base_goal", "__b.*").where(F.col("best_goal") > F.col("base_goal"))


def zip_longest(left: DataFrame, right: DataFrame, by: Sequence[str], order: str, left_cols: Sequence[str],
                right_cols: Sequence[str]) -> DataFrame:
    """Pair by position inside a group, leftovers stay alone."""
    l = rank_rows(left, by, [F.col(order)], F.col(order), "n").select(*by, "n", *left_cols)
    r = rank_rows(right, by, [F.col(order)], F.col(order), "n").select(*by, "n", *right_cols)
    return l.join(r, [*by, "n"], "full_outer")


def one_perspective(rows: DataFrame, source: str, pos: str, matches: Column, values: Sequence[str]) -> DataFrame:
    """One row for each source: the last one on the preferred side, else the first seen."""
    last = F.max_by(F.struct(*values), F.when(matches, F.col(pos)))
    first = F.min_by(F.struct(*values), F.col(pos))
    return rows.groupBy(source).agg(F.coalesce(F.when(F.bool_or(matches), last), first).alias("__v")).select(source, "__v.*")


def id_overlap(corpora: dict[str, DataFrame], evaluation: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Ids of any id field that also appear in the evaluation set, for each corpus."""
    def all_ids(df: DataFrame) -> DataFrame:
        arr = F.filter(F.array(*[F.col(i).cast("string") for i in ids]), lambda x: x.isNotNull() & (x != ""))
        return df.select(F.explode(F.array_distinct(arr)).alias("id")).distinct()

    ev = all_ids(evaluation)
    out = None
    for name, df in corpora.items():
        hit = all_ids(df).join(ev, "id", "left_semi").withColumn("corpus", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out


def fold_rules(rows: DataFrame, fold_of: DataFrame, fold_rules_: DataFrame, combined: DataFrame, key: str) -> DataFrame:
    """A held-out row uses the rules of its fold, any other row the combined rules, of which there is one row at most."""
    n = F.count(F.lit(1))
    c = combined.agg(F.when(n <= 1, F.first("rules")).otherwise(F.raise_error(F.lit("more than one row of combined rules"))).alias("__all"))
    j = rows.join(fold_of, key, "left")
    return j.join(fold_rules_, "fold", "left").crossJoin(F.broadcast(c)).select(
        key, "fold", F.coalesce("rules", "__all").alias("rules"))


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str], good: Column) -> DataFrame:
    """Rows still to do; corrupt cached rows are done again."""
    return todo.join(done.where(good).select(*keys).distinct(), list(keys), "left_anti")


def named_subset(rows: DataFrame, lists: DataFrame, name: str, key: str) -> DataFrame:
    """Flag the members of a named list; the list file holds repeats."""
    members = lists.where(F.col("name") == name).select(F.explode("members").alias(key)).distinct().withColumn(
        "in_subset", F.lit(True))
    return rows.join(members, key, "left").withColumn("in_subset", F.coalesce("in_subset", F.lit(False)))


def fill_columns(rows: DataFrame, new: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Fill new columns by key; present values stay unless ``overwrite``."""
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in columns])
    j = rows.join(n, key, "left")

    def present(c):
        return F.when(F.col(c) != "", F.col(c))

    for c in columns:
        pair = (F.col(f"__n_{c}"), present(c)) if overwrite else (present(c), F.col(f"__n_{c}"))
        filled = F.col(f"__n_{c}").isNotNull() & (F.lit(overwrite) | present(c).isNull())
        j = j.withColumn(f"{c}_filled", filled).withColumn(c, F.coalesce(*pair))
    return j.drop(*[f"__n_{c}" for c in columns])
