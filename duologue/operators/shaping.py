"""Record shaping: turns, scores, profiles, pointers, contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.functions.text import head_tail, strip
from duologue.operators.rules import DIMENSIONS
from duologue.operators.scale import top_rows


def clean_turns(turns: DataFrame, speaker: str = "speaker", content: str = "content") -> DataFrame:
    """Drop scene messages and idle turns, private prefixes and outer quotes; drop what is then empty."""
    body = strip(F.regexp_replace(F.col(content), r"^\[private to \[.*?\]\]\s+(?:said:\s*)?", ""))
    quoted = F.startswith(body, F.lit('"')) & F.endswith(body, F.lit('"'))
    inner = F.when(F.length(body) > 1, F.substr(body, F.lit(2), F.length(body) - 2)).otherwise("")
    return (turns.where((F.col(speaker) != "Environment") & ~F.contains(F.col(content), F.lit("did nothing")))
            .withColumn(content, F.when(quoted, inner).otherwise(body)).where(F.col(content) != ""))


# How one turn is written in each transcript format.
LINE_FORMATS = {
    "bank": "concat('[turn ', turn, '] ', speaker, ' -> ', receiver, ': ', content)",
    "judge": "concat('[T', turn, '] ', speaker, ': ', content)",
    "rules": "concat('Turn ', turn, ' [', speaker, ']: ', content)",
    "history": "concat(speaker, ' said: \"', content, '\"')",
    "bare": "concat(speaker, ': ', content)",
}


def render(turns: DataFrame, by: Sequence[str], fmt: str = "judge", cut: str | None = None,
           heading: Column | None = None) -> DataFrame:
    """One text for each transcript, turns in order; optional heading and head+tail cut.

    The result cell is the whole transcript, so its size is the size of one row by definition.
    """
    lines = turns.withColumn("__line", F.expr(LINE_FORMATS[fmt]))
    out = lines.groupBy(*by).agg(F.expr("listagg(__line, '\n') WITHIN GROUP (ORDER BY pos)").alias("text"))
    if heading is not None:
        out = out.withColumn("text", F.concat(heading, F.lit("\n"), F.col("text")))
    if cut:
        out = out.withColumn("text", head_tail(F.col("text"), cut))
    return out.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.lit("(no dialogue)")))


def first_speakers(turns: DataFrame, by: str) -> DataFrame:
    """The first two distinct speakers are learner and partner."""
    firsts = turns.groupBy(by, "speaker").agg(F.min("pos").alias("p"))
    two = top_rows(firsts, [by], [F.col("p"), F.col("speaker")], 2)
    return two.groupBy(by).agg(
        F.coalesce(F.max(F.when(F.col("rn") == 1, F.col("speaker"))), F.lit("the first agent")).alias("learner"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("speaker"))), F.lit("the second agent")).alias("partner"))


def flatten_scores(df: DataFrame, json_col: str, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Judge JSON to flat scores; missing or non-numeric is 0, overall is the mean over all dimensions."""
    schema = "struct<" + ",".join(f"{d}:struct<score:string>" for d in dims) + ">"
    out = df.withColumn("__j", F.from_json(F.col(json_col), schema))
    for d in dims:
        out = out.withColumn(d, F.coalesce(F.col(f"__j.{d}.score").try_cast("double"), F.lit(0.0)))
    total = sum((F.col(d) for d in dims[1:]), F.col(dims[0]))
    return out.withColumn("overall", total / F.lit(float(len(dims)))).drop("__j")


def learner_first(df: DataFrame, index: str, arrays: Sequence[str]) -> DataFrame:
    """Swap the two-element arrays where the learner sits at index 1."""
    for a in arrays:
        df = df.withColumn(a, F.when(F.col(index) == 1, F.reverse(F.col(a))).otherwise(F.col(a)))
    return df.withColumn(index, F.lit(0))


def child_pointers(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent, root, depth + 1 and ancestors of a new child."""
    p = parents.select(
        F.col("id").alias("parent_id"),
        F.coalesce("root", F.col("env"), F.col("id")).alias("root"),
        (F.coalesce("depth", F.lit(0)) + 1).alias("depth"),
        F.concat(F.coalesce("ancestors", F.array().cast("array<bigint>")), F.array("id")).alias("ancestors"))
    return children.join(p, "parent_id", "inner")


def goal_trajectory(attempts: DataFrame, by: str, score: str = "goal") -> DataFrame:
    """Scores in attempt order. A record holds one short list of attempts."""
    pairs = F.array_sort(F.collect_list(F.struct("attempt", F.coalesce(score, F.lit(0.0)).alias("s"))))
    return attempts.groupBy(by).agg(F.transform(pairs, lambda x: x["s"]).alias("trajectory"))


def first_last_delta(attempts: DataFrame, by: str, dims: Sequence[str]) -> DataFrame:
    """Last minus first attempt on each dimension, null as 0; one attempt gives no row."""
    agg = attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.min_by(F.coalesce(d, F.lit(0.0)), "attempt").alias(f"__f_{d}") for d in dims],
        *[F.max_by(F.coalesce(d, F.lit(0.0)), "attempt").alias(f"__l_{d}") for d in dims])
    return agg.where(F.col("__n") >= 2).select(
        by, *[(F.col(f"__l_{d}") - F.col(f"__f_{d}")).alias(f"{d}_delta") for d in dims])


def scale_to_canvas(df: DataFrame, x: str, y: str, width: float, height: float, by: Sequence[str] = ()) -> DataFrame:
    """Min-max scaling of two coordinates; a flat axis uses a range of 1e-9."""
    lim = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))  # one row
    def s(c, lo, hi, size):
        return (F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * F.lit(size)

    return df.crossJoin(F.broadcast(lim)).select(
        *[c for c in df.columns if c not in (x, y)], s(x, "x0", "x1", width).alias(x), s(y, "y0", "y1", height).alias(y))


def context_text(owners: DataFrame, key: str, rules: DataFrame, examples: DataFrame, rules_head: str,
                 examples_head: str, limit: int = 160) -> DataFrame:
    """Numbered rules and cut examples as one text; an owner without either gets an empty text.

    ``rules`` (key, n, text) and ``examples`` (key, n, text) are the short lists a prompt holds.
    """
    def block(df, line, head, name):
        return df.withColumn("__line", line).groupBy(key).agg(F.concat(
            F.lit(head), F.expr("listagg(__line, '\n') WITHIN GROUP (ORDER BY n)")).alias(name))

    r = block(rules, F.concat(F.col("n").cast("string"), F.lit(". "), F.col("text")), rules_head, "__r")
    e = block(examples, F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.left("text", F.lit(limit))),
              examples_head, "__e")
    return owners.join(r, key, "left").join(e, key, "left").select(key, F.concat_ws("\n\n", "__r", "__e").alias("context"))


def band(cls: str = "classification") -> Column:
    """Prompt band of an example; no class counts as frontier."""
    return (F.when(F.col(cls).isNull() | (F.col(cls) == "frontier"), "frontier")
            .when(F.col(cls) == "too_easy", "too_easy").otherwise("beyond_frontier"))


def split_bands(examples: DataFrame, extra_negatives: DataFrame) -> DataFrame:
    """Examples with their band, extra dead ends behind them."""
    e = examples.withColumn("band", band()).withColumn("extra", F.lit(False))
    x = extra_negatives.withColumn("band", F.lit("beyond_frontier")).withColumn("extra", F.lit(True))
    return e.unionByName(x, allowMissingColumns=True)


def exploded_attempts(records: DataFrame) -> DataFrame:
    """M6: attempt rows of bank records; trial counts from 0, success is goal and relationship."""
    a = records.select("scenario_id", "scenario", "learner_goal", F.explode("attempts").alias("a"))
    g = F.coalesce("a.scores.goal", F.lit(0.0))
    r = F.coalesce("a.scores.relationship", F.lit(0.0))
    return a.select("scenario_id", "scenario", "learner_goal", (F.coalesce("a.attempt", F.lit(1)) - 1).alias("trial"),
                    g.alias("goal_score"), ((g >= 7.0) & (r >= 0.0)).alias("success"))
