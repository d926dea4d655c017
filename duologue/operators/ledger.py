"""Ordered folds over operation logs, and parsed rule entries.

A fold is sequential inside one run by definition. Runs are spread over tasks and each run streams
through its task in order, batch by batch; only the short rule list of the current run is in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.functions.text import strip

# The operation pattern, words a rule may not hold, entry kinds and the standing note.
OPERATION_PATTERN = r"((?:REMOVE|EDIT|ADD|AGREE)(?: \d+|)): (?:[a-zA-Z\s\d]+: |)(.*)"
BANNED_WORDS = ["ADD", "AGREE", "EDIT"]
ENTRY_TYPES = ["HEURISTIC", "WARNING"]
ENTRY_DIMENSIONS = ["GOAL", "FIN", "REL", "BEL", "KNO", "SOC", "SEC"]
STANDING_NOTE = "Note: Later clauses take precedence over earlier ones when their conditions apply."


def parse_operations(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """M1: operations of a text in order: (pos, op, num, rule)."""
    pat = F.lit("(?d)" + OPERATION_PATTERN)
    ops = F.arrays_zip(F.regexp_extract_all(F.col(text), pat, F.lit(1)).alias("o"),
                       F.regexp_extract_all(F.col(text), pat, F.lit(2)).alias("t"))
    rows = df.select(*keep, F.posexplode(ops).alias("pos", "m"))
    rule = strip(F.col("m.t"))
    ok = (rule != "") & F.endswith(rule, F.lit("."))
    for w in BANNED_WORDS:
        ok = ok & ~F.contains(rule, F.lit(w))
    kind = F.element_at(F.split(F.trim("m.o"), " "), 1)
    num = F.when(kind != "ADD", F.nullif(F.regexp_extract("m.o", r"(\d+)", 1), F.lit("")).cast("int"))
    return rows.where(ok).select(*keep, "pos", kind.alias("op"), num.alias("num"), rule.alias("rule"))


def parse_votes(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """M3: operations of a text, one a line: ADD text, UPVOTE n, DOWNVOTE n, EDIT n text; other lines (DONE, notes) say nothing.

    Gives (pos, op, num, rule) as ``fold`` with ``apply_votes`` takes them; pos is the line from 0.
    """
    line = strip(F.col("line"))
    rest = strip(F.expr("substring(l, length(op) + 1)"))
    number = F.regexp_extract("rest", r"^[+]?(\d{1,9})(\s|$)", 1)
    said = F.when(F.col("op") == "ADD", F.col("rest")).when(
        F.col("op") == "EDIT", strip(F.regexp_extract("rest", r"(?s)^\S+\s+(.*)$", 1))).otherwise(F.lit(""))
    rows = df.select(*keep, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "line"))
    rows = rows.select(*keep, "pos", line.alias("l")).withColumn("op", F.regexp_extract("l", r"^(ADD|UPVOTE|DOWNVOTE|EDIT)\s", 1))
    rows = rows.where(F.col("op") != "").withColumn("rest", rest).withColumn("num", F.when(
        F.col("op") != "ADD", F.nullif(number, F.lit("")).cast("int"))).withColumn("rule", said)
    ok = F.when(F.col("op") == "ADD", F.col("rule") != "").when(
        F.col("op") == "EDIT", F.col("num").isNotNull() & (F.col("rule") != "")).otherwise(F.col("num").isNotNull())
    return rows.where(ok).select(*keep, "pos", "op", "num", "rule")


Rules = list[list]  # [text, count]


def apply_operations(rules: Rules, ops: list[tuple[str, int | None, str]], full: bool) -> Rules:
    """M2: one batch of operations against the current list, in the order REMOVE, AGREE, EDIT, ADD."""

    def find(text: str) -> int | None:
        return next((i for i, r in enumerate(rules) if r[0] in text), None)

    sound = []
    for op, num, text in ops:
        at = find(text)
        if op == "ADD":
            if at is None:
                sound.append((op, num, text))
        elif op == "EDIT":
            if at is not None:
                sound.append(("AGREE", at + 1, rules[at][0]))
            elif num is not None and num <= len(rules) and rules:
                sound.append((op, num, text))
        elif at is not None:
            sound.append((op, num, text))
    for turn in ("REMOVE", "AGREE", "EDIT", "ADD"):
        for op, num, text in sound:
            if op != turn:
                continue
            if op == "ADD":
                rules.append([text, 2])
            elif op == "EDIT":
                rules[num - 1] = [text, rules[num - 1][1] + 1]
            else:
                at = find(text)
                if at is not None:
                    rules[at][1] += 1 if op == "AGREE" else (-3 if full else -1)
    return sorted((r for r in rules if r[1] > 0), key=lambda r: -r[1])


def apply_votes(rules: Rules, ops: list[tuple[str, int | None, str]], full: bool = False) -> Rules:
    """M3: ADD, UPVOTE, DOWNVOTE and EDIT by number, one after another."""
    for op, num, text in ops:
        at = None if num is None else num - 1
        known = at is not None and 0 <= at < len(rules)
        if op == "ADD" and text:
            rules.append([text, 2])
        elif op == "UPVOTE" and known:
            rules[at][1] += 1
        elif op == "DOWNVOTE" and known:
            rules[at][1] -= 1
        elif op == "EDIT" and known and text:
            rules[at][0] = text
    return [r for r in rules if r[1] > 0]


def fold(ops: DataFrame, run: str, step: str, apply: Callable[..., Rules], max_rules: int = 10,
         top: int | None = None) -> DataFrame:
    """M2/M3: final rule list of every run: (run, place, rule, count).

    ops(run, step, pos, op, num, rule); all operations of a step are one batch. The list counts as full
    from ``max_rules + 5`` rules on.
    """
    ordered = ops.select(F.col(run).cast("string").alias("run"), F.col(step).cast("bigint").alias("step"), "pos", "op",
                         F.col("num").cast("int").alias("num"), "rule")
    n = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = ordered.repartition(n, "run").sortWithinPartitions("run", "step", "pos")

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        pending: list = []
        rules: Rules = []

        def flush():
            nonlocal rules, pending
            if pending:
                rules = apply(rules, pending, max_rules + 5 <= len(rules))
                pending = []

        def emit(name):
            final = sorted(rules, key=lambda r: -r[1])[:top] if top else rules
            return pd.DataFrame({"run": [name] * len(final), "place": range(1, len(final) + 1),
                                 "rule": [r[0] for r in final], "count": [r[1] for r in final]})

        for b in batches:
            for r in b.itertuples(index=False):
                if at is not None and (r.run, r.step) != at:
                    flush()
                    if r.run != at[0]:
                        yield emit(at[0])
                        rules = []
                at = (r.run, r.step)
                pending.append((r.op, None if pd.isna(r.num) else int(r.num), r.rule))
        if at is not None:
            flush()
            yield emit(at[0])

    return ordered.mapInPandas(go, "run string, place int, rule string, count int")


def _tag(block: Column, tag: str) -> Column:
    return strip(F.regexp_extract(block, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def parse_entries(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """M4: tag blocks to rows; unknown kinds get a default and the standing note is taken out."""
    pat = r'(?s)<Entry\s+id="([^"]+)">.*?</Entry>'
    # One scan of the text; the id and the tags come from the short blocks.
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pat), F.lit(0))).alias("pos", "b"))
    b = F.col("b")
    kind, dim = F.upper(_tag(b, "Type")), F.upper(_tag(b, "Dimension"))
    return rows.select(
        *keep, "pos", strip(F.regexp_extract(b, r'^<Entry\s+id="([^"]+)">', 1)).alias("entry_id"),
        _tag(b, "Condition").alias("condition"),
        strip(F.replace(_tag(b, "Guidance"), F.lit(STANDING_NOTE), F.lit(""))).alias("guidance"),
        F.when(kind.isin(ENTRY_TYPES), kind).otherwise("HEURISTIC").alias("entry_type"),
        F.when(dim.isin(ENTRY_DIMENSIONS), dim).otherwise("GOAL").alias("dimension"),
        _tag(b, "Provenance").alias("provenance"))


def parse_edit_reasons(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """M5: (pos, entry_id, reason) of every edit."""
    pat = F.lit(r'(?s)<EditReason\s+id="([^"]+)">(.*?)</EditReason>')
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), pat, F.lit(1)).alias("i"),
                         F.regexp_extract_all(F.col(text), pat, F.lit(2)).alias("r"))
    return df.select(*keep, F.posexplode(found).alias("pos", "m")).select(
        *keep, "pos", strip(F.col("m.i")).alias("entry_id"), strip(F.col("m.r")).alias("reason"))


def flagged_ids(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """M5: ids flagged as misleading."""
    pat = F.lit(r'<MisdirectionFlag\s+id="([^"]+)"\s*/>')
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(text), pat, F.lit(1))).alias("entry_id"))


def merge_entries(current: DataFrame, edits: DataFrame, entries: DataFrame, owner: str) -> DataFrame:
    """M5: entries after all edits; an edit needs an entry of the same step and id.

    current(owner, pos, entry_id, body, provenance), edits(owner, step, pos, entry_id),
    entries(owner, step, pos, entry_id, body, provenance). A known id keeps its place, a new one is
    appended under an id that names its owner, with its step added to the provenance.
    """
    e = entries.groupBy(owner, "step", "entry_id").agg(F.max_by(F.struct("body", "provenance"), "pos").alias("v"))
    valid = edits.groupBy(owner, "step", "entry_id").agg(F.max("pos").alias("pos")).join(e, [owner, "step", "entry_id"])
    known = current.select(owner, "entry_id", F.lit(True).alias("known"))
    valid = valid.join(known, [owner, "entry_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    own_name = F.col("known") | F.contains("entry_id", F.lit("_"))
    named = valid.withColumn("final_id", F.when(own_name, F.col("entry_id")).otherwise(
        F.concat_ws("_", F.col(owner).cast("string"), "entry_id"))).withColumn("sticky", own_name)
    new = named.select(owner, "final_id", "step", "pos", "v.body", "v.provenance", "known", "sticky")
    old = current.select(owner, F.col("entry_id").alias("final_id"), F.lit(-1).cast("bigint").alias("step"), "pos", "body",
                         "provenance", F.lit(True).alias("known"), F.lit(True).alias("sticky"))
    when = F.struct("step", "pos")
    g = old.unionByName(new).groupBy(owner, "final_id").agg(
        F.min(when).alias("place"), F.max_by(F.struct("step", "body", "provenance", "known", "sticky"), when).alias("v"))
    fresh = ~F.col("v.known") & (~F.col("v.sticky") | (F.col("place.step") == F.col("v.step")))
    step = F.col("v.step").cast("string")
    stamp = F.concat(F.col(owner).cast("string"), F.lit(" attempt "), step)
    prov = F.coalesce(F.col("v.provenance"), F.lit(""))
    joined = F.regexp_replace(F.concat(prov, F.lit(", "), stamp), r"^[, ]+|[, ]+$", "")
    return g.select(owner, F.col("final_id").alias("entry_id"), F.col("place"), F.col("v.body").alias("body"),
                    F.when(fresh & ~F.contains(prov, step), joined).otherwise(prov).alias("provenance"))
