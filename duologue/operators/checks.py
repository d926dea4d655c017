"""Filters, predicates and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.functions.fuzzy import near_items_udf, over_udf, partial_ratio_udf, reaches_udf
from duologue.functions.text import strip

# Allowed tags, and the patterns that mark guidance nobody can act on in talk.
KEY_MECHANISMS = ["reactance", "face_needs", "validation_before_change", "procedural_voice", "reciprocity_disclosure"]
KEY_ARTIFACTS = [
    r"\bin writing\b",
    r"\bwritten (guarantee|agreement|commitment|confirmation|assurance|contract|statement|sign[- ]?off)\b",
    r"\bsign(ed|s|ature)\b", r"\bsign[- ]?off\b", r"\bcontract\b", r"\bescrow\b",
    r"\b(send|sends|sent|email|emails|emailed|forward|forwards|forwarded) (a |an |the )?"
    r"(email|document|confirmation|note|letter|memo)\b",
    r"\b(documented|documentation)\b", r"\breceipt\b", r"\bnotari", r"\bon paper\b",
]
ENTRY_ARTIFACTS = [r"\bwritten\b", r"\breceipt\b", r"\btimestamp", r"\bsealed\b", r"\brecorded\b", r"\brecording\b",
                   r"\bphotograph", r"\bescrow\b", r"\bdocument(ed|ation)?\b", r"\bemail\b", r"\bsign(ed|ature)\b",
                   r"\bin writing\b"]
ENTRY_CROSS_REFERENCES = [r"\bsee (the )?[A-Z]", r"\bsee entry\b", r"\bprotocol\b", r"\b(FINAL|ENTRY|NEW)_\d"]
ENTRY_OVERCLAIMS = [r"\balways\b", r"\bnever fails\b", r"\breliably\b", r"\bregularly\b"]
PROVENANCE = r"attempt\s*\d"


def mixed_categories(df: DataFrame, category: Column, passed: Column, min_pass: int = 1, min_fail: int = 1,
                     min_total: int = 5) -> DataFrame:
    """Categories with both outcomes and enough rows."""
    g = df.groupBy(category.alias("category")).agg(
        F.count_if(passed).alias("n_pass"), F.count_if(~passed).alias("n_fail"))
    return g.where((F.col("n_pass") >= min_pass) & (F.col("n_fail") >= min_fail)
                   & (F.col("n_pass") + F.col("n_fail") >= min_total))


def first_hit(text: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """The first pattern found in the text, else null. One scan for all of them settles texts without any."""
    flag = "(?i)" if ignore_case else ""
    which = F.coalesce(*[F.when(F.rlike(text, F.lit(flag + p)), F.lit(p)) for p in patterns])
    return F.when(any_hit(text, patterns, flag), which)


def any_hit(text: Column, patterns: Sequence[str], flag: str = "") -> Column:
    """Whether any pattern is found, in one scan: a shared word boundary is tested once, not for each pattern.

    For lists that ignore case pass the lower-case text.
    """
    if all(p.startswith(r"\b") for p in patterns):
        joined = r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    else:
        joined = "|".join(f"(?:{p})" for p in patterns)
    return F.rlike(text, F.lit(flag + joined))


def first_problem() -> Column:
    """First reason a generated scenario is invalid, null if it is sound.

    Expects scenario, agent_profiles (array of structs), agent_structured_goals (array of structs),
    partner_goal, relationship, interaction_type, partner_key (struct); a null is a missing field.
    """
    c = F.col
    checks: list[tuple[Column, str]] = []
    for f in ("scenario", "agent_profiles", "agent_structured_goals", "partner_goal", "relationship",
              "interaction_type", "partner_key"):
        checks.append((c(f).isNull(), f"Missing field: {f}"))
    checks.append((F.size("agent_profiles") != 2, "agent_profiles must be a list of exactly 2 profiles"))
    for i in (0, 1):
        for f in ("first_name", "occupation", "big_five"):
            v = F.get("agent_profiles", F.lit(i))[f]
            checks.append((v.isNull() | (v == ""), f"Agent profile {i} missing/empty field: {f}"))
    checks.append((F.size("agent_structured_goals") != 2, "agent_structured_goals must be a list of exactly 2 entries"))
    learner = F.get("agent_structured_goals", F.lit(0))
    checks.append((learner.isNull(), "agent_structured_goals[0] (learner) must be a dict"))
    for f in ("outcome", "constraint", "shortcut"):
        checks.append((learner[f].isNull() | (strip(learner[f]) == ""), f"agent_structured_goals[0] missing/empty field: {f}"))
    checks.append((F.get("agent_structured_goals", F.lit(1)).isNotNull(), "agent_structured_goals[1] must be null"))
    checks.append((strip(c("partner_goal")) == "", "partner_goal must be a non-empty string"))
    key = c("partner_key")
    for f in ("key_mechanism", "movement_conditions", "hardening_triggers", "surface_misdirection", "cost_coupling"):
        checks.append((key[f].isNull(), f"partner_key missing field: {f}"))
    checks.append((~key["key_mechanism"].isin(KEY_MECHANISMS), "partner_key.key_mechanism is not a known tag"))
    checks.append((F.size(key["movement_conditions"]) < 1, "partner_key.movement_conditions must be a non-empty list"))
    checks.append((F.size(key["hardening_triggers"]) < 1, "partner_key.hardening_triggers must be a non-empty list"))
    checks.append((F.length("scenario") < 50, "scenario too short (< 50 chars)"))
    return F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in checks])


def _names(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(strip(x))), lambda x: x != ""))


def surface_novelty(pairs: DataFrame, child_names: str, anchor_names: str, child_text: str, anchor_text: str,
                    limit: float = 90.0) -> DataFrame:
    """Reused first names, and near-verbatim text; every pair with two texts is compared, whatever its names."""
    reused = F.array_intersect(_names(F.col(child_names)), _names(F.col(anchor_names)))
    a, b = F.lower(strip(F.coalesce(child_text, F.lit("")))), F.lower(strip(F.coalesce(anchor_text, F.lit(""))))
    out = pairs.withColumn("reused_names", reused)
    ask = (a != "") & (b != "")
    short = lambda x: F.when(ask, x).otherwise("")  # noqa: E731  a Python function runs on every row, so others get nothing to do
    return out.withColumn("text_similarity", F.when(ask, partial_ratio_udf(limit)(short(a), short(b))).otherwise(F.lit(0.0))).withColumn(
        "is_clone", F.col("text_similarity") > limit).withColumn(
        "passes", (F.size("reused_names") == 0) & ~F.col("is_clone"))


def key_delta(pairs: DataFrame, slots: dict[str, tuple[str, str]], declared: str, child_names: str, anchor_names: str,
              child_text: str, anchor_text: str, limit: float = 90.0, floor: float = 60.0) -> DataFrame:
    """At least one declared slot must differ, names must be kept, the text must stay close.

    ``slots`` maps a slot letter to its (child, anchor) text columns.
    """
    said = F.transform(F.coalesce(F.col(declared), F.array().cast("array<string>")), lambda x: F.lower(strip(x)))
    known = F.filter(said, lambda x: x.isin(*slots))
    plain = lambda x: F.lower(strip(F.coalesce(x, F.lit(""))))
    # A Python function runs on every row, so rows whose answer does not matter get nothing to do.
    given = lambda ask, x: F.when(ask, x).otherwise("")
    same = over_udf(limit)
    changed = F.lit(False)
    out = pairs
    for s, (c, a) in slots.items():
        declares = F.array_contains(known, s)
        out = out.withColumn(f"__r_{s}", same(given(declares, plain(c)), given(declares, plain(a))))
        changed = changed | (declares & ~F.col(f"__r_{s}"))
    a, b = plain(child_text), plain(anchor_text)
    ask = (F.size(known) > 0) & (a != "") & (b != "")
    out = out.withColumn("__near", reaches_udf(floor)(given(ask, a), given(ask, b)))
    lost = F.array_except(_names(F.col(anchor_names)), _names(F.col(child_names)))
    issues = F.array_compact(F.array(
        F.when(F.size(known) == 0, F.lit("no_key_slot")),
        F.when((F.size(known) > 0) & ~changed, F.lit("slots_unchanged")),
        F.when((F.size(known) > 0) & (F.size(lost) > 0), F.lit("names_changed")),
        F.when(ask & ~F.col("__near"), F.lit("text_drifted"))))
    return out.withColumn("issues", issues).drop("__near", *[f"__r_{s}" for s in slots])


def key_leaks(df: DataFrame, key: str, conditions: str, triggers: str, public: Column, partner_public: Column,
              limit: float = 85.0) -> DataFrame:
    """C4: one row for each condition or trigger with its leak and artifact findings.

    Conditions are held against everything public, triggers only against what the partner sees.
    """
    none = F.array().cast("array<string>")
    own, other = (F.coalesce(F.col(items), none) for items in (conditions, triggers))
    low = lambda items: F.transform(items, F.lower)
    seen = F.when(partner_public == public, F.lit(None)).otherwise(F.lower(F.coalesce(partner_public, F.lit(""))))  # null: the same text
    near = near_items_udf(limit)(low(own), F.lower(public), low(other), seen)

    def judged(kind: str, items: Column, leaks: Column) -> Column:
        return F.transform(F.arrays_zip(items.alias("item"), leaks.alias("leaks")), lambda x: F.struct(F.lit(kind).alias("kind"), x["item"].alias("item"), x["leaks"].alias("leaks")))

    rows = df.select(key, own.alias("__own"), other.alias("__other"), near.alias("__near"))
    rows = rows.select(key, judged("movement_condition", F.col("__own"), F.col("__near.own")).alias("__c"), judged("hardening_trigger", F.col("__other"), F.col("__near.other")).alias("__t"))
    return rows.select(key, F.inline(F.concat("__c", "__t"))).select(
        key, "kind", "item", "leaks", first_hit(F.col("item"), KEY_ARTIFACTS).alias("artifact"))


def entry_issues(both_lower: Column, guidance: Column, guidance_lower: Column, provenance: Column) -> Column:
    """Issues of one rule entry, in fixed order."""
    return F.array_compact(F.array(
        F.when(any_hit(both_lower, ENTRY_ARTIFACTS), F.lit("unexecutable")),
        F.when(any_hit(guidance, ENTRY_CROSS_REFERENCES), F.lit("not_self_contained")),
        F.when(any_hit(guidance_lower, ENTRY_OVERCLAIMS), F.lit("overgeneralised")),
        F.when(~F.rlike(F.coalesce(provenance, F.lit("")), F.lit(f"(?i){PROVENANCE}")), F.lit("bad_provenance"))))


def entry_quality(entries: DataFrame, owner: str, max_entries: int = 3) -> DataFrame:
    """Entries with their issues, plus a flag for owners holding too many."""
    over = entries.groupBy(owner).agg((F.count(F.lit(1)) > max_entries).alias("too_many"))
    low = entries.withColumn("__low", F.lower("guidance"))
    both = F.concat(F.lower("condition"), F.lit("\n"), F.col("__low"))
    issues = low.withColumn("issues", entry_issues(both, F.col("guidance"), F.col("__low"), F.col("provenance")))
    return issues.drop("__low").join(over, owner)


def validity_flags(attempts: DataFrame, turns: DataFrame, key: str, goal_ok: Column, key_ok: Column,
                   closing: str = "left the conversation", max_turns: int = 6) -> DataFrame:
    """Key passed but goal unmet, goal met but key failed, and short talks that end by leaving."""
    a = attempts.groupBy(key).agg(F.bool_or(key_ok & ~goal_ok).alias("key_without_goal"),
                                  F.bool_or(goal_ok & ~key_ok).alias("goal_without_key"))
    t = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.max_by("content", "pos").alias("last"))
    t = t.select(key, ((F.col("n_turns") <= max_turns) & F.contains(F.col("last"), F.lit(closing))).alias("early_exit"))
    return a.join(t, key, "full_outer")


def runnable(envs: DataFrame, pairings: DataFrame, held_out: DataFrame, key: str, code: str) -> DataFrame:
    """Scenario present, two non-empty goals, a pairing for the relationship code, not held out."""
    goals = F.filter(F.coalesce("goals", F.array().cast("array<string>")), lambda g: g.isNotNull() & (g != ""))
    ok = envs.where(F.col("scenario").isNotNull() & (F.col("scenario") != "") & (F.size(goals) >= 2))
    codes = pairings.select(code).distinct()
    return ok.join(codes, code, "left_semi").join(held_out.select(key).distinct(), key, "left_anti")


GATES = ["leak", "embed", "coherence", "surface_novelty", "diversity"]


def gate_ladder(cands: DataFrame, slot: str, score: str, pos: str, fails: dict[str, Column]) -> DataFrame:
    """Walk candidates best first; the first without a failed gate wins, a coherence failure stops the walk.

    Returns each candidate with its place (leaking ones have none), first failed gate, and verdict.
    """
    gate = F.coalesce(*[F.when(F.coalesce(fails[g], F.lit(False)), F.lit(g)) for g in GATES])
    order = F.struct((-F.coalesce(F.col(score), F.lit(0.0))).alias("s"), F.col(pos).alias("p"))
    c = cands.withColumn("gate", gate).withColumn("__o", order)
    ends = c.groupBy(slot).agg(
        F.min(F.when(F.col("gate") == "coherence", F.col("__o"))).alias("__stop"),
        F.min(F.when(F.col("gate").isNull(), F.col("__o"))).alias("__win"))
    j = c.join(ends, slot)
    before_stop = F.col("__stop").isNull() | (F.col("__o") <= F.col("__stop"))
    before_win = F.col("__win").isNull() | (F.col("__o") <= F.col("__win"))
    verdict = (F.when(F.col("gate") == "leak", "dropped")
               .when(F.col("gate").isNull() & before_stop & (F.col("__o") == F.col("__win")), "admitted")
               .when(before_stop & (before_win | (F.col("__win") > F.col("__stop"))) & F.col("gate").isNotNull(), "rejected")
               .otherwise("not_reached"))
    return j.withColumn("verdict", verdict).drop("__o", "__stop", "__win")


def gate_outcome(walked: DataFrame, slot: str, id_col: str) -> DataFrame:
    """Admitted candidate of each slot, or the reason there is none."""
    w = walked.groupBy(slot).agg(
        F.max(F.when(F.col("verdict") == "admitted", F.col(id_col))).alias("admitted"),
        F.bool_and(F.col("verdict") == "dropped").alias("__all"))
    return w.select(slot, "admitted", F.when(F.col("admitted").isNull(), F.when(
        F.col("__all"), "all_candidates_leaked_key").otherwise("no_candidate_passed_gates")).alias("reason"))
