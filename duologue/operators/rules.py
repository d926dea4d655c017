"""Success rules, failure taxonomy and attempt-level checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds, dimension ranges and blend weights that results depend on.
GOAL_MIN = 7.0
REL_MIN = 0.0
DIMENSIONS = ["believability", "relationship", "knowledge", "secret", "social_rules",
              "financial_and_material_benefits", "goal"]
DIMENSION_RANGES = {
    "believability": (0.0, 10.0),
    "relationship": (-5.0, 5.0),
    "knowledge": (0.0, 10.0),
    "secret": (-10.0, 0.0),
    "social_rules": (-10.0, 0.0),
    "financial_and_material_benefits": (-5.0, 5.0),
    "goal": (0.0, 10.0),
}
PROGRESS_WEIGHTS = {"goal": 0.6, "relationship": 0.2, "knowledge": 0.2}
FULL_CHARGE = 6  # votes charged when a child carries no votes of its own
CLASSES = ["too_easy", "frontier", "beyond_frontier"]
OPERATORS = ["escalate", "lateral", "relax"]


def _c(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def success(rule: str, goal_min: float = GOAL_MIN, judge: str = "judge", key: str = "key_ok") -> Column:
    """The success rule is always named by the caller.

    ``full`` goal, relationship, judge and key; ``goal_rel``; ``goal``; ``judge_first`` judge flag if
    present, else the goal score.
    """
    goal_ok = _c("goal") >= goal_min
    rel_ok = _c("relationship") >= REL_MIN
    if rule == "full":
        return goal_ok & rel_ok & F.coalesce(F.col(judge), F.lit(False)) & F.coalesce(F.col(key), F.lit(False))
    if rule == "goal_rel_judge":
        return goal_ok & rel_ok & F.coalesce(F.col(judge), F.lit(False))
    if rule == "goal_rel":
        return goal_ok & rel_ok
    if rule == "goal":
        return goal_ok
    if rule == "judge_first":
        return F.coalesce(F.col(judge), goal_ok)
    raise ValueError(f"unknown success rule {rule!r}")


def compare_rules(df: DataFrame, judge: str = "judge", key: str = "key_ok") -> DataFrame:
    """Rows for each combination of the full, goal+relationship and goal-only rules."""
    return df.groupBy(
        success("full", judge=judge, key=key).alias("full_rule"),
        success("goal_rel").alias("goal_rel_rule"),
        success("goal").alias("goal_rule"),
    ).agg(F.count(F.lit(1)).alias("n"))


def failure_mode(judge: str = "judge") -> Column:
    """Six ordered buckets; a missing score counts as 0."""
    g, r = _c("goal"), _c("relationship")
    ok = F.coalesce(F.col(judge), F.lit(False))
    return (
        F.when((g >= GOAL_MIN) & (r >= REL_MIN) & ~ok, "goal_score_ok_but_judge_rejected")
        .when((g >= GOAL_MIN) & (r < REL_MIN), "goal_ok_rel_negative")
        .when((g < GOAL_MIN) & (r < REL_MIN), "both_goal_and_rel_failed")
        .when(g >= 5.0, "goal_close_but_insufficient")
        .when(g >= 3.0, "goal_partial")
        .otherwise("goal_very_low")
    )


def normalised(name: str) -> Column:
    """A dimension mapped to [0, 1] by its own range and clamped."""
    lo, hi = DIMENSION_RANGES.get(name, (0.0, 10.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(name) - lo) / F.lit(hi - lo)))


def progress_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted blend of normalised dimensions divided by the weight sum."""
    weights = weights or PROGRESS_WEIGHTS
    total = sum(weights.values())
    if total <= 0:
        return F.lit(0.0)
    blend = F.lit(0.0)
    for name, w in weights.items():
        blend = blend + F.lit(w) * normalised(name)
    return blend / F.lit(total)


def derived_key_check(met: str = "conditions_met", tripped: str = "triggers_tripped",
                      repaired: str = "triggers_repaired") -> Column:
    """At least one condition met and every tripped trigger repaired."""
    none = F.array().cast("array<bigint>")
    open_triggers = F.array_except(F.coalesce(F.col(tripped), none), F.coalesce(F.col(repaired), none))
    return (F.size(F.coalesce(F.col(met), none)) > 0) & (F.size(open_triggers) == 0)


def class_by_goal() -> Column:
    return (F.when(F.col("goal") >= GOAL_MIN, "too_easy").when(F.col("goal") >= 3.0, "frontier")
            .otherwise("beyond_frontier"))


def reader_category(cls: str = "classification", solved: str = "solved") -> Column:
    """Four reader categories from class and solved flag."""
    return (F.when(F.col(cls) == "too_easy", "too_easy")
            .when((F.col(cls) == "frontier") & F.col(solved), "frontier_solved")
            .when(F.col(cls) == "frontier", "frontier_unsolved")
            .otherwise("beyond_frontier"))


def operator_for_class(cls: str = "classification") -> Column:
    """Next mutation operator: escalate what is too easy, relax what is out of reach."""
    return (F.when(F.col(cls) == "too_easy", "escalate").when(F.col(cls) == "beyond_frontier", "relax")
            .otherwise("lateral"))


def node_role(iteration: str = "iteration", rejected: str = "rejected", scored: str | None = None) -> Column:
    """Seed before iteration 0, else rejected, else (optionally) succeeded, else generated."""
    role = F.when(F.col(iteration) < 0, "seed").when(F.coalesce(F.col(rejected), F.lit(False)), "failed_int")
    if scored:
        role = role.when(F.col(scored).isNotNull(), "succeeded")
    return role.otherwise("generated")
