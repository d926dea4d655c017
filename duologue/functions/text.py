"""Text columns: cleaning, rendering formats, cuts, fixed label and pattern lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered substring rules, the first match gives the label.
UMBRELLA_LABELS = [
    ("negotiat", "negotiation"), ("bargain", "negotiation"), ("deal-or-no-deal", "negotiation"),
    ("persua", "persuasion"), ("mediat", "mediation"), ("conflict", "conflict"), ("dispute", "conflict"),
    ("competit", "competition"), ("rivalr", "competition"), ("cooperat", "cooperation"),
    ("collabor", "cooperation"), ("support", "support"), ("comfort", "support"), ("decept", "deception"),
    ("manipulat", "deception"), ("interview", "interview"), ("interrog", "interrogation"),
    ("apolog", "reconciliation"), ("reconcil", "reconciliation"), ("confront", "confrontation"),
    ("ethic", "ethical_dilemma"), ("moral", "ethical_dilemma"), ("dilemma", "ethical_dilemma"),
    ("polic", "policy_discussion"), ("discussion", "discussion"), ("conversation", "discussion"),
    ("planning", "planning"), ("decision", "decision_making"), ("mentor", "mentorship"),
    ("teach", "mentorship"), ("advice", "advising"), ("complaint", "complaint"), ("apology", "reconciliation"),
    ("social_iqa", "everyday_social"), ("social_chemistry", "everyday_social"), ("normbank", "norm_negotiation"),
    ("mutual_friend", "interpersonal"), ("hand-craft", "hand_crafted"), ("family", "family"),
    ("workplace", "workplace"), ("community", "community"), ("school", "education"), ("educat", "education"),
]
# Relationship label of each code.
RELATIONSHIP_LABELS = {0: "strangers", 1: "know each other by name", 2: "acquaintances", 3: "friends",
                       4: "romantic relationship", 5: "family members"}
# Fixed values: (longest text kept whole, head, tail, marker).
TEXT_CUTS = {
    "bank": (4000, 1333, 2667, "\n...[truncated]...\n"),
    "judge": (4000, 3000, 1000, "\n[...]\n"),
    "probe": (6000, 4500, 1500, "\n[...truncated...]\n"),
    "reflection": (3000, 1000, 2000, "\n...[truncated]...\n"),
    "key_check": (5000, 2500, 2500, "\n...[middle truncated]...\n"),
}


# Every character that counts as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_text(c: Column) -> Column:
    """Drop NUL, turn no-break spaces to spaces, trim."""
    return strip(F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit("\xa0"), F.lit(" ")))


def umbrella_label(c: Column) -> Column:
    """First matching substring rule; empty is unknown, no match keeps the raw label."""
    s = F.lower(strip(c))
    out = F.when(c.isNull() | (c == ""), F.lit("unknown"))
    for needle, label in UMBRELLA_LABELS:
        out = out.when(F.contains(s, F.lit(needle)), F.lit(label))
    return out.otherwise(c)


def head_tail(c: Column, cut: str | tuple[int, int, int, str]) -> Column:
    """Head + marker + tail for texts longer than the limit."""
    limit, head, tail, marker = TEXT_CUTS[cut] if isinstance(cut, str) else cut
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(tail)))).otherwise(c)


def render_goal(outcome: Column, constraint: Column, shortcut: Column) -> Column:
    """B2: one goal sentence from its three parts; empty parts vanish."""
    def bare(c: Column) -> Column:
        return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.+$", "")

    o, c, s = bare(outcome), bare(constraint), strip(F.coalesce(shortcut, F.lit("")))
    return F.concat(
        F.when(o != "", F.concat(F.lit("Your goal is to "), o)).otherwise(F.lit("Your goal is to act in your interest")),
        F.when(c != "", F.concat(F.lit(", without "), c)).otherwise(F.lit("")),
        F.lit("."),
        F.when(s != "", F.concat(F.lit(" <extra_info>"), s, F.lit("</extra_info>"))).otherwise(F.lit("")),
    )


def drop_without(c: Column) -> Column:
    """The renderer writes "without", so a literal one at the start goes."""
    t = strip(c)
    return F.when(F.startswith(F.lower(t), F.lit("without ")), F.ltrim(F.substr(t, F.lit(9)))).otherwise(t)


def embedding_text(scenario: Column, kind: Column, relationship: Column, goals: Column, learner: Column) -> Column:
    """B1: text a scenario is embedded by, from the learner's side; missing goals are skipped."""
    mine, other = F.get(goals, learner), F.get(goals, 1 - learner)
    return F.concat_ws(
        "\n", F.concat(F.lit("Scenario: "), F.coalesce(scenario, F.lit(""))),
        F.concat(F.lit("Interaction type: "), F.coalesce(kind, F.lit(""))),
        F.concat(F.lit("Relationship: "), F.coalesce(relationship, F.lit(""))),
        F.concat(F.lit("Learner goal: "), mine), F.concat(F.lit("Partner goal: "), other))


def structural_key(dynamic: Column, perspective: Column, title: Column, scenario: Column) -> Column:
    """B1: `dynamic | perspective`, else title, else either part, else the first 200 letters of the scenario."""
    sd, tp = (strip(F.coalesce(x, F.lit(""))) for x in (dynamic, perspective))
    fallback = F.coalesce(F.nullif(title, F.lit("")), F.nullif(sd, F.lit("")), F.nullif(tp, F.lit("")),
                          F.left(F.coalesce(scenario, F.lit("")), F.lit(200)))
    return F.when((sd != "") & (tp != ""), F.concat(sd, F.lit(" | "), tp)).otherwise(strip(fallback))


def parse_title(title: Column, kind: Column) -> tuple[Column, Column, Column]:
    """`left | right`, both needed; else a title made from the interaction type."""
    parts = F.split(title, r"\|", 2)
    left, right = strip(F.get(parts, 0)), strip(F.get(parts, 1))
    good = (F.size(parts) == 2) & (left != "") & (right != "")
    base = F.coalesce(F.nullif(kind, F.lit("")), F.lit("social interaction"))
    l = F.when(good, left).otherwise(base)
    r = F.when(good, right).otherwise(F.concat(F.lit("skills from the target agent navigating "), base))
    return F.concat(l, F.lit(" | "), r), l, r


def pronoun(gender: Column) -> Column:
    """Pronoun text of a gender text."""
    g = F.lower(F.coalesce(gender, F.lit("")))
    return (F.when(F.startswith(g, F.lit("woman")) | (g == "female"), "she/her")
            .when(F.startswith(g, F.lit("man")) | (g == "male"), "he/him").otherwise("they/them"))


def comma_list(c: Column) -> Column:
    """Comma text to trimmed non-empty items."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def int_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def relationship_code(label: Column) -> Column:
    """Code of a label, unknown labels are acquaintances (2)."""
    codes = F.create_map(*[x for k, v in RELATIONSHIP_LABELS.items() for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.try_element_at(codes, F.lower(F.coalesce(label, F.lit("")))), F.lit(2))


def relationship_label(code: Column) -> Column:
    labels = F.create_map(*[x for k, v in RELATIONSHIP_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(labels, code.cast("int")), code.cast("string"))


def with_background(scenario: Column, background: Column) -> Column:
    """Shared history appended to the scenario."""
    b = strip(F.coalesce(background, F.lit("")))
    return F.when(b != "", F.concat(F.regexp_replace(scenario, r"(?U)\s+$", ""),
                                    F.lit("\n\nBackground on their relationship: "), b)).otherwise(scenario)
