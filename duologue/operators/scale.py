"""Building blocks that keep one hot key from becoming one hot task.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task, and a window without
a partition puts the whole table there. The helpers below cut the order axis into slices at
approximate quantiles, work inside ``(key, slice)`` and add the totals of the earlier slices.
The quantiles only balance the work; every result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SLICES = 4096
_SLICE = "__slice"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Even work over the cluster before a costly per-row step; an input of few files would keep few tasks.

    The explicit number keeps adaptive execution from merging these light-in-bytes, heavy-in-work parts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *columns)


def _slices_wanted(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, min(MAX_SLICES, parts * 4))


def _place(cuts: list[float], x: Column) -> Column:
    """Number of cuts <= x, found in two steps: about 2*sqrt(n) comparisons a row instead of n."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    nested = F.array(*[F.array(*[F.lit(v) for v in g]) for g in groups])
    coarse = F.size(F.filter(heads, lambda h: h <= x))
    fine = F.size(F.filter(F.get(nested, coarse - 1), lambda h: h <= x))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * F.lit(width) + fine)


def _quantiles(df: DataFrame, on: Column, n: int) -> list[float]:
    probes = [i / n for i in range(1, n)]
    row = df.select(on.cast("double").alias("v")).agg(
        F.percentile_approx("v", probes, max(1000, n * 4)).alias("q")).head()
    return list(row["q"] or [])


def with_slice(df: DataFrame, on: Column, slices: int | None = None, then: Column | None = None,
               out: str = _SLICE) -> DataFrame:
    """Add the slice number of ``on`` (numeric), a monotone function with balanced slices.

    A value that fills more than one slice gets a slice of its own, which is cut again by ``then``, the
    column that orders equal values.
    """
    n = slices or _slices_wanted(df)
    points = _quantiles(df, on, n)
    heavy = sorted({p for p, q in zip(points, points[1:]) if p == q}) if then is not None else []
    cuts = sorted(set(points) | {math.nextafter(h, math.inf) for h in heavy})
    x = on.cast("double")
    # Nulls sort first.
    first = F.when(x.isNull(), F.lit(-1)).otherwise(_place(cuts, x)).cast("bigint")
    if heavy:
        tie = x.isin(heavy)
        inner = _place(sorted(set(_quantiles(df.where(tie), then, n))), then.cast("double"))
        first = first * (n + 1) + F.when(tie, inner).otherwise(0)
    return df.withColumn(out, first)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    split: Column,
    inclusive: bool = True,
    slices: int | None = None,
    then: Column | None = None,
) -> DataFrame:
    """Prefix sums per key in ``order``; ``split`` is a numeric column that ``order`` starts with.

    Where many rows may share one ``split`` value, ``then`` names the second, numeric order column.

    One shuffle of the rows on ``(key, slice)`` and one of the much smaller slice totals. With
    ``inclusive=False`` a row sees only earlier rows (0 for the first).
    """
    keys = list(keys)
    # One struct holds keys and slice: a struct is never null, so rows with null keys join by plain
    # equality, and window and join share one partitioning.
    sliced = with_slice(df, split, slices, then).withColumn("__key", F.struct(*keys, _SLICE)).drop(_SLICE)
    w = Window.partitionBy("__key").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = sliced.withColumns({n: F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in sums.items()})
    totals = sliced.groupBy("__key").agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    owner = [F.col(f"__key.{k}") for k in keys] or [F.lit(0)]
    before = Window.partitionBy(*owner).orderBy(f"__key.{_SLICE}").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_SLICES rows for each key reach this window.
    offsets = totals.select(
        "__key", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    joined = local.join(offsets, "__key", "left")
    joined = joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)) for n in sums})
    return joined.drop("__key", *[f"__o_{n}" for n in sums])


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], split: Column, out: str = "rn",
              slices: int | None = None, then: Column | None = None) -> DataFrame:
    """1-based dense position of every row inside its key, without one task per key."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("bigint")}, split, slices=slices, then=then)


def number_rows(df: DataFrame, out: str) -> DataFrame:
    """1-based position of each row of a scan, in partition order. Rows are not moved: one row for each
    partition is counted and its offset is joined back."""
    at = F.monotonically_increasing_id()
    marked = df.withColumn("__m", at).withColumn("__part", F.shiftright("__m", 33)).withColumn(
        "__idx", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return marked.join(offsets, "__part").withColumn(out, F.col("__off") + F.col("__idx") + 1).drop(
        "__m", "__part", "__idx", "__off")


def near_rows(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int,
              aggregates: dict[str, callable], block: int = 8192) -> DataFrame:
    """Aggregates over the rows ``position-before .. position+after`` (positions are dense, from 1).

    Rows are cut into blocks of consecutive positions; the few rows near a block edge are copied to
    the neighbour block, so a frame never needs more than one block. ``aggregates`` maps an output
    name to a function from the window spec to a column.
    """
    block = max(block, before + after + 1)
    own = F.floor((F.col(position) - 1) / F.lit(block)).cast("bigint")
    offset = F.pmod(F.col(position) - 1, F.lit(block))
    homes = F.array_compact(F.array(
        own,
        F.when(offset >= block - before, own + 1) if before else F.lit(None).cast("bigint"),
        F.when((offset < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
    ))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(homes))
    w = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(-before, after)
    out = spread
    for name, build in aggregates.items():
        out = out.withColumn(name, build(w))
    return out.where(F.col("__own") == F.col("__block")).drop("__own", "__block")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows for each key. Spark limits each map task to n rows a key before the shuffle."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread: Sequence[str],
                salts: int = 64, share: float = 0.001, counts: DataFrame | None = None) -> DataFrame:
    """Equi-join that splits keys holding more than ``share`` of the left rows.

    Hot left keys (at most ``1/share`` of them, so the flag table is bounded) get a salt from the
    ``spread`` columns; the matching right rows are repeated once for each salt. Other rows keep salt 0.
    ``counts`` (on..., __n) saves the counting pass where the caller has it. Works for ``inner``, ``left``, ``left_semi`` and ``left_anti``.
    """
    on = list(on)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    # `total` is one row, `hot` at most 1/share rows.
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") > F.col("__all") * share + 1000).select(
        *on, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    l = left.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return l.join(r, on + ["__salt"], how).drop("__salt")


class SaltedEdges:
    """Edges prepared once for many joins on ``parent``: hot parents are split over salts.

    The edges are checkpointed with their salt; the list of hot parents (at most 1/share) is kept apart.
    """

    def __init__(self, edges: DataFrame, salts: int = 64, share: float = 0.001):
        from duologue.session import cut

        counts = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("__n"))
        total = counts.agg(F.sum("__n").alias("__all"))
        self.hot = cut(counts.crossJoin(F.broadcast(total)).where(F.col("__n") > F.col("__all") * share + 1000).select(
            "parent", F.lit(True).alias("__hot")))
        self.salts = salts if not self.hot.isEmpty() else 1
        salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("child"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
        self.edges = cut(edges.join(F.broadcast(self.hot), "parent", "left").withColumn("__salt", salt).drop("__hot"))

    def children_of(self, frontier: DataFrame, how: str = "inner") -> DataFrame:
        """Edges whose parent is in ``frontier`` (a table with a ``parent`` column)."""
        if self.salts == 1:  # no hot parent in this graph
            return self.edges.drop("__salt").join(frontier, "parent", how)
        copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0)))
        f = frontier.join(F.broadcast(self.hot), "parent", "left").withColumn("__salt", F.explode(copies)).drop("__hot")
        return self.edges.join(f, ["parent", "__salt"], how).drop("__salt")
