"""Exact nearest-neighbour and cosine-threshold joins without a cross join.

Two ways give the same rows; a probe of a few queries says which of them moves fewer vectors.

The grid cuts both sides into a few pieces by hash, PIECES where there are more than a few thousand rows and so many that none has more than
GRID_ROWS, and every pair of pieces is one task. A row travels once for each piece of the other side, so what is moved grows with the rows as long
as PIECES suffice. Inside a task the k best so far are the bound of what is looked at further.

The tree is for corpora with structure. Pivots taken from the corpus cut it into cells (nearest pivot), and large cells are cut again by pivots of their own: a tree whose
depth follows the rows. Angles between unit vectors form a metric, so a query needs a cell only if both bounds allow a match
within its search angle: |angle(q, pivot) - angle(v, pivot)| over the cell's angle range, and half the gap between
angle(q, pivot) and the nearest pivot beside it. The search angle is the wanted similarity, or that of the k-th best row found so
far, which falls from round to round. Nothing is dropped: pruned cells provably hold no better row. Visits of cells travel as ids. Leaves are cut
into blocks of bounded size and their queries into batches, so one hot leaf becomes many small tasks.

Equal vectors are collapsed first: ties go to the row first in ``ord``, then to the smaller id, so of each
group of copies only the k + 1 first can be in any answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duologue.functions.vectors import unit
from duologue.operators.scale import top_rows
from duologue.session import cut

LEAF_ROWS = 8192
FAN = 64  # pivots of a cell
BLOCK_ROWS = 8192
QUERY_ROWS = 512
NEXT = 8  # leaves of the second round
GRID_ROWS = 131_072  # rows of a piece at most
PIECES = 6  # pieces of a side
PIECE_ROWS = 512  # rows that are worth a piece
CHUNK = 1 << 16  # pairs that are taken in double precision at once
PROBES = 512  # queries that try the tree
_SLACK = 1e-7  # guards the bounds against rounding


@dataclass(frozen=True)
class Rule:
    """Which corpus rows a query may meet.

    ``not_self``: ids must differ. ``other_group``: groups must differ. ``earlier``: the corpus row
    comes first in ``ord``. ``pool``: sources (``src``) must differ, the query's group must not be in the corpus row's ``bar``, and it must be the
    row's ``only`` where that is set.
    """

    not_self: bool = False
    other_group: bool = False
    earlier: bool = False
    pool: bool = False

    def allowed(self, q: Side, v: Side, r: np.ndarray, c: np.ndarray) -> np.ndarray | None:
        """Which pairs of query rows ``r`` and corpus rows ``c`` may meet; None, if all."""
        tests = []
        if self.not_self:
            tests.append(q.id[r] != v.id[c])
        if self.other_group:
            tests.append(q.grp[r] != v.grp[c])
        if self.earlier:
            tests.append(v.ord[c] < q.ord[r])
        if self.pool:
            tests.append((q.src[r] != v.src[c]) & (np.isnan(v.only[c]) | (q.grp[r] == v.only[c])) & ~v.barred(c, q.grp[r]))
        return reduce(np.logical_and, tests) if tests else None

    def columns(self) -> list[str]:
        return ["id", "vec", "grp", "ord", *(["src", "bar", "only"] if self.pool else [])]


def vectors(df: DataFrame, id_col: str, vec: str, group: Column | None = None, order: Column | None = None) -> DataFrame:
    """The columns the searches need: id, vec (unit length, double), grp, ord. Rows without a vector go."""
    zero = F.lit(0).cast("bigint")
    return df.where(F.col(vec).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), unit(F.col(vec)).alias("vec"),
        (zero if group is None else group.cast("bigint")).alias("grp"),
        (zero if order is None else order.cast("bigint")).alias("ord"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class Side:
    """The rows of one side in a task as arrays, in the order of ``ord`` and id."""

    def __init__(self, df: pd.DataFrame, vec: np.ndarray):
        order = np.lexsort((df["id"].to_numpy(), df["ord"].to_numpy()))
        df = df.iloc[order]
        self.vec, self.id, self.ord, self.grp = vec[order], df["id"].to_numpy(), df["ord"].to_numpy(), df["grp"].to_numpy()
        self.single = self.vec.astype(np.float32)
        # The product of both sides' rooms is over the rounding of a product in single precision.
        long = np.sqrt((self.vec * self.vec).sum(1))
        self.room = math.sqrt(1.3e-7 * (vec.shape[1] + 8)) * float(long[np.isfinite(long)].max(initial=1.0))
        if "src" in df:
            self.src = df["src"].to_numpy()
        if "only" in df:
            self.only = df["only"].to_numpy(dtype=float, na_value=np.nan)
            bars = [() if b is None else b for b in df["bar"]]
            values = np.concatenate([np.asarray(b, np.int64) for b in bars] + [np.zeros(0, np.int64)])
            self.groups = np.unique(values)
            self.bars = np.unique(np.repeat(np.arange(len(bars)), [len(b) for b in bars]) * (len(self.groups) + 1) + np.searchsorted(self.groups, values))

    def barred(self, c: np.ndarray, grp: np.ndarray) -> np.ndarray:
        """Is the group in the row's ``bar``?"""
        if not len(self.bars):
            return np.zeros(len(c), bool)
        place = np.minimum(np.searchsorted(self.groups, grp), len(self.groups) - 1)
        wanted = c * (len(self.groups) + 1) + place
        at = np.minimum(np.searchsorted(self.bars, wanted), len(self.bars) - 1)
        return (self.groups[place] == grp) & (self.bars[at] == wanted)


_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _candidates(q: Side, v: Side, bound: np.ndarray, at: slice, to: slice, rule: Rule, k: int | None = None) -> _Found:
    """Pairs in a block that may meet and whose similarity is over the bound of the query.

    Products in single precision, with room for their rounding, leave few pairs to be taken in double precision. With ``k``, those that cannot be
    among the k best of the block for their query are left out, too.
    """
    near, room = q.single[at] @ v.single[to].T, q.room * v.room
    least = bound - room
    if k is not None and near.shape[1] > k:
        r, c = np.divmod(np.arange(near.size), near.shape[1])
        ok = rule.allowed(q, v, r + at.start, c + to.start)
        if ok is not None:
            near[~ok.reshape(near.shape)] = -np.inf
        near[np.isnan(near)] = -np.inf
        least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 2 * room - 1e-8)
    r, c = np.divmod(np.flatnonzero(near > least.astype(np.float32)[:, None]), near.shape[1])
    r, c = r + at.start, c + to.start
    ok = rule.allowed(q, v, r, c)
    if ok is not None:
        r, c = r[ok], c[ok]
    sim = np.concatenate([np.einsum("ij,ij->i", q.vec[r[x:x + CHUNK]], v.vec[c[x:x + CHUNK]]) for x in range(0, len(r), CHUNK)] or [np.zeros(0)])
    ok = sim > bound[r - at.start]
    return r[ok], c[ok], sim[ok]


def _blocks(n: int, grown: bool) -> Iterator[slice]:
    """Blocks of columns; ``grown``, they begin small, so that there is a bound early."""
    width, at = min(256, BLOCK_ROWS) if grown else BLOCK_ROWS, 0
    while at < n:
        yield slice(at, min(n, at + width))
        at, width = at + width, min(2 * width, BLOCK_ROWS)


def _meet(q: Side, v: Side, k: int | None, min_sim: float | None, rule: Rule, overall: bool = False) -> Iterator[_Found]:
    """(query row, corpus row, similarity): the k best of each query, or all over ``min_sim``; ``overall``, the k best pairs of all."""
    if not len(q.id) or not len(v.id):
        return
    least = -np.inf if min_sim is None else min_sim
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for first in range(0, len(q.id), QUERY_ROWS):
        rows = slice(first, min(len(q.id), first + QUERY_ROWS))
        bound = np.full(rows.stop - first, least)  # the least similarity that is not enough
        if not overall:
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        elif len(best[2]) == k:
            bound[:] = max(least, float(np.round(best[2], 9).min()) - 1e-9)
        for to in _blocks(len(v.id), k is not None):
            begin = first + int(np.searchsorted(q.ord[rows], v.ord[to.start], "right")) if rule.earlier else first
            if begin == rows.stop:
                break  # what follows is not earlier than any of these
            found = _candidates(q, v, bound[begin - first:], slice(begin, rows.stop), to, rule, k if to.start == 0 and not overall else None)
            if k is None:
                if len(found[0]):
                    yield found
                continue
            if not len(found[0]):
                continue
            r, c, sim = (np.concatenate(x) for x in zip(best, found, strict=True))
            near = np.round(sim, 9)
            if overall:
                order = np.lexsort((v.id[c], q.id[r], -near))[:k]
                if len(order) == k:
                    bound[:] = max(least, float(near[order[-1]]) - 1e-9)
            else:  # columns come in the order of ties
                order = np.lexsort((c, -near, r))
                own = r[order]
                head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                place = np.arange(len(own)) - np.repeat(head, np.diff(np.r_[head, len(own)]))
                last = order[place == k - 1]
                bound[r[last] - first] = np.maximum(least, near[last] + 4e-10)  # a tie comes later, so it is not better
                order = order[place < k]
            best = (r[order], c[order], sim[order])
        if k is not None and not overall:
            yield best
    if overall:
        yield best


def _collapse(corpus: DataFrame, keep: int, rule: Rule) -> DataFrame:
    """Of equal vectors keep the first rows that could appear in an answer."""
    keys = ["vec"] + (["grp"] if rule.other_group else []) + (["src", "bar", "only"] if rule.pool else [])
    w = Window.partitionBy(*keys).orderBy("ord", "id")
    return corpus.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


class Cells:
    """Corpus rows (id, vec, grp, ord, cell) that queries meet by cell; ``sizes`` (cell, n) counts them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))

    def compared(self, queries: DataFrame, visits: DataFrame, k: int | None, min_sim: float | None, rule: Rule) -> DataFrame:
        """(id, nid, sim, nord): for each visit the k best rows of the leaf, or all above ``min_sim``."""
        batches = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("batches")).join(self.sizes, "cell").select(
            "cell", "batches", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = visits.join(batches, "cell").withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches"))).withColumn(
            "block", upto("blocks")).select("id", "cell", "batch", "block").join(queries.select([c for c in rule.columns() if c not in ("bar", "only")]), "id")
        again = batches.select(F.col("cell").alias("cell"), F.col("batches").alias("many"), F.col("blocks").alias("cuts"))
        right = self.rows.join(again, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts"))).withColumn(
            "batch", upto("many")).select(*rule.columns(), "cell", "batch", "block")

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            q, v = Side(left, _matrix(left["vec"])), Side(right, _matrix(right["vec"]))
            found = [(q.id[r], v.id[c], sim, v.ord[c]) for r, c, sim in _meet(q, v, k, min_sim, rule)]
            empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
            return pd.DataFrame(dict(zip(("id", "nid", "sim", "nord"), map(np.concatenate, zip(empty, *found)), strict=True)))

        keys = ["cell", "block", "batch"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "id bigint, nid bigint, sim double, nord bigint")


class Tree(Cells):
    """The corpus in leaves of at most LEAF_ROWS rows, and the cells above them.

    A cell with more rows is split by FAN of its own rows, the pivots: each row goes to the nearest. So the depth follows the number of rows, and a
    step shuffles the rows that still have to be split once. ``nodes`` (parent, cell, pivot, lo, hi) has the range of angles between
    a cell's pivot and its rows; ``rows`` are the corpus rows with their leaf; ``sizes`` (cell, n) are the leaves.
    """

    def __init__(self, corpus: DataFrame, rule: Rule = Rule()):
        cols = rule.columns()
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.select(*cols).schema.fields)
        rows = cut(corpus.select(*cols, F.lit(0).cast("long").alias("cell")))
        self.nodes, leaves, sizes, self.depth = None, [], [], 0
        size = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))).withColumn("whole", F.lit(False))
        while True:
            large = size.where(F.col("n") > LEAF_ROWS).where("not whole")  # what a step could not split stays whole
            if large.isEmpty():
                leaves.append(rows)
                sizes.append(size.select("cell", "n"))
                break
            leaves.append(rows.join(large, "cell", "left_anti"))
            sizes.append(size.join(large, "cell", "left_anti").select("cell", "n"))
            salts = F.ceil(F.col("n") / BLOCK_ROWS)
            part = rows.join(large, "cell").select(*rows.columns, "n", F.pmod(F.xxhash64("id"), salts).alias("salt"))
            pivots = top_rows(part.select("cell", "id", "vec", salts.alias("salts")), ["cell"], [F.xxhash64("id"), F.col("id")], FAN)
            pivots = cut(pivots.select("cell", (F.col("cell") * FAN + F.col("rn")).alias("child"), "vec", "salts"))
            spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

            def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                if not len(left):
                    return pd.DataFrame({c: [] for c in (*cols, "cell", "parent", "angle")})
                right = right.sort_values("child")
                angle = _angles(_matrix(left["vec"]), _matrix(right["vec"]))
                at = angle.argmin(axis=1)
                return left[cols].assign(cell=right["child"].to_numpy()[at], parent=left["cell"], angle=angle[np.arange(len(left)), at])

            rows = cut(part.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInPandas(
                nearest, f"{kinds}, cell bigint, parent bigint, angle double"))
            got = cut(rows.groupBy("cell").agg(F.first("parent").alias("parent"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
                                               F.count(F.lit(1)).alias("n")))
            size = got.join(large.select(F.col("cell").alias("parent"), F.col("n").alias("all")), "parent").select(
                "cell", "n", (F.col("n") == F.col("all")).alias("whole"))
            level = got.select("parent", "cell", "lo", "hi").join(pivots.select(F.col("child").alias("cell"), F.col("vec").alias("pivot")), "cell")
            self.nodes = level if self.nodes is None else self.nodes.unionByName(level)
            rows, self.depth = rows.drop("parent", "angle"), self.depth + 1
        self.rows = reduce(DataFrame.unionByName, leaves)
        self.sizes = reduce(DataFrame.unionByName, sizes)

    def visits(self, queries: DataFrame, greedy: bool) -> DataFrame:
        """(id, cell, bound): the leaf on the way of nearest pivots, or all leaves that may hold a row within the angle ``wide`` of the query.

        ``bound`` is the least angle that a row of the leaf can have.
        """
        now = queries.select("id", "vec", "wide", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("bound"))
        out = "id bigint, cell bigint, bound double"
        if not self.depth:
            return now.select("id", "cell", "bound")

        def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"id": pd.Series(dtype="int64"), "cell": pd.Series(dtype="int64"), "bound": pd.Series(dtype="float64")})
            right = right.sort_values("cell")
            angle = _angles(_matrix(left["vec"]), _matrix(right["pivot"]))
            if greedy:
                return pd.DataFrame({"id": left["id"].to_numpy(), "cell": right["cell"].to_numpy()[angle.argmin(axis=1)], "bound": 0.0})
            lo, hi = right["lo"].to_numpy()[None, :], right["hi"].to_numpy()[None, :]
            bound = np.maximum(np.maximum(lo - angle, angle - hi), (angle - angle.min(axis=1)[:, None]) / 2.0)
            bound = np.maximum(bound, left["bound"].to_numpy()[:, None])
            r, c = np.nonzero(bound <= left["wide"].to_numpy()[:, None] + _SLACK)
            return pd.DataFrame({"id": left["id"].to_numpy()[r], "cell": right["cell"].to_numpy()[c], "bound": bound[r, c]})

        inner, done = self.nodes.select(F.col("parent").alias("cell")).distinct(), []
        vec = queries.select("id", "vec", "wide")
        for _ in range(self.depth):
            at = now.join(inner, "cell", "left_semi")
            batches = at.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("batches"))
            left = at.join(batches, "cell").withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches")))
            right = self.nodes.select(F.col("parent").alias("of"), "cell", "pivot", "lo", "hi").join(
                batches.select(F.col("cell").alias("of"), F.col("batches").alias("many")), "of").withColumn(
                "batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
            below = cut(left.groupBy("cell", "batch").cogroup(right.groupBy("of", "batch")).applyInPandas(step, out))
            done.append(below.join(inner, "cell", "left_anti"))
            now = below.join(vec, "id")  # visits travel as ids; vectors join them once a level
        return reduce(DataFrame.unionByName, done).select("id", "cell", "bound")


def _first_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "nord", "nid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pieces(n: int) -> int:
    return max(1, min(PIECES, -(-n // PIECE_ROWS)), -(-n // GRID_ROWS))


def _grid(queries: DataFrame, corpus: DataFrame, sizes: tuple[int, int], k: int | None, min_sim: float | None, rule: Rule,
          overall: bool = False) -> DataFrame:
    """(id, nid, sim, nord): the k best of each query in each piece of the corpus, all rows above ``min_sim``, or the k best pairs of each task."""
    n, m = map(_pieces, sizes)
    cols = rule.columns()
    upto = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    own = lambda x, seed: F.pmod(F.xxhash64("id", "ord", F.lit(seed)), F.lit(x)).cast("int")
    types = {f.name: f.dataType for f in corpus.schema.fields}
    asked = [F.col(c) if c not in ("bar", "only") else F.lit(None).cast(types[c]).alias(c) for c in cols]
    left = queries.select(*asked, own(n, 1).alias("row"), upto(m).alias("column"), F.lit(0).alias("side"))
    right = corpus.select(*cols, upto(n).alias("row"), own(m, 2).alias("column"), F.lit(1).alias("side"))
    rest = [c for c in cols if c != "vec"]

    def side(t: pa.Table, which: int) -> Side:
        t = t.filter(pc.equal(t["side"], which))
        flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t["vec"].chunks] + [np.zeros(0)])
        df = t.select(rest).to_pandas()
        return Side(df if which else df.drop(columns=["bar", "only"], errors="ignore"), flat.reshape(len(df), -1) if len(df) else np.zeros((0, 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        q, v = side(table, 0), side(table, 1)
        del table
        for r, c, sim in _meet(q, v, k, min_sim, rule, overall):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.id[r], v.id[c], sim, v.ord[c])], ["id", "nid", "sim", "nord"])

    return left.unionByName(right).groupBy("row", "column").applyInArrow(work, "id bigint, nid bigint, sim double, nord bigint")


def _narrowed(q: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The queries with the angle of the k-th best row as their search angle."""
    kth = found.where(F.col("rank") == k).select("id", F.acos(F.least(F.greatest("sim", F.lit(-1.0)), F.lit(1.0))).alias("kth"))
    return q.join(kth, "id", "left").withColumn("wide", F.least("wide", F.coalesce("kth", "wide"))).drop("kth")


def _prunes(tree: Tree, q: DataFrame, sizes: tuple[int, int], k: int | None, min_sim: float | None, rule: Rule) -> bool:
    """Does the tree move fewer vectors than the grid? By the leaves that a few queries open."""
    if not tree.depth:
        return False
    few = cut(q.orderBy(F.xxhash64("id"), "id").limit(PROBES))
    if k is not None:
        found = _first_k(tree.compared(few, tree.visits(few, greedy=True).select("id", "cell"), k, min_sim, rule), k)
        few = cut(_narrowed(few, found, k))
    leaf = tree.sizes.agg(F.avg("n")).head()[0]
    opened = tree.visits(few, greedy=False).count() / max(1, few.count())
    n, m = sizes
    return opened * (1 + leaf / QUERY_ROWS) * n < n * _pieces(m) + m * _pieces(n)


def _search(queries: DataFrame, corpus: DataFrame, k: int | None, min_sim: float | None, rule: Rule) -> DataFrame:
    """(id, nid, sim, nord): the k best for each query, or every row above ``min_sim``, or both limits. By the grid or the tree.

    Leaves of the tree are visited in rounds: first the one on the way of nearest pivots, then the NEXT best ones that the k-th best similarity so far leaves
    open, then all others that are open still.
    """
    corpus = cut(corpus.select(*rule.columns()))
    sizes = queries.count(), corpus.count()
    if sizes[1] <= LEAF_ROWS:
        return _grid(queries, corpus, sizes, k, min_sim, rule)
    wide = math.acos(max(-1.0, min(1.0, min_sim))) if min_sim is not None else math.pi
    q = queries.withColumn("wide", F.lit(wide))
    step = 2 * sizes[1] // (3 * LEAF_ROWS)
    if step > 1:  # if the tree of a few rows does not prune, that of all rows is not made; both ways give the same rows
        few = corpus.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(step)) == 0)
        if not _prunes(Tree(few, rule), q, sizes, k, min_sim, rule):
            return _grid(queries, corpus, sizes, k, min_sim, rule)
    tree = Tree(corpus, rule)
    if not _prunes(tree, q, sizes, k, min_sim, rule):
        return _grid(queries, corpus, sizes, k, min_sim, rule)
    if k is None:
        return tree.compared(q, tree.visits(q, greedy=False), k, min_sim, rule)
    q = cut(q)
    first = cut(tree.visits(q, greedy=True).select("id", "cell"))
    found = cut(_first_k(tree.compared(q, first, k, min_sim, rule), k))
    open_ = cut(tree.visits(_narrowed(q, found, k), greedy=False).join(first, ["id", "cell"], "left_anti"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("bound", "cell"))
    open_ = cut(open_.withColumn("turn", turn))
    for visits in (open_.where(F.col("turn") <= NEXT), open_.where(F.col("turn") > NEXT)):
        near = visits.join(_narrowed(q, found, k).select("id", "wide"), "id").where(F.col("bound") <= F.col("wide") + _SLACK).select("id", "cell")
        found = cut(_first_k(found.drop("rank").unionByName(tree.compared(q, near, k, min_sim, rule)), k))
    return found.drop("rank")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, rule: Rule = Rule(), min_sim: float | None = None) -> DataFrame:
    """(id, rank, nid, sim), ties by the neighbour's ``ord``, then by its smaller id."""
    return _first_k(_search(queries, _collapse(corpus, k + 1, rule), k, min_sim, rule), k).drop("nord")


def best_match(queries: DataFrame, corpus: DataFrame, rule: Rule = Rule(), min_sim: float | None = None) -> DataFrame:
    """(id, nid, sim) of the closest allowed row; queries without one are missing."""
    return top_k(queries, corpus, 1, rule, min_sim).select("id", "nid", "sim")


def above(queries: DataFrame, corpus: DataFrame, min_sim: float, rule: Rule = Rule(), expand: bool = False) -> DataFrame:
    """Pairs with cosine > ``min_sim``. Output grows with the matches, not with all pairs.

    Copies are collapsed on both sides: (id, nid, sim, copies, n_copies) are pairs of representatives with the number of
    rows each stands for. ``expand`` gives every pair of rows (id, nid, sim) instead; a rule on ids or order needs that.
    """
    if expand:
        return _search(queries, corpus, None, min_sim, rule).select("id", "nid", "sim")
    if rule.not_self or rule.earlier:
        raise ValueError("a rule on ids or order is about rows: use expand")
    q, found = _represented(queries, corpus, min_sim, rule)
    return found.join(q.select("id", "copies"), "id")


def _represented(queries: DataFrame, corpus: DataFrame, min_sim: float, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """One query for each group of copies (id, copies), and the pairs (id, nid, sim, n_copies) with representatives of the corpus."""
    keys = ["vec"] + (["grp"] if rule.other_group else [])

    def reps(df: DataFrame) -> DataFrame:
        grp = [] if rule.other_group else [F.lit(0).cast("bigint").alias("grp")]
        return cut(df.groupBy(*keys).agg(F.min("id").alias("id"), *grp, F.count(F.lit(1)).alias("copies")))

    q, c = reps(queries), reps(corpus)
    # No rule here asks for the order, so it carries the number of copies past the search: pairs need no join with the corpus.
    rows = lambda df, order: df.select("id", "vec", "grp", order.alias("ord"))
    found = _search(rows(q, F.lit(0).cast("bigint")), rows(c, F.col("copies")), None, min_sim, Rule(other_group=rule.other_group))
    return q, found.withColumnRenamed("nord", "n_copies")


def counted(queries: DataFrame, corpus: DataFrame, min_sim: float, rule: Rule = Rule()) -> DataFrame:
    """(id, copies, n_copies): for each group of equal queries with a match its rows and the corpus rows above ``min_sim``.

    The tasks add up their pairs, so pairs themselves do not travel.
    """
    if rule.not_self or rule.earlier:
        raise ValueError("a rule on ids or order is about rows")
    q, found = _represented(queries, corpus, min_sim, rule)
    return found.groupBy("id").agg(F.sum("n_copies").alias("n_copies")).join(q.select("id", "copies"), "id")


def closest_pairs(queries: DataFrame, corpus: DataFrame, k: int, min_sim: float | None = None, rule: Rule = Rule()) -> DataFrame:
    """(id, nid, sim) of the k closest pairs, ties to the smaller ids; no other pairs are made.

    Every pair of pieces gives its k best; inside, the k-th best pair so far is the bound of all queries.
    """
    q, c = cut(_collapse(queries, k, rule)), cut(_collapse(corpus, k + 1, rule))
    found = _grid(q, c, (q.count(), c.count()), k, min_sim, rule, overall=True)
    return found.select("id", "nid", "sim").orderBy(F.desc(F.round("sim", 9)), "id", "nid").limit(k)


def duplicates(queries: DataFrame, corpus: DataFrame, limit: float) -> DataFrame:
    """Ids too close to the corpus (max cosine > limit). Zero vectors and an empty corpus pass."""
    live = queries.where(F.exists("vec", lambda x: x != 0))
    return best_match(live, corpus, min_sim=limit).select("id", "nid", "sim")
