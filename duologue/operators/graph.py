"""Connected components by contraction and stars, for graphs of any shape and size.

Every step writes edges from a node to a smaller one that it is connected with. Before edges are shuffled, each task contracts its own
to a spanning forest of depth one (union-find), so that cycles, repeated edges and most of the length of paths never travel. A forest that one task can hold is
the answer. Otherwise edges are sorted by node over ranges, and the neighbours of a node hang on the smallest of them: large stars and small
stars in turn (Kiveris et al., 2014). A range may end in the middle of a hub's neighbours; the few nodes at the ends of ranges are
settled by the driver, which sees two rows for each range. So no node is a task of its own, and none needs a salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.session import Steps

EDGES = 1 << 19
_SCHEMA = "u long, v long, key long, more long"


class Forest:
    """Union-find over the edges of one task; the root of a tree is its smallest node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        r = up.setdefault(a, a)
        while up[r] != r:
            r = up[r]
        while up[a] != r:
            up[a], a = r, up[a]
        return r

    def tie(self, u: list[int], v: list[int]) -> None:
        for a, b in zip(u, v, strict=True):
            a, b = self.root(a), self.root(b)
            if a < b:
                self.up[b] = a
            elif b < a:
                self.up[a] = b

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of every node that is not a root."""
        nodes = [a for a, b in self.up.items() if a != b]
        return np.array(nodes, np.int64), np.array([self.root(a) for a in nodes], np.int64)


def _rows(u, v, key=None, more=None) -> pa.RecordBatch:
    n = len(u)
    cols = [pa.array(c, pa.int64()) if c is not None else pa.nulls(n, pa.int64()) for c in (u, v, key, more)]
    return pa.RecordBatch.from_arrays(cols, ["u", "v", "key", "more"])


def contracted(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(u, v): the spanning forest of each partition's edges(u, v), every node tied to the smallest of its tree; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            forest.tie(b.column(0).to_pylist(), b.column(1).to_pylist())
            if len(forest.up) > at_once:
                yield _rows(*forest.edges()).select(["u", "v"])
                forest = Forest()
        yield _rows(*forest.edges()).select(["u", "v"])

    plain = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    return plain.mapInArrow(work, "u long, v long")


def _hung(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step over edges(u, v). Rows of the first node of a range carry it as ``key``, since its smallest neighbour may lie before.

    In a large star, larger neighbours hang on the smallest one, and there is work if the node itself is not that; in a small star all
    neighbours are smaller, and there is work if they differ. Rows with ``more`` are the ends of a range: the node ``key``, the smallest
    neighbour seen here, and whether it has rows to move. The row without u counts the other nodes with work (some of them twice).
    """
    ranged = edges.repartitionByRange(parts, "u", "v").sortWithinPartitions("u", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, busy = Forest(), 0
        first = last = None  # of the first node and the latest one: node, its smallest neighbour here or itself, has it rows to move
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(u):
                continue
            starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            node, low = u[starts], np.minimum(u[starts], v[starts])
            goes_on = last is not None and last[0] == node[0]
            if goes_on:
                low[0] = last[1]
            lows = np.repeat(low, np.diff(np.r_[starts, len(u)]))
            move = v > u if large else v != lows
            has = np.add.reduceat(move, starts, dtype=np.int64) > 0
            if goes_on:
                has[0] |= last[2]
            ends = [(int(node[k]), int(low[k]), bool(has[k])) for k in (0, -1)]
            if first is None or ends[0][0] == first[0]:
                first = ends[0]
            last = ends[1]
            busy += int((has & (low < node) & (node != first[0])).sum())
            to_u, to_v, of = v[move], lows[move], u[move]
            if not large:  # the node itself hangs there, too
                fresh = starts[1:] if goes_on else starts
                to_u, to_v, of = np.r_[to_u, u[fresh]], np.r_[to_v, lows[fresh]], np.r_[of, u[fresh]]
            open_ = of == first[0]
            yield _rows(to_u[open_], to_v[open_], of[open_])
            forest.tie(to_u[~open_].tolist(), to_v[~open_].tolist())
            if len(forest.up) > EDGES:
                yield _rows(*forest.edges())
                forest = Forest()
        yield _rows(*forest.edges())
        if first is not None:
            ends = dict.fromkeys([first, last] if last[0] != first[0] else [last])
            yield _rows([m for _, m, _ in ends], [m for _, m, _ in ends], [n for n, _, _ in ends], [int(x) for _, _, x in ends])
            yield _rows([None], [busy])

    return ranged.mapInArrow(work, _SCHEMA)


def _settled(step: DataFrame, large: bool) -> tuple[DataFrame, bool]:
    """The edges of a written star step, with the ends of ranges settled, and whether there was work."""
    ends: dict[int, list[tuple[int, int]]] = {}
    busy = False
    for r in step.where("more is not null or u is null").collect():  # three rows for each range
        if r.key is None:
            busy |= r.v > 0
        else:
            ends.setdefault(r.key, []).append((r.u, r.more))
    low = {k: min(m for m, _ in seen) for k, seen in ends.items()}
    busy |= any(low[k] < k and any(x for _, x in seen) or not large and len({m for m, _ in seen}) > 1 for k, seen in ends.items())
    rows = step.where("u is not null")
    across = [(k, m) for k, m in low.items() if len(ends[k]) > 1]
    if across:
        known = step.sparkSession.createDataFrame(across, "key long, low long")
        rows = rows.join(F.broadcast(known), "key", "left").withColumn("v", F.least("v", "low"))
    return rows.where("u <> v").select("u", "v"), busy


def components(nodes: DataFrame, edges: DataFrame, rounds: list[int] | None = None, at_once: int = EDGES) -> DataFrame:
    """L2: (id, component), the smallest id of the weakly connected component of each row of nodes(id).

    Edges(parent, child) are integers; edges with a null end, loops and repeats change nothing. Each round contracts in as few tasks as can hold
    ``at_once`` edges each; where that is one task, its forest is the answer, else stars bring together what tasks could not see.
    ``rounds`` gets the number of edges each round began with.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    steps = Steps(spark, "components")
    e = steps.write(contracted(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")), at_once))
    while True:
        n = e.count()
        if rounds is not None:
            rounds.append(n)
        tasks = max(1, -(-n // at_once))
        e = steps.write(contracted(e.coalesce(tasks), 2 * at_once))
        if tasks == 1:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, work_large = _settled(steps.write(_hung(both, True, parts)), True)
        e, work_small = _settled(steps.write(_hung(large, False, parts)), False)
        if not (work_large or work_small):
            break
    found = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
