"""N-gram Jaccard self-join with signature trees, as connected components; exact where t is 0.88 or more.

1. Each document becomes its set of hashed word shingles; equal sets collapse to the smallest id.
2. Sets that can reach the similarity t are brought together. Two sets of at most m shingles that do differ in at most
   d = 2 m (1 - t) / (1 + t) of them. Shingle space is cut into more than d ranges, so at least one range holds the same
   shingles in both, and the sum over a range is the key that meets there. Ranges hold about (1 + t) / 2 (1 - t)
   shingles, so a passage that many documents share does not bring them together. Size classes keep m tight. Below
   t = 0.88 ranges would hold fewer than EXACT shingles (at 0.8 they hold 4.5) and bring together what a shared line already
   has in common; there, ranges are wider and keys are drawn from several orders of the shingles, as many as it
   takes for a pair to be missed with probability LOSS at most, at the very threshold too.
3. Sets connected by such keys form clusters, which are cut into blocks. In a block a signature tree (nodes with OR-ed
   bitmaps of their shingles and ranges of sizes) is traversed against itself or another tree: node pairs whose largest
   possible overlap is too small, or that are already one component, are pruned; what is left is compared exactly.
4. A cluster of several blocks is first joined inside its blocks, with a few pivots in every block; then only the
   documents outside its largest component meet all blocks.

The links found connect exactly the documents that all links together connect; not every link inside a component is
looked for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.common import WordHash, cut, mix, wanted
from duologue.operators.graph import components

BLOCK = 1000
PIVOTS = 4
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def size_classes(most: int = 1 << 40) -> list[int]:
    """First sizes of the size classes."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


STARTS = size_classes()


def shingles(words: list[bytes], k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words give one shingle, none give none."""
    if not words:
        return np.array([], np.uint64)
    h = mix(hashes.of(words))
    width = min(k, len(words))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total += (h[i: len(h) - width + 1 + i] ^ SEEDS[i % 8]) * (SEEDS[(i + 3) % 8] + np.uint64(2 * i))
        total = mix(total)
    return np.unique(total)


EXACT = 8  # shingles that a range of the exact scheme must hold
WIDE = 2.0  # differing shingles a wide range meets on average, at the least similarity
LOSS = 1e-6  # largest probability that two linked sets share no key of the wide scheme


def difference(size_class: int, percent: int) -> int:
    """In how many shingles linked sets of a class may differ."""
    return 2 * (STARTS[size_class + 1] - 1) * (100 - percent) // (100 + percent)


def range_keys(tokens: np.ndarray, size_class: int, parts: int, spare: int) -> np.ndarray:
    """A key for each range of sorted tokens, and for empty ones where more than ``spare`` are empty."""
    at = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    tag = at[starts] + np.uint64(size_class << 40)
    out = mix(np.add.reduceat(mix(tokens ^ SEEDS[5]), starts) + tag * SEEDS[0])
    if parts - len(starts) > spare:
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[starts])
        out = np.r_[out, mix((empty + np.uint64(size_class << 40)) * SEEDS[1])]
    return out


def wide_plan(size_class: int, d: int, percent: int) -> tuple[int, int]:
    """Ranges of one order, and the number of keys. A range has a key that two linked sets share if none of their at most d
    differing shingles lies in it and one of the common ones does, of which there are t times the larger set at least. Counts of
    balls in bins are negatively associated, so no key is shared with at most the product of the ranges' own probabilities."""
    parts, common = int(np.ceil(d / WIDE)), -(-percent * STARTS[size_class] // 100)
    off = 1 - 1 / parts
    return parts, int(np.ceil(np.log(LOSS) / np.log1p(-(off**d) * (1 - off**common))))


def wide_keys(tokens: np.ndarray, size_class: int, d: int, percent: int) -> np.ndarray:
    """Keys of ranges that hold several differing shingles on average, over several orders of the shingles where one has too few."""
    parts, want = wide_plan(size_class, d, percent)
    out = []
    for order in range(-(-want // parts)):
        t = mix(tokens ^ (SEEDS[order % 8] + np.uint64(order)))
        at = ((t >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        use = at < want - order * parts
        t, at = t[use], at[use]
        if len(t):
            by = np.argsort(at, kind="stable")
            at = at[by]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            tag = at[starts] + np.uint64((size_class << 40) + ((order + 1) << 50))
            out.append(mix(np.add.reduceat(mix(t[by] ^ SEEDS[5]), starts) + tag * SEEDS[0]))
    return np.concatenate(out) if out else np.array([], np.uint64)


def keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set meets every set it may be linked with."""
    n = len(tokens)
    if not n:
        return np.array([], np.int64)
    first, out = bisect_right(STARTS, n) - 1, []
    for c in [first] + [first + 1] * (100 * n >= percent * STARTS[first + 1]):
        d = difference(c, percent)
        if d <= 8 or (100 + percent) >= 2 * EXACT * (100 - percent):
            spare = (d + 1) // 32
            out.append(range_keys(tokens, c, d + 1 + spare, spare))
        else:
            out.append(wide_keys(tokens, c, d, percent))
    return np.concatenate(out).view(np.int64)


def set_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, two 64-bit halves of the set's fingerprint, keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            n, k1, k2, routes = [], [], [], []
            for text in b.column(1):
                t = shingles((text.as_py() or "").encode().lower().split(), k, hashes)
                n.append(len(t))
                k1.append(int(np.add.reduce(mix(t ^ SEEDS[1])).view(np.int64)) if len(t) else 0)
                k2.append(int(np.add.reduce(mix(t ^ SEEDS[2])).view(np.int64)) if len(t) else 0)
                routes.append(keys(t, percent))
            bounds = np.r_[0, np.cumsum([len(r) for r in routes])].astype(np.int32)
            flat = pa.array(np.concatenate(routes) if routes else np.array([], np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds), flat)], ["doc_id", "n", "k1", "k2", "keys"])

    return docs.mapInArrow(work, "doc_id long, n long, k1 long, k2 long, keys array<long>")


def met(rows: DataFrame, parts: int) -> DataFrame:
    """(u, v) edges that connect the ids under each key. Rows are sorted by key and id over all partitions, so a frequent
    key spans several; each partition ties its ids of a key to its first one, and first ones are tied over partitions."""
    ranged = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")

    def rows_of(u, v, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, key)], ["u", "v", "key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None  # (key, its first id here) of the first key and of the open one
        for b in batches:
            key, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            firsts = i[starts].copy()
            if last and key[0] == last[0]:
                firsts[0] = last[1]
            first = np.repeat(firsts, np.diff(np.r_[starts, len(key)]))
            tie = first != i
            head, last = head or (int(key[0]), int(firsts[0])), (int(key[-1]), int(firsts[-1]))
            yield rows_of(i[tie], first[tie], [None] * int(tie.sum()))
        if last:
            yield rows_of([head[1], last[1]], [head[1], last[1]], [head[0], last[0]])

    out = cut(ranged.mapInArrow(work, "u long, v long, key long"))
    border = out.where("key is not null")  # two rows a partition
    ties = border.groupBy("key").agg(F.min("u").alias("v")).join(border.select("key", "u"), "key").select("u", "v")
    return out.where("key is null").select("u", "v").unionByName(ties).where("u <> v").distinct()


class Links:
    """Components inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def tie(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


class Tree:
    """Signature tree over some of the sets of a block: level 0 holds sets, each higher level nodes of FAN children."""

    FAN = 8

    def __init__(self, members: list[int], sets: list[np.ndarray], bits: int):
        order = sorted(members, key=lambda m: (int(sets[m][0]) >> 44, len(sets[m]), m))
        self.members = order
        maps = np.zeros((len(order), bits // 64), np.uint64)
        for r, m in enumerate(order):
            at = sets[m] & np.uint64(bits - 1)
            np.bitwise_or.at(maps[r], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(sets[m]) for m in order], np.int64)
        hidden = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, hidden)]  # bitmap, least size, largest size, shingles hidden by collisions
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, hid = self.levels[-1]
            at = np.arange(0, len(lo), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(hid, at)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * self.FAN, min((node + 1) * self.FAN, len(self.levels[level - 1][1])))


def possible(p: tuple, i: np.ndarray, q: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """For all pairs of nodes i of p and j of q: may any pair of sets below reach the similarity?"""
    common = np.bitwise_count(p[0][i][:, None] & q[0][j][None]).sum(2).astype(np.int64)
    common += np.minimum(p[3][i][:, None], q[3][j][None])
    common = np.minimum(common, np.minimum(p[2][i][:, None], q[2][j][None]))
    need = percent * (p[1][i][:, None] + q[1][j][None])
    near = (100 * p[2][i][:, None] >= percent * q[1][j][None]) & (100 * q[2][j][None] >= percent * p[1][i][:, None])
    return near & ((100 + percent) * common >= need)


def traverse(a: Tree, b: Tree, sets: list[np.ndarray], links: Links, percent: int) -> list[tuple[int, int]]:
    """New links between the sets below the two trees (a may be b)."""
    found: list[tuple[int, int]] = []
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        ia = a.children(la, i) if la and la >= lb else np.array([i])
        jb = b.children(lb, j) if lb and lb >= la else np.array([j])
        na, nb = la - (la > 0 and la >= lb), lb - (lb > 0 and lb >= la)
        ok = possible(a.levels[na], ia, b.levels[nb], jb, percent)
        for x, y in np.argwhere(ok).tolist():
            p, q = int(ia[x]), int(jb[y])
            if a is b and na == nb and p > q:
                continue
            if na or nb:
                if not one_component(a, na, p, b, nb, q, links):
                    stack.append((na, p, nb, q))
                continue
            m, o = a.members[p], b.members[q]
            if m != o and links.find(m) != links.find(o):
                both = len(np.intersect1d(sets[m], sets[o], assume_unique=True))
                if 100 * both >= percent * (len(sets[m]) + len(sets[o]) - both):
                    links.tie(m, o)
                    found.append((m, o))
    return found


def one_component(a: Tree, la: int, p: int, b: Tree, lb: int, q: int, links: Links) -> bool:
    if la > 2 or lb > 2:
        return False
    below = a.members[p * a.FAN**la: (p + 1) * a.FAN**la] + b.members[q * b.FAN**lb: (q + 1) * b.FAN**lb]
    root = links.find(below[0])
    return all(links.find(m) == root for m in below[1:])


def block_links(ids: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links inside a block (side 0), or between its two sides (1 and 2) when both are there; ids may be on both."""
    links = Links(len(ids))
    if len(ids) == 2 and side[0] == side[1]:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    bits = 64
    while bits < 4 * max(len(s) for s in sets):
        bits *= 2
    bits = min(bits, 1 << 17)
    one = [m for m, s in enumerate(side) if s in (0, 1)]
    two = [m for m, s in enumerate(side) if s == 2]
    a = Tree(one, sets, bits)
    got = traverse(a, Tree(two, sets, bits) if two else a, sets, links, percent)
    return [(ids[m], ids[o]) for m, o in got if ids[m] != ids[o]]


def linked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) links of rows(task, block, side, id, text): blocks are compared one by one, a task holds some of them."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            sets = [shingles((t.as_py() or "").encode().lower().split(), k, hashes).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("task", "block", "side", "id")), pa.array(sets, pa.binary())],
                                             ["task", "block", "side", "id", "tokens"])

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("side", "ascending"), ("id", "ascending")])
        block, out = t["block"].to_pylist(), []
        side, ids, tokens = t["side"].to_pylist(), t["id"].to_pylist(), t["tokens"].combine_chunks()
        at = 0
        while at < len(block):
            end = at
            while end < len(block) and block[end] == block[at]:
                end += 1
            if end - at > 1:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tokens[at:end]]
                out += block_links(ids[at:end], sets, side[at:end], percent)
            at = end
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    tokens = rows.select("task", "block", "side", "id", "text").mapInArrow(
        prepare, "task long, block string, side int, id long, tokens binary")
    return tokens.groupBy("task").applyInArrow(work, "u long, v long")


def links_of(reps: DataFrame, docs: DataFrame, meeting: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between representatives that connect all that are linked. reps(id, n), meeting(u, v)."""
    ends = meeting.select(F.col("u").alias("id")).unionByName(meeting.select(F.col("v").alias("id"))).distinct()
    cluster = cut(components(ends, meeting.select(F.col("u").alias("parent"), F.col("v").alias("child"))))
    sizes = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    cluster = cluster.join(sizes, "component")
    blocks = F.ceil(F.col("size") / BLOCK)
    tasks = max(1, -(-cluster.count() // BLOCK))
    small = cluster.where(F.col("size") <= BLOCK).select(
        "id", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"), F.col("component").cast("string").alias("block"),
        F.lit(0).alias("side"))
    big = cluster.where(F.col("size") > BLOCK).select(
        "id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id", F.lit(7)), blocks).alias("b"))
    pivots = pivots_of(big)
    own = big.select("id", "component", "b").unionByName(pivots).distinct()
    key = F.concat_ws("/", F.col("component"), F.col("b"))
    first = small.unionByName(own.select("id", F.xxhash64("component", "b").alias("task"), key.alias("block"), F.lit(0).alias("side")))
    text = docs.select(F.col("doc_id").alias("id"), "text").where("doc_id is not null")
    first = cut(first)
    found = cut(linked(first.join(wanted(text, first, "id"), "id"), k, percent))
    if big.isEmpty():
        return found
    done = cut(components(big.select("id"), found.join(big.select(F.col("id").alias("u")), "u", "left_semi").select(
        F.col("u").alias("parent"), F.col("v").alias("child"))).withColumnRenamed("component", "part"))
    state = big.join(done, "id")
    count = state.groupBy("component", "part").agg(F.count(F.lit(1)).alias("c"))
    main = count.groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("main"),
                                          (F.sum("c") - F.max("c")).alias("rest"))
    state = state.join(main.where("rest > 0"), "component")
    rest_blocks = F.ceil(F.col("rest") / BLOCK)
    rb = F.pmod(F.xxhash64("id", F.lit(9)), rest_blocks)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rest = state.where("part <> main").select("id", "component", rb.alias("i"), upto(F.col("blocks")).alias("j"),
                                              F.lit(1).alias("side"))
    all_ = state.select("id", "component", upto(rest_blocks).alias("i"), F.col("b").alias("j"), F.lit(2).alias("side"))
    pairs = rest.unionByName(all_)
    second = pairs.select("id", F.xxhash64("component", "i", "j").alias("task"), F.concat_ws("/", "component", "i", "j").alias("block"), "side")
    second = cut(second)
    return found.unionByName(cut(linked(second.join(wanted(text, second, "id"), "id"), k, percent)))


def pivots_of(big: DataFrame) -> DataFrame:
    """A few members of each large cluster, for each of its blocks: ids least by hash in one of PIVOTS shares."""
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PIVOTS))
    one = big.groupBy("component", share.alias("s")).agg(F.min_by("id", F.xxhash64("id")).alias("id"), F.max("blocks").alias("blocks"))
    return one.select("id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their sets of distinct ``words``-word shingles
    (A-Z lower-cased; words are runs without ASCII white space; a shorter text is one shingle). component_id is the
    smallest id that links reach. Null or empty texts and texts of white space have no shingle and stay alone; a row
    with a null id keeps a null component. Rows of one id must hold one text; repeated rows come back repeated.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = cut(set_rows(docs, words, percent))
    reps = sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("id"), F.any_value("keys").alias("keys"))
    meeting = cut(met(reps.select(F.explode("keys").alias("key"), "id"), parts))
    links = links_of(reps.select("id"), docs, meeting, words, percent)
    ends = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).distinct()
    comp = components(ends, links.select(F.col("u").alias("parent"), F.col("v").alias("child")))
    named = sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id")).join(
        comp, "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component_id"))
    return sets.drop("keys").join(named, ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
