"""Removal of repeated byte strings by sorted suffixes (deep-shallow sorting).

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller doc_id, or before in the same
document. Strings are judged on the input.

1. Every string of ``length`` bytes has an anchor, its 32-byte piece of least hash (the leftmost of equals), so equal
   strings have equal anchors at equal places. Successive strings of one anchor form a record: the anchor's hash, the
   place, and a hash of all the bytes its strings cover.
2. Records are sorted by (anchor, covered bytes, doc_id, place) over ranges, so a frequent one spans partitions. All but the
   first of equal records are repeats as a whole. Where an anchor has records that differ, the first of each goes on.
3. Their bytes are fetched, and the suffixes at the anchor (and the reversed ones before it) are ordered by deep-shallow
   sorting: multikey quicksort over the first bytes, blind tries for groups with a longer common prefix. Common prefix
   lengths of neighbours then give, for each offset, the classes of equal strings, and all but the first of a class go.
   Anchors met very often are resolved over ranges again, string by string.
4. Removed stretches are gathered for each document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.common import cut, mix

K = 32
CROWD = 20_000  # records of an anchor that one task takes
SHALLOW = 16
PIECE = 1 << 20  # bytes of a text that are looked at together
POS_BITS = np.uint64(24)
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            base = np.full(n, ODD, np.uint64)
            base[0] = 1
            self.up = np.multiply.accumulate(base)
            base[1:] = INVERSE
            self.down = np.multiply.accumulate(base)
        return self.up[:n], self.down[:n]


def records(raw: bytes, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of covered bytes with the two distances in its low bits, place of the anchor) of a text."""
    n, w = len(raw), length - K + 1
    if n < length:
        return (np.array([], np.int64),) * 2 + (np.array([], np.int32),)
    if n > PIECE:  # pieces overlap, so every string lies in one of them; a record may come in two parts
        parts = [records(raw[at: at + PIECE], length, powers) for at in range(0, n - length + 1, PIECE - length + 1)]
        at = np.arange(0, n - length + 1, PIECE - length + 1)
        return tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1)) + (
            np.concatenate([p[2] + a for p, a in zip(parts, at, strict=True)]).astype(np.int32),)
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[np.frombuffer(raw, np.uint8)] * down[:n], out=total[1:])
    h = mix((total[K:] - total[:-K]) * up[: n - K + 1])
    m = (h >> POS_BITS << POS_BITS) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < w:
        m = np.minimum(m[: len(m) - (w - step)], m[w - step:])
    q = (m & np.uint64((1 << 24) - 1)).astype(np.int64)  # the anchor of the string at each start
    a = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    b = np.r_[a[1:], len(q)] - 1
    at = q[a]
    body = mix((total[b + length] - total[a]) * up[a])
    near = ((at - a) << 7 | (at - b)).astype(np.uint64)
    return h[at].view(np.int64), (body >> np.uint64(14) << np.uint64(14) | near).view(np.int64), at.astype(np.int32)


def record_rows(docs: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            got = [(d, *records((t.as_py() or "").encode(), length, powers))
                   for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            if got:
                doc = np.repeat(np.array([g[0] for g in got], np.int64), [len(g[3]) for g in got])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([g[i] for g in got])) for i in (1, 2)),
                                                  pa.array(doc), pa.array(np.concatenate([g[3] for g in got]))],
                                                 ["anchor", "body", "doc", "place"])

    return docs.where("doc_id is not null").mapInArrow(work, "anchor long, body long, doc long, place int")


def resolved(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """(doc, start, stop, anchor, place, near): stretches that repeat (stop > 0), and records to be looked at."""
    ranged = rows.repartitionByRange(parts, "anchor", "body", "doc", "place").sortWithinPartitions("anchor", "body", "doc", "place")
    names = ["doc", "start", "stop", "anchor", "place", "near"]

    def out(doc, start, stop, anchor, place, near) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()),
                                           pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(near, pa.int32())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None  # the open anchor's first record, not passed on yet
        last = None  # (anchor, body, doc, place) of the open record
        border = True  # the partition's first anchor may have begun in another
        many = None  # the open anchor, if its records are being passed on
        for b in batches:
            if not b.num_rows:
                continue
            anchor, body, doc, place = (b.column(i).to_numpy() for i in range(4))
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])]
            if last and (int(anchor[0]), int(body[0])) == last[:2]:
                new[0] = False
            run = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            d0 = np.where(run >= 0, doc[first[np.maximum(run, 0)]] if len(first) else 0, last[2] if last else 0)
            p0 = np.where(run >= 0, place[first[np.maximum(run, 0)]] if len(first) else 0, last[3] if last else 0)
            again = ~new & ((doc != d0) | (place != p0))
            near = body & 0x3FFF
            start, stop = place - (near >> 7), place - (near & 127) + length
            none = np.zeros(int(again.sum()), np.int64)
            yield out(doc[again], start[again], stop[again], none, none.astype(np.int32), none.astype(np.int32))
            last = (int(anchor[-1]), int(body[-1]), int(d0[-1]), int(p0[-1]))
            if not len(first):
                continue
            fd, fa, fp, fn = doc[first], anchor[first], place[first], near[first]
            if wait is not None:
                fd, fa, fp, fn = (np.r_[x, y] for x, y in zip(wait, (fd, fa, fp, fn), strict=True))
            same = fa[1:] == fa[:-1]
            pass_on = np.r_[same, False] | np.r_[False, same]
            if many is not None:
                pass_on |= fa == many
            if border:
                pass_on |= fa == fa[0]
                many, border = int(fa[0]), False
            open_ = int(fa[-1])
            if pass_on[-1]:
                many, wait = open_, None
            else:
                wait = tuple(x[-1:] for x in (fd, fa, fp, fn))
            zero = np.zeros(int(pass_on.sum()), np.int32)
            yield out(fd[pass_on], zero, zero, fa[pass_on], fp[pass_on], fn[pass_on])
        if wait is not None:  # its anchor may go on in the next partition
            yield out(wait[0], [0], [0], wait[1], wait[2], wait[3])

    return ranged.mapInArrow(work, "doc long, start int, stop int, anchor long, place int, near int")


class BlindTrie:
    """Orders distinct places by strings with a long common prefix: nodes hold only the depth at which they branch and one
    byte for each branch; a new string goes down blindly to a leaf and is compared with that one string only."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf is the number of a string; a node is [depth, {byte: child}]
        self.same: dict[int, list[int]] = {0: [0]}
        for i in range(1, len(strings)):
            self.add(i)

    def add(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        leaf = self.strings[node]
        if leaf == s:
            self.same[node].append(i)
            return
        at = next(k for k, (x, y) in enumerate(zip(s, leaf, strict=True)) if x != y)
        self.same[i] = [i]
        above, node = None, self.root
        while isinstance(node, list) and node[0] < at:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == at:
            node[1][s[at]] = i
            return
        new = [at, {leaf[at]: node, s[at]: i}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += self.same[node]
        return out


def deep_shallow(group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order of the rows of ``text`` (bytes, one string a row) inside each group."""
    order = np.lexsort((np.arange(len(group)), group))
    part = np.r_[0, np.cumsum(group[order][1:] != group[order][:-1])] if len(order) else order
    words = np.ascontiguousarray(text[:, :SHALLOW]).view(">u8").astype(np.uint64)
    live = np.arange(len(order))  # positions of order whose part has more than one row
    for d in range(SHALLOW // 8):  # multikey quicksort, eight bytes at a time, on parts still tied
        size = np.bincount(part)
        live = live[size[part[live]] > 1]
        if not len(live):
            return order
        key = words[order[live], d]
        by = np.lexsort((key, part[live]))
        order[live] = order[live[by]]
        key, was = key[by], part[live]
        split = np.r_[False, (key[1:] != key[:-1]) & (was[1:] == was[:-1])]
        bump = np.zeros(len(part), np.int64)
        bump[live[split]] = 1
        part = part + np.cumsum(bump)
    size = np.bincount(part)
    live = live[size[part[live]] > 1]
    if not len(live):
        return order
    starts = np.flatnonzero(np.r_[True, part[live][1:] != part[live][:-1]])
    raw, width = text.tobytes(), text.shape[1]
    for s, e in zip(starts, [*starts[1:], len(live)], strict=True):
        rows = order[live[s:e]]
        strings = [raw[r * width: (r + 1) * width] for r in rows.tolist()]
        if e - s == 2:
            if strings[1] < strings[0]:
                order[live[s:e]] = rows[::-1]
        else:
            order[live[s:e]] = rows[BlindTrie(strings).order()]
    return order


def common(order: np.ndarray, group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row in order with the one before it; -1 at a new group."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 65_536):
        to = min(len(order), at + 65_536)
        differ = text[order[at:to]] != text[order[at - 1: to - 1]]
        out[at:to] = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    g = group[order]
    out[1:][g[1:] != g[:-1]] = -1
    return out


def repeats(group: np.ndarray, doc: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray, text: np.ndarray,
            length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, starts relative to the anchor) of the strings that are not the first of their kind.

    ``text`` has length - K bytes before the anchor and ``length`` from it on. Row r has the strings that start
    from before[r] to after[r] bytes ahead of its anchor.
    """
    left = length - K
    rank = np.lexsort((place, doc))
    first = np.empty(len(rank), np.int64)
    first[rank] = np.r_[0, np.cumsum((doc[rank][1:] != doc[rank][:-1]) | (place[rank][1:] != place[rank][:-1]))] if len(rank) else 0
    sides = []
    for side in (np.ascontiguousarray(text[:, left:]), np.ascontiguousarray(text[:, :left][:, ::-1])):
        order = deep_shallow(group, side)
        sides.append((order, common(order, group, side)))
    out = []
    for u in range(left + 1):  # strings that start u bytes ahead of the anchor
        use = (before >= u) & (after <= u)
        if not use.any():
            continue
        kinds = []
        for (order, lcp), least in zip(sides, (length - u, u), strict=True):
            kind = np.empty(len(order), np.int64)
            kind[order] = np.cumsum(lcp < least)
            kinds.append(kind)
        rows = np.flatnonzero(use)
        by = rows[np.lexsort((first[rows], kinds[1][rows], kinds[0][rows]))]
        same = (kinds[0][by][1:] == kinds[0][by][:-1]) & (kinds[1][by][1:] == kinds[1][by][:-1])
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(by)), 0))
        gone = by[first[by] != first[by[head]]]
        if len(gone):
            out.append((gone, np.full(len(gone), u)))
    return out


def fetched(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, place, near, bytes) with the bytes of each open record, zero outside its strings."""
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "near")).alias("w"))
    both = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null").join(wanted, "doc")
    left, width = length - K, 2 * length - K

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode()
                for x in w:
                    q, near = x["place"], x["near"]
                    a, e = q - (near >> 7), q - (near & 127) + length
                    body = raw[a:e]
                    for c, v in zip(cols, (x["anchor"], d, q, near, (b"\0" * (left - (near >> 7)) + body).ljust(width, b"\0")), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                             ["anchor", "doc", "place", "near", "bytes"])

    return both.mapInArrow(work, "anchor long, doc long, place int, near int, bytes binary")


def stretches(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined stretches of successive starts."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]) if len(doc) else np.array([], np.int64)
    return doc[new], start[new], (np.r_[start[new[1:] - 1], start[-1:]] if len(doc) else start) + length


def compared(rows: DataFrame, tasks: int, length: int) -> DataFrame:
    """(doc, start, stop) by sorting the suffixes of each anchor's records."""
    def work(t: pa.Table) -> pa.Table:
        group, doc, place, near = (t[c].to_numpy() for c in ("anchor", "doc", "place", "near"))
        text = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8).reshape(len(doc), 2 * length - K)
        got = repeats(group, doc, place.astype(np.int64), near >> 7, near & 127, text, length)
        r = np.concatenate([x for x, _ in got]) if got else np.array([], np.int64)
        u = np.concatenate([x for _, x in got]) if got else np.array([], np.int64)
        d, s, e = stretches(doc[r], place[r].astype(np.int64) - u, length)
        return pa.table({"doc": pa.array(d, pa.int64()), "start": pa.array(s, pa.int32()), "stop": pa.array(e, pa.int32())})

    keyed = rows.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks)))
    return keyed.groupBy("task").applyInArrow(work, "doc long, start int, stop int")


def crowded(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """(doc, start, stop) for anchors of very many records: their strings one by one, as records of their own."""
    left = length - K

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, d, p = [], [], [], []
            for doc, place, near, body in zip(*(b.column(x).to_pylist() for x in ("doc", "place", "near", "bytes")), strict=True):
                for u in range(near & 127, (near >> 7) + 1):
                    h = hashlib.blake2b(body[left - u: left - u + length], digest_size=16).digest()
                    a.append(int.from_bytes(h[:8], "little", signed=True))
                    c.append(int.from_bytes(h[8:], "little", signed=True) >> 14 << 14)
                    d.append(doc)
                    p.append(place - u)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int32())],
                                             ["anchor", "body", "doc", "place"])

    each = rows.mapInArrow(strings, "anchor long, body long, doc long, place int")
    got = cut(resolved(each, parts, length))
    repeat = got.where("stop > 0").select("doc", "start", "stop")
    edge = got.where("stop = 0")  # strings at partition borders
    least = edge.groupBy("anchor").agg(F.min(F.struct("doc", "place")).alias("least"))
    rest = edge.join(least, "anchor").where(F.struct("doc", "place") > F.col("least"))
    return repeat.unionByName(rest.select("doc", F.col("place").alias("start"), (F.col("place") + length).alias("stop")))


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(doc, start, stop): stretches to remove; they may overlap."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = cut(resolved(record_rows(docs, length), parts, length))
    whole = first.where("stop > 0").select("doc", "start", "stop")
    open_ = first.where("stop = 0").select("doc", "anchor", "place", "near")
    busy = cut(open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    looked = open_.join(busy, "anchor")
    total = busy.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).head()
    if not total.n:
        return whole
    text = cut(fetched(docs, looked.select("doc", "anchor", "place", "near", "n"), length)) if total.most > CROWD \
        else fetched(docs, looked, length)
    if total.most <= CROWD:
        return whole.unionByName(cut(compared(text, -(-total.n // CROWD), length)))
    hot = busy.where(F.col("n") > CROWD).select("anchor")
    return whole.unionByName(cut(compared(text.join(hot, "anchor", "left_anti"), -(-total.n // CROWD), length))).unionByName(
        crowded(text.join(hot, "anchor", "left_semi"), parts, length))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the text that stays), then the
    columns named in ``carry``.

    ``length`` is at least 64 and at most 159. Null text is empty. A row with a null id takes no part and stays whole. Rows
    of one id must hold one text; they count as one document. ``kept`` leaves out a character of which a byte goes.
    """
    if not 2 * K <= length <= 159:
        raise ValueError("length must be from 64 to 159 bytes")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    spans = repeated(docs.select("doc_id", "text"), length).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    both = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans", *carry)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[3:])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = (t.as_py() or "").encode()
                gone = merged([(x["start"], x["stop"]) for x in s.as_py() or ()])
                ends = [0, *(x for p in gone for x in p), len(raw)]
                kept = b"".join(raw[ends[i]: ends[i + 1]] for i in range(0, len(ends), 2)) if gone else raw
                parts = (raw[ends[i]: ends[i + 1]].decode("utf-8", "ignore") for i in range(0, len(ends), 2)) if with_text else ()
                rows.append((d, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), "".join(parts)))
            if rows:
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string(), pa.string()), strict=False)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([*cols[: 5 + with_text], *b.columns[3:]], [*names[: 5 + with_text], *carry])

    return both.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + kinds)
