"""Sampled SentencePiece segmentations without replacement (Gumbel top-k by A*), and decoding.

A text is a lattice of vocabulary pieces; the weight of a piece falls with its rank (a power of 1 / rank), and a
segmentation's probability is in proportion to the product of its pieces' weights. No piece of the vocabulary goes over from a word
into a run of spaces or of certain other characters, so the lattice is a sequence of chunk lattices, each computed once for a
task and used again.

Top-down A*: the best perturbed score is a Gumbel number and its segmentation an ordinary draw, step by step. What the draw
left out at each step is a branch; the best perturbed score inside a branch is a Gumbel number at the branch's log
mass, truncated at the score of the draw. The best branch gives the next segmentation, which opens branches in turn. So
the k best perturbed scores come out in order, all segmentations distinct, and the best score still queued is the threshold
that inclusion probabilities need: 1 - exp(-exp(log p - threshold)).

All random numbers are hashes of the row's key and of their place in the row, so the segmentations do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from duologue.llm.common import mix

SPACE, STAND_IN = "▁", "\udc80"  # the piece for a space; what a real U+2581 becomes (no valid text holds it)
MOST = 3_000_000  # positions kept
SLOTS = 18  # log2 of the places in the table of piece starts
SPREAD = 42.0  # a Gumbel number of ``gumbel(uniform())`` is over -3.7 and under 36.8, so two of them are never further apart


def mark_table(names: list[str]) -> np.ndarray:
    """Which characters (all from 128 on as one) are marks: ASCII characters other than letters that no piece has right after a
    character that is neither a mark nor a space. A chunk is a run of spaces, then marks, then other characters, each may be missing."""
    marks = {c for name in names for c in name if c.isascii() and not c.isalpha()} | {"\n"}
    steps = {(a, b) for name in names for a, b in zip(name, name[1:], strict=False) if a != SPACE}
    while late := {b for a, b in steps if b in marks and a not in marks}:
        marks -= late
    return np.array([chr(c) in marks for c in range(128)] + [False])


def find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Slots of hashes in a table (its size a power of two, 0: empty); an empty slot where a hash is not there."""
    at = (h >> np.uint64(65 - len(table).bit_length())).astype(np.int64)
    k = table[at]
    lost = np.flatnonzero((k != h) & (k != 0))
    while len(lost):
        at[lost] = (at[lost] + 1) % len(table)
        k = table[at[lost]]
        lost = lost[(k != h[lost]) & (k != 0)]
    return at


def fill(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Puts hashes, all different and none in the table yet, into free slots; returns these."""
    at, left = (h >> np.uint64(65 - len(table).bit_length())).astype(np.int64), np.arange(len(h))
    while len(left):
        free = left[table[at[left]] == 0]
        table[at[free]] = h[free]
        left = left[table[at[left]] != h[left]]
        at[left] = (at[left] + 1) % len(table)
    return at


class Vocabulary:
    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        self.byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses the start of a word")
        self.mark = mark_table([names[i] for i in plain])
        self.chars = np.array([1 if m.is_byte(i) else len(names[i]) for i in range(n)], np.int32)
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i)))}
        self.score = -sharpness * np.log(np.array([rank.get(i, n) for i in range(n)]) + 2.7)
        self.longest = max(len(names[i]) for i in plain)
        self.bytes = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte.tolist()):
            self.bytes[i] = bytes([b])
        self.flat, self.size = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(b) for b in self.bytes], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        chars = np.frombuffer("".join(names[i] for i in plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ids, size = np.array(plain, np.int32), np.array([len(names[i]) for i in plain], np.int64)
        offset, h = np.cumsum(size) - size, np.zeros(len(plain), np.uint64)
        starts = []  # of all pieces: hash, piece or -1, whether it goes on
        for j in range(self.longest):
            on = size > j
            ids, size, offset, h = ids[on], size[on], offset[on], h[on]
            h = roll(h, chars[offset + j])
            starts.append((h, np.where(size == j + 1, ids, -1), size > j + 1))
        hashes, of = np.unique(np.concatenate([x[0] for x in starts]), return_inverse=True)
        self.key, self.value, self.more = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32), np.zeros(1 << SLOTS, bool)
        at = fill(self.key, hashes)[of]
        np.maximum.at(self.value, at, np.concatenate([x[1] for x in starts]))
        np.logical_or.at(self.more, at, np.concatenate([x[2] for x in starts]))

    def raw(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all pieces, and where each piece ends in them."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.offset[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes(), ends

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; the space put before it is taken off again."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))


class Lattices:
    """Lattices of chunks: positions with their steps (piece, chance, next position, the chance of the steps before it there)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.factor = 0x9E3779B97F4A7C15  # of the hashes of chunks
        self.hash = np.zeros(0, np.uint64)  # of each chunk; ``begin`` has its first position, ``uses`` how often it was met
        self.begin, self.uses = (np.zeros(0, np.int64) for _ in range(2))
        self.letter = np.zeros(0, np.uint32)  # of each position, 0 at a chunk's end
        self.first, self.count, self.piece, self.next = (np.zeros(0, np.int32) for _ in range(4))
        self.below, self.log_p = (np.zeros(0, np.float64) for _ in range(2))
        self.clear()

    def clear(self) -> None:
        self.chunks = self.positions = self.steps = 0  # used of the arrays, which are longer
        self.index(1 << 16)

    def index(self, places: int) -> None:
        self.table, self.number = np.zeros(places, np.uint64), np.zeros(places, np.int32)  # hashes of chunks and their numbers
        self.number[fill(self.table, self.hash[:self.chunks])] = np.arange(self.chunks)

    def thin(self) -> None:
        """Keeps the chunks met most often, those met once never, in half of the positions."""
        uses, begin = self.uses[:self.chunks], self.begin[:self.chunks]
        size = np.diff(np.r_[begin, self.positions])
        order = np.argsort(-uses, kind="stable")
        kept = np.zeros(self.chunks, bool)
        kept[order] = (uses[order] > 1) & (np.cumsum(size[order]) <= MOST // 2)
        live = np.repeat(kept, size)
        place = np.cumsum(live, dtype=np.int32) - np.int32(1)
        stays = live[self.source(slice(0, self.steps))]
        step = np.cumsum(stays, dtype=np.int32) - np.int32(1)
        first = np.where(self.count[:self.positions] > 0, step[np.minimum(self.first[:self.positions], self.steps - 1)], 0)[live]
        onward = place[self.next[:self.steps][stays]]
        chunks = {"hash": self.hash[:self.chunks][kept], "begin": place[begin[kept]], "uses": uses[kept] // 2}
        positions = {"first": first, "count": self.count[:self.positions][live], "letter": self.letter[:self.positions][live]}
        self.chunks, self.positions = len(chunks["hash"]), len(first)
        self.put(0, **chunks)
        self.put(0, **positions)
        for name in ("below", "log_p", "piece"):
            self.put(0, **{name: getattr(self, name)[:self.steps][stays]})
        self.put(0, next=onward)
        self.steps = len(onward)
        self.index(max(1 << 16, 1 << (4 * self.chunks).bit_length()))

    def put(self, used: int, **more: np.ndarray) -> None:
        """Writes behind the first ``used`` items; an array that is full doubles."""
        for name, values in more.items():
            array, need = getattr(self, name), used + len(values)
            if need > len(array):
                array = np.empty(max(need, min(2 * len(array), need + (1 << 22))), array.dtype)
                array[:used] = getattr(self, name)[:used]
                setattr(self, name, array)
            array[used:need] = values

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first positions of all chunks of the texts, and how many chunks each text has."""
        if self.positions > MOST:
            self.thin()
        letters = np.frombuffer("".join([f" {t}" for t in texts if t]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        space = letters == ord(" ")
        letters[letters == ord(SPACE)] = ord(STAND_IN)
        letters[space] = ord(SPACE)
        mark = self.v.mark[np.minimum(letters, 128)]
        cut = np.zeros(len(letters), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (mark[1:] & ~(mark | space)[:-1])
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        stop = np.cumsum(size)
        cut[(stop - size)[size > 0]] = True
        at = np.flatnonzero(cut)
        many = np.diff(np.searchsorted(at, np.r_[0, stop]))
        n = np.diff(np.r_[at, len(letters)])
        while True:
            h = self.hashes(letters, at, n)
            slot = find(self.table, h)
            new, place = np.unique(h[self.table[slot] != h], return_index=True)
            if len(new):
                where = np.flatnonzero(self.table[slot] != h)[place]
                self.put(self.chunks, hash=new, begin=self.add(letters, at[where], n[where]), uses=np.zeros(len(new), np.int64))
                self.chunks += len(new)
                if 2 * self.chunks > len(self.table):
                    self.index(1 << (4 * self.chunks).bit_length())
                else:
                    self.number[fill(self.table, new)] = np.arange(self.chunks - len(new), self.chunks)
                slot = find(self.table, h)
            number = self.number[slot]
            begin = self.begin[number]
            if np.array_equal(self.letter[np.repeat(begin - at, n) + np.arange(len(letters))], letters):
                self.uses[:self.chunks] += np.bincount(number, minlength=self.chunks)
                return begin, many
            self.factor = self.factor * 0x5851F42D4C957F2D & (1 << 64) - 1  # two chunks have one hash: all again with another
            self.clear()

    def hashes(self, letters: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of each chunk, from its place and size: a polynomial of its letters."""
        power, back = (np.full(len(letters), f, np.uint64) for f in (self.factor, pow(self.factor, -1, 1 << 64)))
        power[:1] = back[:1] = 1
        w = letters.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        w ^= w >> np.uint64(32)
        ahead = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(w * np.cumprod(power), out=ahead[1:])
        h = mix((ahead[at + n] - ahead[at]) * np.cumprod(back)[at] + n.astype(np.uint64))
        return np.maximum(h, np.uint64(1))

    def add(self, letters: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Builds the lattices of new chunks, from their places and sizes, and returns their first positions."""
        v, base, edge_base = self.v, self.positions, self.steps
        ends = np.cumsum(size + 1) - 1  # each chunk has one position more than characters
        chars = np.r_[letters, np.uint32(0)][np.minimum(np.repeat(at - (ends - size), size + 1) + np.arange(int(ends[-1]) + 1), len(letters))]
        chars[ends] = 0
        letter, chars = chars, chars.astype(np.uint64)
        left = np.repeat(ends, size + 1) - np.arange(len(chars))
        live = np.flatnonzero(left > 0)
        h, start, piece, length, nth = np.zeros(len(live), np.uint64), [], [], [], []
        seen = np.zeros(len(chars), np.int32)
        n = 0
        while len(live):
            h = roll(h, chars[live + n])
            slot = find(v.key, h)
            got, known = v.value[slot], v.key[slot] == h
            if n == 0:  # characters without a piece are spelt in bytes: -1 - character
                got = np.where((got < 0) | ~known, -1 - chars[live].astype(np.int32), got)
                hit = np.ones(len(live), bool)
            else:
                hit = (got >= 0) & known
            n += 1
            start.append(live[hit])
            nth.append(seen[start[-1]])
            seen[start[-1]] += 1
            piece.append(got[hit])
            length.append(np.full(len(start[-1]), n, np.int32))
            go = v.more[slot] & known & (left[live] > n)
            live, h = live[go], h[go]
        s, p, n, nth = np.concatenate(start), np.concatenate(piece), np.concatenate(length), np.concatenate(nth)
        score = v.score[np.maximum(p, 0)]
        spelt = np.flatnonzero(p < 0)
        code = -1 - p[spelt]
        score[spelt] = (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)) * v.score[v.byte[0]]
        p[spelt] = np.where(code < 0x80, v.byte[np.minimum(code, 0x7F)], p[spelt])
        order = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")  # by the distance from the chunk's end
        order = order[len(ends):]  # an end has no steps, all other positions have one at least
        many = seen[order].astype(np.int64)
        rows = np.cumsum(many) - many
        seen[order] = rows
        to = seen[s] + nth
        back = np.empty(len(to), np.int64)
        back[to] = np.arange(len(to))
        p, n, score = p[back], n[back], score[back]
        s = np.repeat(order, many)
        mass = np.zeros(len(chars))
        steps = np.searchsorted(left[order], np.arange(int(left.max()) + 2))
        bounds = np.r_[rows, len(s)]
        for r in range(1, int(left.max()) + 1):
            a, b = steps[r], steps[r + 1]
            if a < b:
                e = slice(bounds[a], bounds[b])
                mass[order[a:b]] = np.logaddexp.reduceat(score[e] + mass[s[e] + n[e]], rows[a:b] - bounds[a])
        log_p = np.minimum(score + mass[s + n] - mass[s], 0.0)
        row = np.repeat(np.arange(len(rows)), many)
        total = np.r_[0.0, np.cumsum(np.exp(log_p))]
        before, whole = total[rows], total[bounds[1:]] - total[rows]
        below = (total[:-1] - before[row]) / whole[row]  # 0 for the first step of a position
        first, count = np.zeros(len(chars), np.int32), np.zeros(len(chars), np.int32)
        first[order], count[order] = rows + edge_base, many
        self.put(base, first=first, count=count, letter=letter)
        self.put(edge_base, below=below, log_p=log_p, piece=p, next=s + n + base)
        self.positions, self.steps = base + len(first), edge_base + len(below)
        return base + ends - size

    def source(self, steps: np.ndarray | slice) -> np.ndarray:
        """The positions that steps start from."""
        p = self.piece[steps]
        return self.next[steps] - np.where(p < 0, 1, self.v.chars[np.maximum(p, 0)])

    def log_rest(self, steps: np.ndarray) -> np.ndarray:
        """The log chance of all other steps from the same positions; -inf where there is none."""
        p = self.log_p[steps]
        left = np.log(np.maximum(-np.expm1(np.minimum(p, -1e-15)), 1e-300))
        sure = np.flatnonzero(p > -1e-9)
        left[sure[self.count[self.source(steps[sure])] == 1]] = -np.inf
        return left

    def walk(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps from each position to its chunk's end: (all steps, how many each has). ``seed``: a hash for each position."""
        count, found, k = self.count[at], [], np.zeros(len(at), np.int64)
        owner = np.flatnonzero(count > 0)
        pos, count, seed, j = at[owner], count[owner], seed[owner], 0
        while len(owner):
            u = uniform(seed + np.uint64(j * 0xD1342543DE82EF95 & (1 << 64) - 1))
            e = self.first[pos] + count - 1  # the longest piece is mostly the likeliest
            early = np.flatnonzero(self.below[e] > u)
            while len(early):
                e[early] -= 1
                early = early[self.below[e[early]] > u[early]]
            found.append((owner, e))
            k[owner] += 1
            pos = self.next[e]
            count = self.count[pos]
            go = np.flatnonzero(count)
            owner, pos, count, seed, j = owner[go], pos[go], count[go], seed[go], j + 1
        out, offset = np.zeros(int(k.sum()), np.int64), np.cumsum(k) - k
        for j, (o, e) in enumerate(found):
            out[offset[o] + j] = e
        return out, k


def uniform(h: np.ndarray) -> np.ndarray:
    return ((mix(h) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(location: np.ndarray, u: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Gumbel numbers at locations, given that they are below ``top``; -inf where the location is."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.log(np.exp(-top) - np.log(u) * np.exp(-location))


class Row:
    """One text's queue of branches."""

    __slots__ = ("paths", "queue")

    def __init__(self):
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # steps, the chunk of each, perturbed score, log p
        self.queue: list[tuple[float, int, int, tuple[int, ...]]] = []  # score, path, step, steps left out there


def sampled(lat: Lattices, texts: list[str], keys: list[int], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k (steps, log probability, perturbed score, log inclusion probability), best first."""
    start, size = lat.starts(texts)
    base = mix(np.array([x & (1 << 64) - 1 for x in keys], np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(texts)), size)
    nth = np.arange(len(start)) - begin[row]
    rows = [Row() for _ in texts]
    for r in range(k):
        tag = np.uint64((r + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        spot = nth.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + tag
        if r == 0:
            steps, n = lat.walk(start, mix(base[row] + spot))
            bounds = np.r_[0, np.cumsum(n)]  # of each chunk's fresh steps
            tops = gumbel(uniform(base ^ tag))
            of, ends = np.repeat(nth, n), bounds[np.r_[begin, len(start)]].tolist()
            parts = [(i, steps[a:b], of[a:b], 0, top, (), 0.0) for i, (a, b, top) in enumerate(zip(ends, ends[1:], tops.tolist(), strict=False))]
        else:
            parts = []
            popped = []
            for i, row_ in enumerate(rows):
                if row_.queue:
                    best = max(row_.queue)
                    row_.queue.remove(best)
                    popped.append((i, best))
            turns, after, others_left = [], [], []
            us = uniform(base ^ (tag + np.uint64(17)))
            for i, (_, p, t, out) in popped:  # another step than those drawn there before
                es, w = others(lat, int(rows[i].paths[p][0][t]), out)
                c = np.cumsum(w)
                e = min(len(es) - 1, int(np.searchsorted(c, us[i] * c[-1], "right")))
                turns.append(es[e])
                others_left.append(sum(w[:e] + w[e + 1:]))
                after.append(begin[i] + int(rows[i].paths[p][1][t]) + 1)  # the chunk after the turn's
            rest, m = lat.walk(lat.next[np.array(turns, np.int64)], mix(base[[i for i, _ in popped]] + tag + np.uint64(99))) if turns else (np.zeros(0, np.int64),) * 2
            cut_at = np.r_[0, np.cumsum(m)]
            left = np.array([begin[i] + size[i] - a for (i, _), a in zip(popped, after, strict=True)], np.int64)
            stop = np.cumsum(left)
            need = np.arange(int(left.sum())) + np.repeat(np.array(after, np.int64) - (stop - left), left)  # only chunks after a turn are drawn anew
            steps, n = lat.walk(start[need], mix(base[row[need]] + spot[need]))
            bounds = np.r_[0, np.cumsum(n)]
            for x, (i, (top, p, t, out)) in enumerate(popped):
                old, of, *_ = rows[i].paths[p]
                tail, mine = rest[cut_at[x]: cut_at[x + 1]], slice(stop[x] - left[x], stop[x])
                whole = np.concatenate([old[:t], turns[x: x + 1], tail, steps[bounds[mine.start]: bounds[mine.stop]]])
                # Only a later draw asks for the chunks of steps.
                chunk = np.concatenate([of[:t], np.full(1 + len(tail), int(of[t])), np.repeat(nth[need[mine]], n[mine])]) if r < k - 1 else of[:0]
                parts.append((i, whole, chunk, t, top, (*out, turns[x]), others_left[x]))
        if not parts:
            break
        long = np.array([len(p[1]) for p in parts], np.int64)
        begins = np.cumsum(long) - long
        every = np.concatenate([p[1] for p in parts])
        log_p = lat.log_p[every]
        for (i, whole, chunk, _, top, *_), a, b in zip(parts, begins.tolist(), (begins + long).tolist(), strict=True):
            rows[i].paths.append((whole, chunk, top, float(log_p[a:b].sum())))
        turn, tops, rest_left = (np.array(list(c)) for c in zip(*[(p[3], p[4], p[6]) for p in parts], strict=True))
        own_base, out_there, most = base[[p[0] for p in parts]] + tag, np.array([bool(p[5]) for p in parts]), k - r  # no more can be drawn
        for x, places, scores in best_branches(lat, every, log_p, begins, long, turn, tops, out_there, rest_left, own_base, most):
            i, whole, _, t, _, out, _ = parts[x]
            for j, v in zip(places, scores, strict=True):
                if v > -np.inf:
                    rows[i].queue.append((v, len(rows[i].paths) - 1, j, out if j == t and out else (int(whole[j]),)))
    result = []
    for row_ in rows:
        least = max((q[0] for q in row_.queue), default=-np.inf)
        result.append([(whole, lp, top, log_inclusion(lp - least)) for whole, _, top, lp in row_.paths])
    return result


def best_branches(lat: Lattices, every: np.ndarray, log_p: np.ndarray, begins: np.ndarray, long: np.ndarray, turn: np.ndarray, tops: np.ndarray,
                  out_there: np.ndarray, rest_left: np.ndarray, seed: np.ndarray, most: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """The ``most`` best branches of each path: (path, their steps, their scores).

    What a branch holds falls along a path with the chance of the steps before it. From where that is SPREAD under the mass of ``most`` earlier
    branches, none can be among the best, whatever its random number; so a path is followed only that far, twice as far each time.
    """
    todo, width = np.flatnonzero(long > 0), 128
    while len(todo):
        place = np.arange(width)
        inside = place < long[todo, None]
        at = np.minimum(begins[todo, None] + place, len(every) - 1)
        ahead = np.zeros((len(todo), width + 1))
        np.cumsum(np.where(inside, log_p[at], 0.0), axis=1, out=ahead[:, 1:])
        mass = ahead[:, :-1] + lat.log_rest(every[at].ravel()).reshape(at.shape)
        mass[~inside | (place < turn[todo, None])] = -np.inf  # branches before the turn are those of the path it comes from
        at_turn = np.flatnonzero(out_there[todo] & (turn[todo] < width))  # there all steps drawn so far are out
        with np.errstate(divide="ignore"):
            t = turn[todo[at_turn]]
            mass[at_turn, t] = ahead[at_turn, t] + np.log(rest_left[todo[at_turn]])
        m = min(most, width)
        least = np.partition(mass, width - m, axis=1)[:, width - m]
        settled = (long[todo] <= width) | ((m == most) & (least > ahead[:, -1] + SPREAD))
        mine, mass = todo[settled], mass[settled]
        u = uniform(seed[mine, None] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        score = truncated(mass, u, tops[mine, None])
        best = np.argpartition(score, width - m, axis=1)[:, width - m:]
        yield from zip(mine.tolist(), best.tolist(), np.take_along_axis(score, best, axis=1).tolist(), strict=True)
        todo, width = todo[~settled], 2 * width


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), for x the log probability less the threshold (-inf where nothing is left to be drawn)."""
    return x if x < -30 else 0.0 if x > 30 else float(np.log(-np.expm1(-np.exp(x))))


def others(lat: Lattices, step: int, out: tuple[int, ...]) -> tuple[list[int], list[float]]:
    """The steps at a step's position that are not out, with their chances."""
    p = int(lat.piece[step])
    pos = int(lat.next[step]) - (1 if p < 0 else int(lat.v.chars[p]))
    es = [e for e in range(int(lat.first[pos]), int(lat.first[pos]) + int(lat.count[pos])) if e not in out]
    return es, np.exp(lat.log_p[es]).tolist()


def pieces_of(lat: Lattices, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all steps, and how many each step has: one, or the bytes of a character without a piece."""
    p = lat.piece[steps]
    size = np.ones(len(p), np.int64)
    spelt = np.flatnonzero(p < 0)
    if not len(spelt):
        return p, size
    raws = [(SPACE if c == STAND_IN else c).encode() for c in map(chr, (-1 - p[spelt]).tolist())]
    size[spelt] = [len(r) for r in raws]
    out, first = np.repeat(p, size), np.cumsum(size) - size
    flat = np.frombuffer(b"".join(raws), np.uint8)
    n = size[spelt]
    out[np.repeat(first[spelt] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = lat.v.byte[flat]
    return out, size


def ids_of(lat: Lattices, steps: np.ndarray) -> np.ndarray:
    return pieces_of(lat, steps)[0]


KEPT: dict[tuple[str, float], Lattices] = {}  # of a worker, over its tasks


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segmentations(docs: DataFrame, k: int = 2, sharpness: float = 1.0, seed: int = 1, path: str | None = None, batch_chars: int = 500_000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank (from 1), n_pieces, log_prob, score (perturbed), log_inclusion, round_trip, ids: up to k rows per row of docs.

    A null or empty text has one segmentation, the empty one. Texts with fewer than k segmentations give them all, with
    log inclusion 0. round_trip says that decoding the ids gives the text. Rows of one id and text give equal results.
    """
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, sharpness) not in KEPT:
            KEPT[path, sharpness] = Lattices(Vocabulary(path, sharpness))
        lat = KEPT[path, sharpness]
        v = lat.v

        def flush(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            keys = [xxhash.xxh3_64_intdigest(str(i)) for i in ids]
            cols: list[list] = [[] for _ in range(5)]
            whose, steps = [], []
            for x, got in enumerate(sampled(lat, texts, keys, k, seed)):
                for rank, (own, lp, top, inclusion) in enumerate(got, 1):
                    whose.append(x)
                    steps.append(own)
                    for c, value in zip(cols, (ids[x], rank, lp, top, inclusion), strict=True):
                        c.append(value)
            pieces, each = pieces_of(lat, np.concatenate(steps) if steps else np.zeros(0, np.int64))
            bounds = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum([len(o) for o in steps])].astype(np.int64)]
            raw, ends = v.raw(pieces)
            at = np.r_[0, ends][bounds].tolist()
            said = [(" " + t).encode() if t else b"" for t in texts]
            same = [raw[a:b] == said[x] for x, a, b in zip(whose, at, at[1:], strict=False)]
            number, rank, lp, top, inclusion = (pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), *[pa.float64()] * 3), strict=True))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pieces.astype(np.int32)))
            return pa.RecordBatch.from_arrays([number, rank, pa.array(np.diff(bounds)), lp, top, inclusion, pa.array(same, pa.bool_()), lists],
                                              ["doc_id", "rank", "n_pieces", "log_prob", "score", "log_inclusion", "round_trip", "ids"])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= batch_chars:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    cols = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")]
    return docs.select(*cols).mapInArrow(
        work, "doc_id long, rank int, n_pieces long, log_prob double, score double, log_inclusion double, round_trip boolean, ids array<int>")
