"""Edit similarity of two texts (0..100), as Arrow-batched functions.

Longest common subsequences are counted with one big integer per text, a bit for each letter. Where only similarities over a cutoff
matter, most pairs are settled before that, by the q-gram count bound: let w be a window of k letters that shares l letters in order
with a text of m. Each of the k - l and m - l other letters spoils q or q - 1 of the q-grams, so at least
(2q - 1) l - (q - 1)(m + k) - (q - 1) are common. Hashed q-grams can only add to the count, never take from it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(a):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def _common(masks: dict[str, int], size: int, text: str) -> int:
    full = s = (1 << size) - 1
    for x in map(masks.get, text):
        if x:
            u = s & x
            s = (s + u) | (s - u)  # what is carried out above the letters stays there
    return size - (s & full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * common / (len a + len b); two empty texts are equal."""
    if not a and not b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    return 200.0 * _common(_masks(a), len(a), b) / (len(a) + len(b))


def _best_window(short: str, long: str, floor: float) -> float:
    """Best ratio of ``short`` against a window of ``long``, or ``floor`` if nothing beats it.

    Moving a window by s letters changes the common length by at most s, so offsets that cannot beat
    the best so far are skipped without losing any.
    """
    m, n = len(short), len(long)
    best = floor
    # The common part is never longer than the letters both texts share.
    cap = sum((Counter(short) & Counter(long)).values())
    if 200.0 * cap / (m + cap) <= best:
        return best
    masks = _masks(short)
    i = 0
    while i <= n - m:
        got = _common(masks, m, long[i:i + m])
        best = max(best, 100.0 * got / m)
        if best >= 100.0:
            return best
        need = int(best * m / 100.0) + 1  # smallest common length that beats best
        i += max(1, need - got)
    return _best_end(short, long, best, cap, masks)


def _best_end(short: str, long: str, best: float, cap: int, masks: dict[str, int]) -> float:
    """The same for the windows at the two ends of ``long`` that are shorter than ``short``."""
    m, n = len(short), len(long)
    for cut in (lambda k: long[:k], lambda k: long[n - k:]):
        k = min(m - 1, n)
        while k > 0:
            # No window of k letters shares more than min(k, cap); below k = cap that bound only falls.
            if 200.0 * min(k, cap) / (m + k) <= best:
                if k <= cap:
                    break
                k = max(cap, min(k - 1, int(200.0 * cap / best - m)))
                continue
            got = _common(masks, m, cut(k))
            best = max(best, 200.0 * got / (m + k))
            # Shorter windows share at most `got`: only those under 2*got/best - m letters can win.
            k = min(k - 1, int(200.0 * got / best - m)) if best > 0 else k - 1
    return best


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q letters."""
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = (h + codes[i:i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def least_common(m: int, k, floor: float):
    """Letters in order that a window of k letters shares with a text of m at least, if its ratio is over ``floor``."""
    return (floor * (m + k) / 200 + 1 - 1e-6).astype(np.int64) if isinstance(k, np.ndarray) else int(floor * (m + k) / 200 + 1 - 1e-6)


def least_window(m: int, floor: float) -> int:
    """Letters of the shortest window that can have a ratio over ``floor``."""
    k = max(1, int(floor * m / (200 - floor)))
    while k < m and least_common(m, k, floor) > k:
        k += 1
    return k


def least_grams(m: int, k: int, q: int, floor: float) -> int:
    return (2 * q - 1) * least_common(m, k, floor) - (q - 1) * (m + k) - (q - 1)


def within_reach(a: str, b: str, floor: float) -> bool:
    """May a window of the longer text b have a ratio over ``floor`` with a? By the q-grams that both texts hold, counted as often as both do."""
    x, y, m = letters(a), letters(b), len(a)
    k = least_window(m, floor)
    for q in (3, 4):
        need = min(least_grams(m, k, q, floor), least_grams(m, m, q, floor))
        if need > 0:
            g, n = np.unique(gram_hashes(x, q), return_counts=True)
            h, c = np.unique(gram_hashes(y, q), return_counts=True)
            at = np.minimum(np.searchsorted(h, g), len(h) - 1)
            if np.minimum(n, c[at])[h[at] == g].sum() < need:
                return False
    return True


def partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """Best ratio of the shorter text against any window of the longer one; 0 where it stays below ``cutoff``."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    floor = max(0.0, cutoff - 1e-9)
    if floor > 0 and not reaches(a, b, floor):
        return 0.0
    best = _best_window(a, b, floor)
    if len(a) == len(b) and best < 100.0:
        best = max(best, _best_window(b, a, best))
    return best if best > floor or cutoff <= 0 else 0.0


def _least(size: int, cutoff: float) -> int:
    """Common letters of two texts with ``size`` letters together from which their ratio is at least ``cutoff``."""
    need = max(0, int(cutoff * size / 200) - 1)
    while 200.0 * need / size < cutoff:
        need += 1
    return need


class _Run:
    """Common letters of a text and a stretch of another that grows letter by letter; ``masks`` are those of the other's letters."""

    def __init__(self, masks: list[int], m: int, start: int = 0):
        self.masks, self.m, self.start, self.at, self.got = masks, m, start, start, 0
        self.full = self.state = (1 << m) - 1

    def to(self, at: int) -> None:
        s = self.state
        for x in self.masks[self.at:at]:
            if x:
                u = s & x
                s = (s + u) | (s - u)  # what is carried out above m letters stays there
        self.state, self.at = s, min(at, len(self.masks))
        self.got = self.m - (s & self.full).bit_count()

    def until(self, need: int) -> int:
        """Letters until ``need`` of them are common; one more than there are, if that is never so. A letter adds one at most."""
        while self.got < need:
            if self.at == len(self.masks):
                return self.at - self.start + 1
            self.to(self.at + need - self.got)
        return self.at - self.start

    def beginning(self, cutoff: float, most: int) -> bool:
        """Has a beginning shorter than m a ratio of at least ``cutoff``? ``most`` letters of it are common at most."""
        share, m = cutoff / 200, self.m
        last = min(m - 1, len(self.masks), int(most / share - m + 1e-6))
        while True:
            stop = max(self.at + 1, int((share * m + self.at - self.got) / (1 - share) - 1e-6))  # shorter ones cannot have it
            if stop > last:
                return False
            self.to(stop)
            if 200.0 * self.got / (m + self.at) >= cutoff:
                return True


def reaches(a: str, b: str, cutoff: float) -> bool:
    """Is the partial ratio of two texts at least ``cutoff``? Ends with the first window that has it.

    A stretch of the longer text that shares too few letters holds no window that shares enough, so each run goes on until it does and
    settles all windows inside at once.
    """
    if cutoff <= 0 or not a and not b:
        return cutoff <= 100
    if not a or not b:
        return False
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    cap = sum((Counter(a) & Counter(b)).values())
    if 200.0 * cap / (m + cap) < cutoff or m > 64 and not within_reach(a, b, max(0.0, cutoff - 1e-9)):
        return False
    for x, y in ((a, b), (b, a)) if m == n else ((a, b),):
        own = _masks(x)
        masks, need, i = [own.get(ch, 0) for ch in y], _least(2 * m, cutoff), 0
        run = _Run(masks, m)
        if run.beginning(cutoff, m):
            return True
        while True:
            got = run.until(need)
            if got <= m:
                return True
            i += got - m
            if i > n - m:
                break
            run = _Run(masks, m, i)
        own = _masks(x[::-1])
        if _Run([own.get(ch, 0) for ch in reversed(y[-m:])], m).beginning(cutoff, min(m, run.got)):
            return True
    return False


def over(a: str, b: str, limit: float) -> bool:
    """Is the ratio of two texts over ``limit``? Lengths and shared letters settle most pairs."""
    if not a and not b:
        return limit < 100
    if 200.0 * min(len(a), len(b)) / (len(a) + len(b)) <= limit or 200.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) <= limit:
        return False
    return indel_ratio(a, b) > limit


CELLS = 2  # on either side: the diagonals that a near window may touch lie in so many cells around its own
TOGETHER = 12  # cells that are settled together
TABLE = 1 << 14  # places of the table of a text's q-grams
HELD = 1 << 19  # hits and cells that are held at once
LETTERS = 1 << 21  # letters that are held at once
LANES = 1 << 12  # windows that are compared at once
WORD = 63  # letters in a word; its highest bit takes the carry
ONES = np.uint64((1 << WORD) - 1)


def _least_whole(m: np.ndarray, cutoff: float) -> np.ndarray:
    """Letters that a text of m and a window of as many share in order at least, if their ratio is over ``cutoff``."""
    need = np.maximum((cutoff * m / 100).astype(np.int64) - 1, 0)
    while (low := 100.0 * need / m <= cutoff).any():
        need += low
    return need


def _least_end(m: np.ndarray, cutoff: float) -> np.ndarray:
    """Letters of the shortest window that can have a ratio over ``cutoff``; m if none of fewer letters can."""
    k = np.maximum((cutoff * m / (200 - cutoff)).astype(np.int64) - 1, 0)
    while (low := (200.0 * k / (m + k) <= cutoff) & (k < m)).any():
        k += low
    return k


def _gram_places(codes: np.ndarray, q: int) -> np.ndarray:
    """A place in the table for each run of q letters."""
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint32)
    for i, by in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:q]):
        h += codes[i:i + n].astype(np.uint32) * np.uint32(by)
    return (h >> np.uint32(18)).astype(np.uint16)


class _Search:
    """Short texts, each looked for in a long one of at least its length; ``of`` is the long text of each, in rising order.

    A q-gram that text and window share in order lies on a diagonal: its place in the one less that in the other. If at most e letters of
    each are left over, all of them lie on the 2e + 1 diagonals around the window's own. Shared q-grams are counted by cells of diagonals, and
    only where a cell and its neighbours hold what the q-gram count bound asks for can its windows be near. They are settled together by
    the letters shared with the whole stretch they cover, then cell by cell, then one by one.
    """

    def __init__(self, shorts: Sequence[str], longs: Sequence[str], of: Sequence[int], cutoff: float):
        self.shorts, self.longs, self.cutoff, self.text = shorts, longs, cutoff, "".join(longs)
        x, y = letters("".join(shorts)), letters(self.text)
        used = np.zeros(0x110000, bool)
        used[x] = True
        self.alphabet = int(used.sum()) + 1
        place = np.zeros(len(used), np.uint16 if self.alphabet < 1 << 16 else np.uint32)
        place[used] = np.arange(1, self.alphabet)
        self.x, self.y = place[x], place[y]  # 0 is a letter of no short text
        self.of = np.array(of, np.int64)
        self.m, n = np.array([*map(len, shorts)], np.int64), np.array([*map(len, longs)], np.int64)
        self.x_at, self.y_at, self.n = np.cumsum(self.m) - self.m, np.cumsum(n) - n, n[self.of]
        self.whole, self.end = _least_whole(self.m, cutoff), _least_end(self.m, cutoff)

    def _bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each short text the q whose q-grams are counted, and how many a near window holds at least: a whole one, a shorter one."""
        m, whole = self.m, self.whole
        q = np.where(5 * whole - 4 * m - 2 > 0, 3, 2)
        # Shorter windows go by the share of common letters before it is rounded up: the bound is straight then, so its ends are its least.
        ends = [((2 * q - 1) * self.cutoff / 200 - (q - 1)) * (m + k) - (q - 1) for k in (self.end, m)]
        return q, (2 * q - 1) * whole - 2 * (q - 1) * m - (q - 1), np.floor(np.minimum(*ends) - 1e-6).astype(np.int64) + 1

    def _near_cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Short text, cell, first and last window of each cell that may hold a near window, and whether shorter windows at the beginning
        and at the end of the long text may be near."""
        m, n, e = self.m, self.n, self.m - self.whole
        uses, least, least_end = self._bounds()
        by = np.minimum((CELLS - 0.01) / (e + 1), 0.125)  # cells a diagonal
        cells = ((n + m) * by).astype(np.int64) + 1
        who = np.repeat(np.arange(len(m)), m)
        place = np.arange(len(self.x)) - self.x_at[who]
        grams = {}
        for q in (2, 3):
            runs = np.flatnonzero((place <= m[who] - q) & ((uses == q) & (least > 0))[who])
            if len(runs):
                grams[q] = runs, _gram_places(self.x, q)[runs].astype(np.int64), _gram_places(self.y, q)
        out: list[tuple[np.ndarray, ...]] = []
        open_ends = np.zeros((2, len(m)), bool)
        hits: list[tuple[np.ndarray, np.ndarray]] = []  # the cell of each, those of all short texts in one row, and the first whose sum it is in

        def count(first: int, last: int) -> None:
            own = slice(first, last)
            base = np.cumsum(cells[own] + CELLS) - cells[own]
            total = int(base[-1] + cells[last - 1] + CELLS)
            ends, starts = (np.bincount(np.concatenate([np.zeros(0, np.int64), *z]), minlength=total + 1)
                            for z in (zip(*hits, strict=True) if hits else ((), ())))
            hits.clear()
            starts[CELLS + 1:] -= ends[:-CELLS - 1]
            near = np.cumsum(starts)[CELLS:total - CELLS] >= np.repeat(least[own], cells[own] + CELLS)[:total - 2 * CELLS]
            cell, sums = np.flatnonzero(near) + CELLS, np.cumsum(ends) - ends
            i = np.searchsorted(base, cell, "right") - 1
            cell -= base[i]
            i += first
            lo = np.maximum((cell / by[i]).astype(np.int64) - m[i] - 1, 0)
            hi = np.minimum(((cell + 1) / by[i]).astype(np.int64) - m[i] + 1, n[i] - m[i])
            ok = (cell < cells[i]) & (lo <= hi)
            out.append((i[ok], cell[ok], lo[ok], hi[ok]))
            for side, ranged in enumerate(((self.end - 1, m + e + 2), (n - e - 2, n + m - self.end + 1))):
                a, b = (base + (np.clip(z, 0, n + m) * by)[own].astype(np.int64) for z in ranged)
                open_ends[side, own] = (self.end < m)[own] & (sums[b + 1] - sums[a] >= np.where(least[own] > 0, least_end[own], 0))

        first, held, width = 0, 0, 0
        bounds = np.searchsorted(self.of, np.arange(len(self.longs) + 1)).tolist()
        for t, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a == b:
                continue
            size, load, found = len(self.longs[t]), cells[a:b].copy(), []
            for q, (runs, kinds, places) in grams.items():
                lo, hi = np.searchsorted(runs, (self.x_at[a], self.x_at[b - 1] + m[b - 1]))
                if lo == hi:
                    continue
                y = places[self.y_at[t]:self.y_at[t] + size - q + 1]
                starts = np.zeros(TABLE + 1, np.int64)
                np.cumsum(np.bincount(y, minlength=TABLE), out=starts[1:])
                begin, own = starts[kinds[lo:hi]], who[runs[lo:hi]]
                asked = starts[kinds[lo:hi] + 1] - begin
                each = np.bincount(own - a, asked, b - a).astype(np.int64)
                if (each > 8 * size).any():  # q-grams that are all over the text tell little: all windows of these are looked at
                    least[a:b][each > 8 * size] = 0
                    asked[least[own] <= 0] = 0
                    each[each > 8 * size] = 0
                load += each
                found.append((np.argsort(y, kind="stable").astype(np.float64), runs[lo:hi], begin, asked))
            part = (np.cumsum(load) - load) // HELD
            for c, d in zip(*(lambda z: (z[:-1], z[1:]))([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b - a])):
                more = int(load[c:d].sum())
                if held and held + more > HELD:
                    count(first, a + c)
                    first, held, width = a + c, 0, 0
                base = width + np.cumsum(cells[a + c:a + d] + CELLS) - cells[a + c:a + d]
                held, width = held + more, int(base[-1] + cells[a + d - 1])
                for order, runs, begin, asked in found:
                    lo, hi = np.searchsorted(runs, (self.x_at[a + c], self.x_at[a + d - 1] + m[a + d - 1]))
                    some, times = runs[lo:hi], asked[lo:hi]
                    so_far = np.cumsum(times)
                    if len(times) and so_far[-1]:
                        on = order[np.arange(so_far[-1]) + np.repeat(begin[lo:hi] - so_far + times, times)]
                        own = who[some]
                        on *= np.repeat(by[own], times)
                        on += np.repeat((m[own] - place[some]) * by[own] + base[own - a - c], times)
                        on = on.astype(np.int64)
                        since, head = on - CELLS, (so_far - times)[times > 0]
                        since[1:] = np.maximum(since[1:], on[:-1] + CELLS + 1)  # a run of letters counts once in a sum, however often it is met
                        since[head] = on[head] - CELLS
                        hits.append((on, since))
        count(first, len(m))
        return *(np.concatenate(z) for z in zip(*out, strict=True)), open_ends

    def _shared(self, of: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Letters that the short text ``of`` shares in order with the ``size`` letters from ``start`` of its long text."""
        out = np.zeros(len(of), np.int64)
        start = start + self.y_at[self.of[of]]
        words = (self.m[of] + WORD - 1) // WORD
        words = np.where(words > 6, (words + 3) // 4 * 4, words)
        order = np.lexsort((-size, words))
        i = 0
        while i < len(order):
            most = int(words[order[i]])
            i, lanes = (j := min(i + max(1, min(LANES, 4 * HELD // (self.alphabet * most))), int(np.searchsorted(words[order], most, "right")))), order[i:j]
            if len(lanes) < min(200, 25 + 4 * most):  # too few to share the cost of a step
                masks: dict[int, dict[str, int]] = {}
                for k, s, at, z in zip(lanes.tolist(), of[lanes].tolist(), start[lanes].tolist(), size[lanes].tolist()):
                    if s not in masks:
                        masks[s] = _masks(self.shorts[s])
                    out[k] = _common(masks[s], len(self.shorts[s]), self.text[at:at + z])
            else:
                out[lanes] = self._lanes(of[lanes], start[lanes], size[lanes], most)
        return out

    def _lanes(self, of: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
        """The same for lanes of falling size, all at once, with ``words`` words a lane; letters over a text's last stay as they were."""
        own, row = np.unique(of, return_inverse=True)
        m = self.m[own]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        masks = np.zeros((len(own) * self.alphabet, words), np.uint64)
        letter = np.repeat(np.arange(len(own)) * self.alphabet, m) + self.x[np.repeat(self.x_at[own], m) + at]
        np.bitwise_or.at(masks, (letter, at // WORD), np.uint64(1) << (at % WORD).astype(np.uint64))
        s = state = np.full((len(of), words), ONES)
        row, here = row * self.alphabet, start.copy()
        c, letter, carry = np.zeros(len(of), np.int64), np.zeros(len(of), self.y.dtype), np.zeros(len(of), np.uint64)
        u, t = np.zeros((2, len(of), words), np.uint64)
        last = int(size[0])
        for j, n in enumerate(np.searchsorted(-size, -np.arange(last), "left").tolist()):  # lanes with more than j letters
            if n < len(c):
                c, letter, carry, u, t, here, row, s = c[:n], letter[:n], carry[:n], u[:n], t[:n], here[:n], row[:n], s[:n]
            self.y.take(here, out=letter, mode="clip")
            np.add(row, letter, out=c)
            here += 1
            masks.take(c, axis=0, out=u, mode="clip")
            u &= s
            np.add(s, u, out=t)
            for w in range(1, words):
                np.right_shift(t[:, w - 1], np.uint64(WORD), out=carry)
                t[:, w] += carry
            s ^= u
            s |= t
            s &= ONES
        return WORD * words - np.bitwise_count(state).sum(1, dtype=np.int64)

    def over(self) -> np.ndarray:
        """Is the best ratio of each short text and a window of its long one over the cutoff?"""
        m, whole = self.m, self.whole
        i, cell, lo, hi, ends = self._near_cells()
        found = np.zeros(len(m), bool)
        # Neighbouring cells together, and of what is left first the window in the middle.
        new = np.r_[True, (np.diff(i) != 0) | (np.diff(cell // TOGETHER) != 0)][:len(i)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(i)][:len(head)] - 1
        most = m - 1  # letters of a shorter window
        sides = [np.flatnonzero(x) for x in ends]
        begins = [0 * most, self.n - most]
        got = self._shared(np.r_[i[head], sides[0], sides[1]], np.r_[lo[head], begins[0][sides[0]], begins[1][sides[1]]],
                           np.r_[hi[tail] - lo[head] + m[i[head]], most[sides[0]], most[sides[1]]])
        got, *got_ends = np.split(got, [len(head), len(head) + len(sides[0])])
        left = got >= whole[i[head]]
        some, middle = i[head[left]], (lo[head[left]] + hi[tail[left]]) // 2
        found[some[self._shared(some, middle, m[some]) >= whole[some]]] = True
        on = left[np.cumsum(new) - 1] & ~found[i]
        i, lo, hi = i[on], lo[on], hi[on]
        on = self._shared(i, lo, hi - lo + m[i]) >= whole[i]
        i, lo, n = i[on], lo[on], (hi - lo + 1)[on]
        some, at = np.repeat(i, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
        found[some[self._shared(some, at, m[some]) >= whole[some]]] = True
        near_ends = np.concatenate([own[got >= self.end[own]] for own, got in zip(sides, got_ends, strict=True)])
        for k in np.unique(near_ends[~found[near_ends]]).tolist():
            a, b = self.shorts[k], self.longs[self.of[k]]
            found[k] = _best_end(a, b, max(0.0, self.cutoff - 1e-9), len(a), _masks(a)) > self.cutoff
        return found


def near_items(items: Sequence[Sequence[str]], texts: Sequence[str], cutoff: float) -> list[list[bool]]:
    """For each text and each of its items: is their partial ratio over ``cutoff``?"""
    out = [[False] * len(own) for own in items]
    pairs: dict[str, list[tuple[str, int, int]]] = {}  # by the longer text: the shorter, whose they are
    held = 0

    def settle() -> None:
        asks = [(of, *x) for of, found in enumerate(pairs.values()) for x in found]
        if asks:
            of, shorts, *whose = zip(*asks, strict=True)
            for near, t, k in zip(_Search(shorts, [*pairs], of, cutoff).over().tolist(), *whose, strict=True):
                out[t][k] |= near
        pairs.clear()

    for t, (own, text) in enumerate(zip(items, texts, strict=True)):
        for k, item in enumerate(own):
            a, b = (item, text) if len(item) < len(text) else (text, item)
            if not a or not 0 < cutoff < 100:
                out[t][k] = partial_ratio(a, b, cutoff) > cutoff
            elif len(a) <= 3 and 200.0 * (len(a) - 1) / (2 * len(a) - 1) <= cutoff and 100.0 * (len(a) - 1) / len(a) <= cutoff:
                out[t][k] = a in b  # a letter less is too few
            else:
                for a, b in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
                    if b not in pairs:
                        pairs[b] = []
                        held += len(b)
                    pairs[b].append((a, t, k))
                    held += len(a)
        if held > LETTERS:
            settle()
            held = 0
    settle()
    return out


def near_items_udf(cutoff: float):
    """(items, text, other items, other text) -> for each item whether its partial ratio with its text is over ``cutoff``.

    A text comes once for all its items; the other text is null where it is the same one.
    """
    @F.pandas_udf("struct<own: array<boolean>, other: array<boolean>>")
    def near(items: pd.Series, texts: pd.Series, other_items: pd.Series, other_texts: pd.Series) -> pd.DataFrame:
        said = [t or "" for t in texts]
        rows = [[x or "" for x in (row if row is not None else ())] for both in zip(items, other_items) for row in both]
        got = near_items(rows, [t for a, b in zip(said, other_texts) for t in (a, a if b is None else b)], cutoff)
        return pd.DataFrame({"own": got[::2], "other": got[1::2]})

    return near


def over_udf(limit: float):
    @F.pandas_udf("boolean")
    def is_over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([over(x or "", y or "", limit) for x, y in zip(a, b)], dtype="bool")

    return is_over


def reaches_udf(cutoff: float):
    @F.pandas_udf("boolean")
    def has(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([reaches(x or "", y or "", cutoff) for x, y in zip(a, b)], dtype="bool")

    return has


def partial_ratio_udf(cutoff: float = 0.0):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio(x or "", y or "", cutoff) for x, y in zip(a, b)], dtype="float64")

    return ratio
