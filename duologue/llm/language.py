"""Language model scores from sharded Elias-Fano n-gram tries.

The model is a bigram model with Dirichlet smoothing, P(w | p) = (c(p w) + mu P0(w)) / (c(p) + mu), where c counts training
documents and P0(w) = (c(w) + 1) / (tokens + distinct words + ``CLASSES``) has every seen word by its own count; ``CLASSES``
is the number of unseen words it leaves mass for.

Every token but the end is the context of the next one, and there are as many begins as ends, so over a document the divisors
c(p) + mu of all contexts are those of all its tokens: its score is the sum of log10 (c(p w) + mu P0(w)) / (c(w) + mu). That
needs counts of w only, so bigrams are sharded by their second word, and a shard counts its words itself: no table of words
is joined or broadcast but the hot words' counts.

1. Words are counted over all training documents.
2. Every bigram of every document goes to a shard by its second word; a word so frequent that it would fill a quarter of a
   shard is spread by the first word, and its count is known from step 1. Documents travel in units, bigrams as packed
   arrays for each unit and shard.
3. A shard counts its words and training bigrams, writes a trie of two levels (words, and what stands before them) into a
   memory-mapped file, and looks up the bigrams of all its units in it: the second level's words are numbers relative to the
   first, monotone over the level (Elias-Fano), with Elias-Fano pointers from the first level; smoothed shares and back-off
   weights are quantised to 16 bits.
4. Sums for each document come back to its unit.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.common import WordHash, cut, mix

HEAD = 1 << 16  # hot words are looked for among so many
CLASSES = 1 << 18  # unseen words that P0 leaves mass for
END, BEGIN = np.uint64(0xFFFFFFFFFFFFFFFE), np.uint64(0xFFFFFFFFFFFFFFFD)
STEP = 40.0 / 65_535  # of quantised log10 probabilities


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class EliasFano:
    """A monotone sequence of numbers below 2**56: low bits packed, high bits in unary, with a rank directory."""

    def __init__(self, bits: int, n: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.bits, self.n, self.low, self.high, self.ones = bits, n, low, high, ones
        at = np.arange(len(high), dtype=np.int64) * 64
        self.zeros = at - ones[:-1]
        self.window = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        flags = np.zeros((n, bits), np.uint8)
        for j in range(bits):
            flags[:, j] = (v >> np.uint64(j)) & np.uint64(1)
        low = np.r_[np.packbits(flags.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)]
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) + 2 if n else 1) // 64 + 1
        flags = np.zeros(size * 64, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        return bits, low, high, np.r_[0, np.cumsum(np.bitwise_count(high))].astype(np.int64)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th set (or unset) high bit, from 0."""
        ranks = self.ones[:-1] if one else self.zeros
        w = np.searchsorted(ranks, k, "right") - 1
        word = self.high[w] if one else ~self.high[w]
        left, at = (k - ranks[w]).astype(np.int64), np.zeros(len(k), np.int64)
        for s in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count((word >> at.astype(np.uint64)) & np.uint64((1 << s) - 1)).astype(np.int64)
            go = left >= c
            left, at = left - c * go, at + s * go
        return w * 64 + at

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        b = i * self.bits
        return (self.window[b >> 3] >> (b & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is not below x (n, if none)."""
        x = x.astype(np.uint64)
        bucket, low = (x >> np.uint64(self.bits)).astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        buckets = len(self.high) * 64 - self.n  # zeros there are
        inside = bucket < buckets
        b = np.where(inside, bucket, 0)
        lo = np.where(b > 0, self.select(np.maximum(b - 1, 0), False) - (b - 1), 0)
        hi = np.minimum(self.select(b, False) - b, self.n)
        lo = np.minimum(lo, hi)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) // 2
            up = open_ & (self.lows(np.minimum(mid, max(0, self.n - 1))) < low)
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return np.where(inside, lo, self.n)


class Trie:
    """Contexts and their successors in one memory-mapped file."""

    def __init__(self, folder: str, contexts: np.ndarray, words: np.ndarray, owner: np.ndarray, word: np.ndarray,
                 log_p: np.ndarray, back: np.ndarray):
        """``owner`` and ``word`` number context and successor of each bigram, sorted by both."""
        self.universe = max(1, len(words))
        starts = np.searchsorted(owner, np.arange(len(contexts) + 1))
        parts = {"contexts": contexts, "words": words, "log_p": quantised(log_p), "back": quantised(back)}
        self.shape = {}
        for name, values in (("next", owner * self.universe + word), ("start", starts)):
            bits, low, high, ones = EliasFano.parts(values)
            self.shape[name] = (bits, len(values))
            parts |= {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones}
        self.path = os.path.join(folder, "trie")
        self.at: dict[str, tuple[int, np.dtype, int]] = {}
        with open(self.path, "wb") as f:
            for name, a in parts.items():
                f.write(b"\0" * (-f.tell() % 8))
                self.at[name] = (f.tell(), a.dtype, len(a))
                f.write(a.tobytes())
        self.load()

    def load(self) -> None:
        def get(name: str) -> np.ndarray:
            start, kind, n = self.at[name]
            return np.memmap(self.path, kind, "r", start, (n,)) if n else np.zeros(0, kind)

        self.contexts, self.words, self.log_p, self.back = (get(x) for x in ("contexts", "words", "log_p", "back"))
        self.next, self.start = (EliasFano(*self.shape[x], get(f"{x}.low"), get(f"{x}.high"), get(f"{x}.ones")) for x in ("next", "start"))

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability or nan where the bigram was not seen, log10 back-off weight of the context)."""
        c, known = found(self.contexts, context)
        w, there = found(self.words, word)
        back = np.where(known, restored(self.back[c]) if len(self.back) else 0.0, 0.0)
        out = np.full(len(context), np.nan)
        ask = np.flatnonzero(known & there)
        if len(ask):
            want = c[ask].astype(np.int64) * self.universe + w[ask]
            i = self.next.find(want)
            stop = self.start.access(c[ask].astype(np.int64) + 1).astype(np.int64)
            inside = i < stop  # the successor found is still one of this context
            j = np.minimum(i, max(0, self.next.n - 1))
            hit = inside & (self.next.access(j).astype(np.int64) == want)
            out[ask[hit]] = restored(self.log_p[j[hit]])
        return out, back


def quantised(log_p: np.ndarray) -> np.ndarray:
    """Rounded down in probability, so what is stored sums to at most what was there."""
    return np.minimum(65_535, np.ceil(np.maximum(0.0, -log_p) / STEP - 1e-9)).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return -STEP * code.astype(float)


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


class WordLevel:
    """P0, the totals of the base score, and the most frequent words with their counts."""

    def __init__(self, tokens: int, distinct: int, ends: int, head: np.ndarray, head_count: np.ndarray):
        by = np.argsort(head)
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.head, self.head_count = head[by], head_count[by]
        self.total = np.log10(tokens + distinct + float(CLASSES))

    def log_p0(self, word: np.ndarray, count: np.ndarray | int = 0) -> np.ndarray:
        """``count`` is what the caller has counted of words; words of the head have theirs."""
        i, known = found(self.head, word)
        return np.log10(np.where(known, self.head_count[i] if len(self.head) else 0, count) + 1.0) - self.total


def tokens_of(text: str | None, hashes: WordHash) -> np.ndarray:
    return np.r_[hashes.of((text or "").encode().lower().split()), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over training documents; words are 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wait, size = WordHash(), [], 0

        def flush() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(wait) if wait else np.array([], np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["word", "count"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not held_out(d):
                    wait.append(tokens_of(t.as_py(), hashes))
                    size += len(wait[-1])
            if size > 4_000_000:
                yield flush()
                wait, size = [], 0
        yield flush()

    return docs.mapInArrow(work, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def word_level(counts: DataFrame) -> WordLevel:
    end = F.col("word") == int(END.view(np.int64))
    one = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(end, F.col("count"))).alias("e")).head()
    head = counts.orderBy(F.desc("count"), "word").limit(HEAD).toArrow()  # a fixed number of rows
    return WordLevel(one.n or 0, one.v or 0, one.e or 0, head["word"].to_numpy().view(np.uint64), head["count"].to_numpy())


def small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, a.nbytes))], np.int64)
    return zstandard.ZstdCompressor(1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpacked(raw: bytes, kinds: dict[int, str] | None = None) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for i, (item, size) in enumerate(head.tolist()):
        kind = (kinds or {}).get(i, f"<u{item}")
        out.append(np.frombuffer(raw, kind, size // item, at))
        at += size
    return out


def bigram_blobs(docs: DataFrame, shards: int, hot: np.ndarray, unit_tokens: int) -> DataFrame:
    """(shard, unit, blob, docs): for each unit its bigrams of each shard; one of the rows holds the unit's doc_ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, units = WordHash(), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w = np.concatenate(texts)
            ends = np.cumsum([len(t) for t in texts])
            p = np.r_[BEGIN, w[:-1]]
            p[ends[:-1]] = BEGIN
            doc = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])
            shard = (mix(np.where(found(hot, w)[1], p, w)) % np.uint64(shards)).astype(np.int64)
            out: dict[int, bytes] = {}
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                r = order[cuts[s]: cuts[s + 1]]
                ps, pi = np.unique(p[r], return_inverse=True)
                ws, wi = np.unique(w[r], return_inverse=True)
                key = (wi.astype(np.uint64) * np.uint64(len(ps)) + pi.astype(np.uint64)) * np.uint64(len(texts)) + doc[r]
                key, times = np.unique(key, return_counts=True)
                d = key % np.uint64(len(texts))
                pair = key // np.uint64(len(texts))
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                own = (pair[first] // np.uint64(len(ps))).astype(np.int64)
                out[int(s)] = packed([ws, ps, small(np.bincount(own, minlength=len(ws))), small(pair[first] % np.uint64(len(ps))),
                                      small(np.diff(np.r_[first, len(key)])), small(d), small(times)])
            flags = np.array([held_out(i) for i in ids], np.uint8)
            plain = packed([np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), flags])
            unit = (task << 24) + units
            keys = list(out)
            head = packed([np.packbits(flags)])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([unit] * len(keys), pa.int64()), pa.array(list(out.values()), pa.binary()),
                 pa.array([head] * len(keys), pa.binary()), pa.array([plain] + [None] * (len(keys) - 1), pa.binary())],
                ["shard", "unit", "blob", "flags", "docs"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(d)
                texts.append(tokens_of(t.as_py(), hashes))
                size += len(texts[-1])
                if size >= unit_tokens or len(ids) >= 65_000:
                    yield flush()
                    ids, texts, size, units = [], [], 0, units + 1
        if ids:
            yield flush()

    return docs.mapInArrow(work, "shard long, unit long, blob binary, flags binary, docs binary")


def shard_sums(blobs: DataFrame, level: WordLevel, mu: float) -> DataFrame:
    """(unit, sums, docs): for each unit, sums of the shard's bigrams for each document that has some."""
    known_total = np.log10(level.tokens + level.distinct + 1.0)

    def work(t: pa.Table) -> pa.Table:
        rows = [(unpacked(b), np.unpackbits(unpacked(f)[0]).astype(bool)) for b, f in zip(t["blob"].to_pylist(), t["flags"].to_pylist(), strict=True)]
        ws, ps, cs = [], [], []
        for (w, p, per, pi, n_docs, doc, times), out in rows:  # training counts of the pairs of each unit
            pair = np.repeat(np.arange(len(pi)), n_docs)
            c = np.bincount(pair, times * ~out[doc], len(pi))
            seen = c > 0
            ws.append(np.repeat(w, per)[seen])
            ps.append(p[pi][seen])
            cs.append(c[seen].astype(np.int64))
        w, p, c = np.concatenate(ws), np.concatenate(ps), np.concatenate(cs)
        order = np.lexsort((p, w))
        w, p, c = w[order], p[order], c[order]
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])]) if len(w) else np.array([], np.int64)
        c = np.add.reduceat(c, first) if len(w) else c
        w, p = w[first], p[first]
        words, owner = np.unique(w, return_inverse=True)
        i, is_hot = found(level.head, words)
        total = np.where(is_hot, level.head_count[i] if len(level.head) else 0, np.bincount(owner, c, len(words)))
        before, place = np.unique(p, return_inverse=True)
        log_p = np.log10(c + mu * 10 ** level.log_p0(words, total)[owner]) - np.log10(total[owner] + mu) if len(w) else np.array([])
        units, sums = t["unit"].to_pylist(), []
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(folder, words, before, owner, place, log_p, np.log10(mu / (total + mu)))
            for (w, p, per, pi, n_docs, doc, times), _ in rows:
                at = np.repeat(np.arange(len(w)), per)
                seen, back = trie.look_up(w[at], p[pi])
                i, known = found(trie.contexts, w)
                count = np.where(known, total[i] if len(total) else 0.0, 0.0)
                j, is_hot = found(level.head, w)
                count = np.where(is_hot, level.head_count[j] if len(level.head) else 0.0, count)
                back = np.where(known[at], back, np.log10(mu / (count + mu))[at])  # a hot word may have no training bigram here
                score = np.where(np.isnan(seen), back + level.log_p0(w, count)[at], seen)
                base = np.log10(count + 1) - known_total
                own = at[np.repeat(np.arange(len(pi)), n_docs)]
                score = np.repeat(score, n_docs) * times
                docs, k = np.unique(doc, return_inverse=True)
                sums.append(packed([small(docs), np.bincount(k, score), np.bincount(k, base[own] * times),
                                    small(np.bincount(k, times).astype(np.int64)),
                                    small(np.bincount(k, times * (count > 0)[own]).astype(np.int64))]))
            del trie
        return pa.table({"unit": pa.array(units, pa.int64()), "sums": pa.array(sums, pa.binary()), "docs": t["docs"]})

    return blobs.groupBy("shard").applyInArrow(work, "unit long, sums binary, docs binary")


def scores(docs: DataFrame, mu: float = 100.0, shard_tokens: int = 3_000_000, unit_tokens: int = 2_000_000,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Documents with crc32(id) mod 7 = 2 are held out (a null id counts as empty text). A null or empty text is the end token
    alone. Repeated rows count as often as they are there. Without training documents every count is zero.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = cut(word_counts(docs))
    level = word_level(counts)
    shards = max(1, -(-int(level.tokens * 7 / 6) // shard_tokens))
    often = level.head_count >= max(1, level.tokens // (4 * shards))  # at most 4 * shards + 1
    hot, hot_count = level.head[often], level.head_count[often]
    rest = hot != END
    level = WordLevel(level.tokens, level.distinct, level.ends, np.r_[hot[rest], END], np.r_[hot_count[rest], level.ends])
    sums = shard_sums(bigram_blobs(docs, shards, level.head, unit_tokens), level, mu)
    tokens = int(level.tokens)

    def gather(t: pa.Table) -> pa.Table:
        ids, null, out = next(unpacked(d, {0: "<i8"}) for d in t["docs"].to_pylist() if d is not None)
        n = len(ids)
        score, base, n_tok, n_known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for raw in t["sums"].to_pylist():
            d, s, b, k, m = unpacked(raw, {1: "<f8", 2: "<f8"})
            score[d] += s
            base[d] += b
            n_tok[d] += k
            n_known[d] += m
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(out.astype(bool)),
                         "n_tokens": pa.array(n_tok), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(n, tokens)),
                         "base_score": pa.array(base), "score": pa.array(score)})

    return sums.groupBy("unit").applyInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
