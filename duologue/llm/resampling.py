"""Target-distribution importance resampling: documents are drawn by how much their words resemble a target's.

Features are single words and pairs of consecutive words in hashed buckets. Newlines separate words, so they cut a text into
lines, and words and pairs inside a line depend on that line alone. For the corpus counts every distinct line is taken apart once
and its counts are multiplied by its occurrences; pairs across lines are added to the buckets where the text is read. To weigh
documents the distinct lines of a stretch of documents are weighed once, and a document adds up its lines and its cross-line pairs.

The CRC-32 of a pair follows from those of its words, so a stretch of text is hashed by table look-ups over whole arrays.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duologue.llm.common import cut

#: Lowers A-Z, keeps digits, a-z, bytes from 0x80 on and the newline, blanks the rest.
LINES = bytes(b + 32 if 65 <= b <= 90 else b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def zero_steps() -> np.ndarray:
    """steps[k][j][b]: the CRC register that holds b in its byte j, after 2**k zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    state = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    steps = [one[state & 0xFF] ^ state >> np.uint32(8)]
    for _ in range(31):
        steps.append(shifted(steps[-1], steps[-1]))
    return np.array(steps)


def shifted(step: np.ndarray, c: np.ndarray) -> np.ndarray:
    return step[0][c & 0xFF] ^ step[1][c >> 8 & 0xFF] ^ step[2][c >> 16 & 0xFF] ^ step[3][c >> 24]


class Words(dict):
    """Numbers of words, with the checksum of each, of a blank and each, and the bytes these take."""

    def __init__(self, buckets: int, most: int = 500_000):
        super().__init__()
        self.buckets, self.most, self.steps = buckets, most, zero_steps()
        self.heads: list[int] = []
        self.tails: list[int] = []
        self.sizes: list[int] = []
        self.arrays: tuple[np.ndarray, ...] = ()

    def __missing__(self, word: bytes) -> int:
        self.heads.append(zlib.crc32(word))
        self.tails.append(zlib.crc32(b" " + word))
        self.sizes.append(len(word) + 1)
        n = self[word] = len(self)
        return n

    def numbers(self, words: Iterator[bytes]) -> np.ndarray:
        """Word numbers, which hold until the next call."""
        if len(self) > self.most:
            self.clear()
            self.heads, self.tails, self.sizes = [], [], []
        out = np.fromiter(map(self.__getitem__, words), np.int64)
        self.arrays = np.array(self.heads, np.uint32), np.array(self.tails, np.uint32), np.array(self.sizes, np.int64)
        return out

    def single(self, word: np.ndarray) -> np.ndarray:
        return (self.arrays[0][word] % np.uint32(self.buckets)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        heads, tails, sizes = self.arrays
        c, size = heads[a], sizes[b]
        for bit in range(int(size.max()).bit_length() if len(size) else 0):
            c = np.where(size >> bit & 1, shifted(self.steps[bit], c), c)
        return ((c ^ tails[b]) % np.uint32(self.buckets)).astype(np.int64)


def within(ends: np.ndarray, total: int) -> np.ndarray:
    """Positions i of 0..total-2 where i and i + 1 lie in one stretch; stretches end at ``ends``."""
    same = np.ones(max(0, total - 1), bool)
    inner = ends[(ends > 0) & (ends < total)] - 1
    same[inner] = False
    return np.flatnonzero(same)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[np.r_[0, ends[:-1]]] if len(ends) else np.array([], np.int64)


def line_rows(texts: DataFrame, buckets: int, most: int = 16 << 20) -> DataFrame:
    """(line, bucket, n): lines with their occurrences, and buckets of pairs across lines (there, line is null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[bytes, int] = defaultdict(int)
        cross, held = np.zeros(buckets, np.int64), 0

        def emit() -> pa.RecordBatch:
            n = len(lines)
            out = pa.RecordBatch.from_arrays([pa.array(list(lines), pa.binary()), pa.nulls(n, pa.int32()), pa.array(list(lines.values()), pa.int64())],
                                             ["line", "bucket", "n"])
            lines.clear()
            return out

        for b in batches:
            for text in b.column(0):
                before = None
                for line in text.as_py().translate(LINES).split(b"\n"):
                    line = line.strip()
                    if not line:
                        continue
                    if line not in lines:
                        held += len(line) + 100
                    lines[line] += 1
                    if before is not None:
                        cross[zlib.crc32(before.rsplit(None, 1)[-1] + b" " + line.split(None, 1)[0]) % buckets] += 1
                    before = line
                if held > most:
                    yield emit()
                    held = 0
        yield emit()
        used = np.flatnonzero(cross)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(cross[used])], ["line", "bucket", "n"])

    return texts.mapInArrow(work, "line binary, bucket int, n long")


def bucket_counts(texts: DataFrame, buckets: int, words: int = 1 << 20) -> np.ndarray:
    """Features of all texts by bucket; the driver gets one row for each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(buckets), np.zeros(buckets, np.int64)

        def add(lines: list[list[bytes]], times: list[int]) -> None:
            w = known.numbers(chain.from_iterable(lines))
            size = np.array([len(x) for x in lines], np.int64)
            weight = np.repeat(np.array(times, np.int64), size)
            first = within(np.cumsum(size), len(w))
            at = np.r_[known.single(w), known.pair(w[first], w[first + 1])]
            total[:] += np.bincount(at, np.r_[weight, weight[first]], buckets).astype(np.int64)

        for b in batches:
            lines: list[list[bytes]] = []
            times: list[int] = []
            held = 0
            for line, bucket, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket is not None:
                    total[bucket] += n
                    continue
                lines.append(line.as_py().split())
                times.append(n)
                held += len(lines[-1])
                if held > words:
                    add(lines, times)
                    lines, times, held = [], [], 0
            add(lines, times)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    distinct = line_rows(texts, buckets).groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    rows = distinct.mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share of a bucket over the corpus's)."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, words: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(len(gain))

        def weigh(ids: list[int | None], docs: list[list[int]], lines: list[list[bytes]]) -> pa.RecordBatch:
            w = known.numbers(chain.from_iterable(lines))
            size = np.array([len(x) for x in lines], np.int64)
            ends = np.cumsum(size)
            first = within(ends, len(w))
            inner = np.zeros(len(w), np.int64)
            inner[first] = gain[known.pair(w[first], w[first + 1])]
            value = sums(gain[known.single(w)] + inner, ends)
            at, of_doc = np.fromiter(chain.from_iterable(docs), np.int64), np.array([len(x) for x in docs], np.int64)
            stop = np.cumsum(of_doc)
            step = within(stop, len(at))
            cross = np.zeros(len(at), np.int64)
            cross[step] = gain[known.pair(w[ends[at[step]] - 1], w[ends[at[step + 1]] - size[at[step + 1]]])]
            n = sums(size[at], stop)
            features = np.maximum(2 * n - 1, 0)
            weight = np.where(features > 0, sums(value[at] + cross, stop) // np.maximum(features, 1), 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(features), pa.array(weight)],
                                              ["doc_id", "n_words", "n_features", "weight"])

        for b in batches:
            ids: list[int | None] = []
            texts: list[list[int]] = []
            lines: list[list[bytes]] = []
            seen: dict[bytes, int] = {}
            held = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = []
                for line in text.as_py().translate(LINES).split(b"\n"):
                    at = seen.get(line)
                    if at is None:
                        parts = line.split()
                        at = seen[line] = len(lines) if parts else -1
                        if parts:
                            lines.append(parts)
                            held += len(parts)
                    if at >= 0:
                        own.append(at)
                ids.append(i)
                texts.append(own)
                if held > words:
                    yield weigh(ids, texts, lines)
                    ids, texts, lines, seen, held = [], [], [], {}, 0
            yield weigh(ids, texts, lines)

    return docs.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) for every row of docs.

    Of the N documents with ``least_words`` words or more the floor(percent * N / 100) with the highest scores are drawn, ties to the smaller
    doc_id. The score is the weight plus Gumbel noise that depends on seed and doc_id alone, which makes this a draw without replacement
    in proportion to exp(weight / 1000). Null text is empty; a null id is hashed as an empty string and sorts last; repeated rows are
    documents of their own; an empty target or corpus counts as zero features. Other columns are not read.
    """
    texts = lambda df: df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    gain = gains(bucket_counts(texts(docs), buckets), bucket_counts(texts(target), buckets))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(weights(plain, gain).withColumn("score", (F.col("weight") + noise).cast("long")))
    able = F.col("n_words") >= least_words
    # A score is a floored thousandth of a logarithm of counts plus at most 23,000: some 100,000 different values at any size.
    steps = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("rows"))
    down = Window.orderBy(F.desc("score"))
    steps = cut(steps.select("score", (F.sum("rows").over(down) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("all")))
    steps = steps.withColumn("drawn", F.expr(f"`all` * {percent} div 100")).where("before < drawn").drop("all")
    ranked = scored.where(able).join(F.broadcast(steps), "score").withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = scored.where(~able).unionByName(scored.where(able).join(F.broadcast(steps.select("score")), "score", "left_anti"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(cols).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(cols))


def resample_sql(percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
a AS (SELECT 0 AS side, row_number() OVER () AS i, doc_id, {words} AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, {words} FROM benchmark),
f AS (SELECT side, i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM a),
n AS (SELECT side, i, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT f FROM n),
x AS (SELECT f, list_transform(range(1, octet_length(encode(f)) + 1), lambda k: CAST('0x' || substr(hex(encode(f)), 2 * k - 1, 2) AS BIGINT)) AS b FROM u),
c AS (SELECT f, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(c >> 8, t[xor(c % 256, y) + 1])), 4294967295) % {buckets} AS bucket FROM x, tab),
k AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t
  FROM n JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {buckets}) / ((s + 1) * (sum(t) OVER () + {buckets})))) AS BIGINT) AS gain FROM k),
v AS (SELECT i, sum(n) AS m, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM n JOIN c USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY i),
s AS (SELECT doc_id, len(w) AS words, CAST(coalesce(m, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM a LEFT JOIN v USING (i) WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= {least_words} ORDER BY score DESC, doc_id, n_features, weight) AS r,
  count(*) FILTER (words >= {least_words}) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {least_words} AND r <= {percent} * n // 100 THEN r END AS rank FROM r"""
