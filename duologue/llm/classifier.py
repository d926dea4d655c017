"""Quality classifier by co-training: a view of the words and a view of the page's metadata and layout teach each other.

Both views are logistic models of "reject" (low quality or toxic). They are fitted on a bounded sample of labelled
rows. In every round each view labels the documents of a bounded unlabelled pool that it is sure about, and the other view
learns from them. At the end each view is calibrated on labelled rows held back from its training, and a small logistic
model over the two calibrated log-odds scores every document.

Spark extracts the features, draws the samples and scores all rows; the driver sees the features of the two bounded
samples only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import fsum
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
HIGH = bytes(range(128, 256))
BITS = 20
SLOTS = 8  # of each category column
LAYOUT = 12


def word_features(word: bytes) -> list[int]:
    """The word, its start and its end as hashed features."""
    return [xxhash.xxh32_intdigest(word) >> (32 - BITS), xxhash.xxh32_intdigest(word[:5], 1) >> (32 - BITS),
            xxhash.xxh32_intdigest(word[-3:], 2) >> (32 - BITS)]


class WordFeatures(dict):
    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        f = self[word] = word_features(word)
        return f


def layout(raw: bytes, words: list[bytes], distinct: int, source: str | None, lang: str | None) -> list[float]:
    """The metadata view of one document."""
    n, w = max(1, len(raw)), max(1, len(words))
    lines = raw.split(b"\n")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    out = [np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), share(UPPER), share(PUNCT), share(DIGITS),
           share(HIGH), distinct / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines), min(50, n / w),
           distinct / w * np.log1p(len(words))]
    slots = [0.0] * (2 * SLOTS)
    for k, v in enumerate((source, lang)):
        slots[k * SLOTS + xxhash.xxh32_intdigest(v or "") % SLOTS] = 1.0
    return out + slots


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def dense_logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each row in its own fixed order, so that equal rows get equal bits wherever they stand."""
    return (np.ascontiguousarray(x) * w[:-1]).sum(1) + w[-1]


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic model, the intercept last (Newton's method)."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Docs:
    """Features of sampled documents: word features as one flat list with bounds, layout as a matrix."""

    words: np.ndarray
    bounds: np.ndarray
    layout: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.layout), dtype=np.int32), np.diff(self.bounds))


@dataclass
class Model:
    """What the scoring tasks get: at most ``max_features`` word weights and a few dense ones."""

    slots: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(LAYOUT + 2 * SLOTS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(LAYOUT + 2 * SLOTS))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(LAYOUT + 2 * SLOTS + 1))
    platt: np.ndarray = field(default_factory=lambda: np.array([[1.0, 0.0], [1.0, 0.0]]))
    combine: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0]))

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.platt[0, 0] * content + self.platt[0, 1]
        b = self.platt[1, 0] * meta + self.platt[1, 1]
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def fit_content(docs: Docs, use: np.ndarray, y: np.ndarray, max_features: int, least_z: float = 4.4) -> tuple[dict[int, float], float]:
    """Word view: the features that speak most for rejection, then a ridge logistic model over them.

    Features that speak for keeping are left out, so the view says the same of a short and a long clean text. ``use`` names rows (a row may come with the other view's label), ``y`` their labels.
    """
    label = np.full(len(docs.layout), np.nan)
    label[use] = y
    row = docs.rows()
    known = ~np.isnan(label[row])
    f, lab = docs.words[known], label[row[known]]
    n1 = np.bincount(f, lab, 1 << BITS)
    n = np.bincount(f, minlength=1 << BITS).astype(float)
    prior = y.mean()
    z = (n1 - n * prior) / np.sqrt(n * prior * (1 - prior) + 1e-9)
    z[n < 4] = 0
    best = np.argsort(-z, kind="stable")[:max_features]
    best = best[z[best] >= least_z]
    if not len(best):
        return {}, float(logit(np.array([y.mean()]))[0])
    place = np.full(1 << BITS, -1)
    place[best] = np.arange(len(best))
    on = place[docs.words]
    hit = (on >= 0) & known
    r, c = row[hit], on[hit]
    w, b = np.zeros(len(best)), float(logit(np.array([y.mean()]))[0])
    target = np.nan_to_num(label)
    sel = ~np.isnan(label)
    size = np.maximum(1, np.bincount(r, minlength=len(label)))  # features of one document share its curvature
    curve = np.bincount(c, 0.25 * size[r], len(best)) + 1.0
    for _ in range(300):
        err = (sigmoid(np.bincount(r, w[c], len(label)) + b) - target) * sel
        w -= (np.bincount(c, err[r], len(best)) + w * 0.05) / curve
        b -= err.sum() / (0.25 * sel.sum())
    return dict(zip(best.tolist(), w.tolist(), strict=True)), b


def content_logit(docs: Docs, slots: dict[int, float], bias: float) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[list(slots)] = list(slots.values())
    return np.bincount(docs.rows(), table[docs.words], len(docs.layout)) + bias


def cotrain(docs: Docs, label: np.ndarray, rounds: int = 3, sure: float = 0.98, max_features: int = 4096) -> Model:
    """``label``: 1 reject, 0 keep, nan for the pool. Every fourth labelled row calibrates and is never trained on."""
    known = np.flatnonzero(~np.isnan(label))
    model = Model()
    if len(docs.layout):
        model.mean, model.scale = docs.layout.mean(0), docs.layout.std(0) + 1e-6
    held, train = known[::4], np.setdiff1d(known, known[::4])
    if len(train) < 8 or len(np.unique(label[train])) < 2 or len(np.unique(label[held])) < 2:
        model.combine = np.array([0.0, 0.0, -40.0 if not len(known) or label[known].mean() < 0.5 else 40.0])
        return model
    x, pool = (docs.layout - model.mean) / model.scale, np.flatnonzero(np.isnan(label))
    given = [(np.array([], int), np.array([])), (np.array([], int), np.array([]))]
    for k in range(rounds + 1):
        (ia, ya), (ib, yb) = given
        model.slots, model.bias = fit_content(docs, np.r_[train, ia], np.r_[label[train], ya], max_features)
        model.dense = fit_dense(x[np.r_[train, ib]], np.r_[label[train], yb])
        views = [content_logit(docs, model.slots, model.bias), dense_logit(x, model.dense)]
        model.platt = np.array([fit_dense(np.clip(v[held], -30, 30)[:, None], label[held], 0.1) for v in views])
        if k < rounds:  # what one view is sure about teaches the other
            told = []
            for v, (slope, base) in zip(views, model.platt, strict=True):
                p = sigmoid(slope * v[pool] + base)
                at = (p >= sure) | (p <= 1 - sure)
                told.append((pool[at], (p[at] >= sure).astype(float)))
            given = [told[1], told[0]]
    z = np.c_[[s * np.clip(v[held], -30, 30) + b for v, (s, b) in zip(views, model.platt, strict=True)]].T
    model.combine = fit_dense(z, label[held], 0.1)
    return model


def telling(words: pa.ChunkedArray, reject: np.ndarray) -> list[np.ndarray]:
    """Each document's word features without those that cannot become evidence: met in fewer than four documents, or
    met in twenty labelled ones and there less often rejected than features are on the whole."""
    n, n1, nl = (np.zeros(1 << BITS, np.int32) for _ in range(3))
    for x, r in zip(words, reject, strict=True):
        f = np.frombuffer(x.as_buffer(), np.int32)
        for counts, counted in ((n, True), (n1, r == 1), (nl, r == r)):
            if counted:
                np.add.at(counts, f, 1)
    use = (n >= 4) & ~((nl >= 20) & (n1 * float(nl.sum()) < nl * float(n1.sum())))
    return [f[use[f]] for x in words for f in [np.frombuffer(x.as_buffer(), np.int32)]]


def sampled(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> tuple[Docs, np.ndarray]:
    """The two bounded samples, by the hash of the id, with their features."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(
        "doc_id is not null and (quality is not null or toxic is not null)")
    lab = lab.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
                                          .cast("double")).alias("reject"))
    key = [F.xxhash64("doc_id"), "doc_id"]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = lab.join(ids, "doc_id", "left_semi").orderBy(*key).limit(labelled)
    free = ids.join(lab, "doc_id", "left_anti").orderBy(*key).limit(pool).withColumn("reject", F.lit(None).cast("double"))
    want = known.unionByName(free)  # at most labelled + pool rows
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang").join(
        F.broadcast(want), "doc_id").groupBy("doc_id").agg(
        F.first("reject").alias("reject"), F.min(F.struct("text", "source", "lang")).alias("d")).select("doc_id", "reject", "d.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        for b in batches:
            d = b.to_pydict()
            f, m = [], []
            for text, source, lang in zip(d["text"], d["source"], d["lang"], strict=True):
                raw = (text or "").encode()
                words = raw.lower().split()
                once = set(words)
                f.append(np.array([x for w in once for x in cache[w]], np.int32).tobytes())
                m.append(layout(raw, words, len(once), source, lang))
            yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"], pa.int64()), pa.array(d["reject"], pa.float64()),
                                              pa.array(f, pa.binary()), pa.array(m, pa.list_(pa.float64()))],
                                             ["doc_id", "reject", "words", "layout"])

    got = picked.mapInArrow(features, "doc_id long, reject double, words binary, layout array<double>").toArrow()
    by = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    reject = got["reject"].to_numpy().astype(float)
    parts = telling(got["words"], reject)  # the large column is neither copied nor kept
    lay = np.array(got["layout"].to_pylist(), float).reshape(len(parts), LAYOUT + 2 * SLOTS)[by]
    del got
    pa.default_memory_pool().release_unused()
    parts, reject = [parts[i] for i in by], reject[by]
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    return Docs(np.concatenate(parts) if parts else np.array([], np.int32), bounds, lay), reject


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with content_reject, metadata_reject, reject (probabilities) and keep, for every row."""
    cols = ["doc_id", "text", "source", "lang"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Weight(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) > 400_000:
                    self.clear()
                w = self[word] = sum(model.slots.get(x, 0.0) for x in word_features(word))
                return w

        weight = Weight()
        for b in batches:
            a, m = [], []
            source, lang = b.column("source").to_pylist(), b.column("lang").to_pylist()
            for k, text in enumerate(b.column("text")):
                raw = (text.as_py() or "").encode()
                words = raw.lower().split()
                once = set(words)
                a.append(fsum(map(weight.__getitem__, once)) + model.bias)  # the same in any order
                m.append(layout(raw, words, len(once), source[k], lang[k]))
            if not a:
                continue
            x = (np.array(m) - model.mean) / model.scale
            got = model.score(np.clip(np.array(a), -30, 30), np.clip(dense_logit(x, model.dense), -30, 30))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(v) for v in got), pa.array(got[2] < 0.5)],
                [*b.schema.names, "content_reject", "metadata_reject", "reject", "keep"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    assert set(cols) <= set(base.columns)
    return base.mapInArrow(work, f"{kinds}, content_reject double, metadata_reject double, reject double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, labelled: int = 16_000, pool: int = 4_000, rounds: int = 3) -> DataFrame:
    """Scores every row of docs(doc_id, text, source, lang, ...): the same columns plus the three scores and ``keep``.

    At most ``labelled`` labelled rows and ``pool`` unlabelled ones are used for fitting; all rows are scored. Null text is
    empty, a null source or language is a value of its own, rows with a null id are scored too, repeated rows get equal
    scores. Without labels of both kinds every row gets the verdict of the majority (keep, where there is no label).
    """
    for c in ("content_reject", "metadata_reject", "reject", "keep"):
        docs = docs.drop(c)
    sample, label = sampled(docs, labels, labelled, pool)
    return score(docs, cotrain(sample, label, rounds))
