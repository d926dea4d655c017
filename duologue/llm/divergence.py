"""Source divergence audit: how far the word frequencies of each source lie from other sources and from its language.

A task reads the UTF-8 bytes of a text: one ``bytes.translate`` lowers A-Z and blanks every other ASCII character, ``bytes.split``
gives the terms, and a ``Counter`` for each document gives its frequencies and, by its keys, the document counts. Counts are
added up by (language, source) in the task before anything is shuffled, and stay sparse: a term that a source never uses
has no row. What such terms add to a divergence follows from the number of terms with each frequency, so that a pair of
sources only meets on terms that both use, and there as sums in numpy, never as joined rows.

All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duologue.llm.common import cut

#: Lowers A-Z, keeps a-z and all bytes from 0x80 on, blanks the rest.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DF = 40  # a tally holds the term frequency below this bit and the document count from it on


def tallies(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(lang, source, term, tf, df) of each task's documents; a term may come out of several tasks, or twice of one."""

    def emit(groups: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in groups.items():
            both, n = np.fromiter(terms.values(), np.int64, len(terms)), len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary()),
                 pa.array(both & ((1 << DF) - 1)), pa.array(both >> DF)], ["lang", "source", "term", "tf", "df"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                terms = groups[lang, source]
                had, get = len(terms), terms.get
                for term, n in Counter(text.as_py().translate(TERMS).split()).items():
                    terms[term] = get(term, 0) + n + (1 << DF)
                size += len(terms) - had
                if size > most:
                    yield from emit(groups)
                    groups.clear()
                    size = 0
        yield from emit(groups)

    return docs.mapInArrow(work, "lang string, source string, term binary, tf long, df long")


def share(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)); where the language keeps no term, the divisor is 1."""
    up = F.lit(scale).cast("decimal(18,0)") * (count + 1).cast("decimal(20,0)")
    return (1 + F.call_function("div", up, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))).cast("long")


def surplus(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def common_terms(valued: DataFrame, at_once: int) -> DataFrame:
    """(lang, source, item, value): for sources with common terms, what these add beyond the two sources' own sums."""
    lists = valued.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("users")).where(F.size("users") > 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = defaultdict(int)

        def emit() -> pa.RecordBatch:
            keys = list(zip(*sums, strict=True)) or [(), (), ()]
            out = pa.RecordBatch.from_arrays([pa.array(list(k), pa.string()) for k in keys] + [pa.array(list(sums.values()), pa.int64())],
                                             ["lang", "source", "item", "value"])
            sums.clear()
            return out

        for b in batches:
            users = b.column(1)
            ends = users.offsets.to_numpy().astype(np.int64)
            size, flat = np.diff(ends), users.flatten()
            name = flat.field(0).dictionary_encode()
            names, code = name.dictionary.to_pylist(), name.indices.to_numpy().astype(np.int64)
            p, z = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            lang = b.column(0).dictionary_encode()
            langs, of_lang = lang.dictionary.to_pylist(), np.repeat(lang.indices.to_numpy().astype(np.int64), size)
            start, many = np.repeat(ends[:-1] - ends[0], size), np.repeat(size, size)  # of each row's term
            done = np.cumsum(many)
            lo = 0
            while lo < len(many):  # rows lo..hi against all users of their terms
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + at_once, "right")))
                k = many[lo:hi]
                i = np.repeat(np.arange(lo, hi), k)
                j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[lo:hi], k)
                other = i != j
                i, j = i[other], j[other]
                value = surplus(p[i], p[j]) - surplus(p[i], z[j]) - surplus(z[i], p[j]) + surplus(z[i], z[j])
                key = (of_lang[i] * len(names) + code[i]) * len(names) + code[j]
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
                for at, v in zip(key[first].tolist(), np.add.reduceat(value, first).tolist() if len(key) else []):
                    sums[langs[at // len(names) ** 2], names[at // len(names) % len(names)], names[at % len(names)]] += v
                if len(sums) > 300_000:
                    yield emit()
                lo = hi
        yield emit()

    return lists.select("lang", "users").mapInArrow(work, "lang string, source string, item string, value long")


def own_terms(groups: DataFrame, valued: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language, the sums over all kept terms as if no term were common.

    A source needs only how many of its terms have each p, so it meets the others as (source, z) in blocks.
    """
    steps = valued.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    steps = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("steps"))
    at = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / block)
    others = groups.withColumn("block", at).groupBy("lang", "block").agg(F.collect_list(F.struct("source", "z", "own")).alias("others"))
    rows = groups.join(steps, ["lang", "source"], "left").join(others, "lang").select("lang", "source", "z", "own", "terms", "steps", "others")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = [(s["p"], s["n"]) for s in r["steps"] or []]
                p, n = np.array([x for x, _ in own], np.int64), np.array([x for _, x in own], np.int64)
                names = [o["source"] for o in r["others"]]
                z, used = np.array([o["z"] for o in r["others"]], np.int64), np.array([o["own"] for o in r["others"]], np.int64)
                here = np.array([(surplus(p, x) * n).sum() for x in z], np.int64) + (r["terms"] - r["own"] - used) * surplus(np.full(len(z), r["z"]), z)
                there = np.array([(surplus(np.full(len(p), x), p) * n).sum() for x in z], np.int64)
                for source, item, value in (([r["source"]] * len(names), names, here), (names, [r["source"]] * len(names), there)):
                    pair = np.array([x != r["source"] for x in names], bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["lang"]] * len(names), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value)],
                        ["lang", "source", "item", "value"]).filter(pa.array(pair))

    return rows.mapInArrow(work, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = 3, scale: int = 10**9, top: int = 200, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", block: int = 1024, at_once: int = 1 << 20) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) group its divergence from each other source of the language
    (part ``pair``, all of them) and the ``top`` terms it uses more than the language (part ``term``).

    Terms are runs of letters and non-ASCII characters, A-Z lowered; a language keeps terms of at least ``least_docs`` documents.
    With p = 1 + floor(scale * (count + 1) / (N + V)) the divergence is the sum of floor((p - q)^2 / q). Null text, lang and source
    are ''. Groups without terms take part with count 0. Repeated rows are documents of their own; an empty table gives no rows; other
    columns, whatever their names, are not read. Texts of any length are read whole, one at a time. A source meets ``block`` others at a time, and
    ``at_once`` pairs of users of terms.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    by_term = Window.partitionBy("lang", "term")
    # Dealt by (lang, term) once: the sums by source and the sums over sources both follow without another shuffle.
    sums = tallies(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    kept = cut(sums.withColumns({"docs": F.sum("df").over(by_term), "whole": F.sum("tf").over(by_term), "first": F.min("source").over(by_term) == F.col("source")})
               .where(F.col("docs") >= least_docs).drop("docs", "df"))
    own = kept.groupBy("lang", "source").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("lang_total"))
    groups = cut(docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
                 .na.fill(0, ["total", "own", "terms", "lang_total"])
                 .withColumn("z", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), scale)))
    valued = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "z", share(F.col("tf"), F.col("total"), F.col("terms"), scale).alias("p"),
        share(F.col("whole"), F.col("lang_total"), F.col("terms"), scale).alias("q"))

    pairs = own_terms(groups, valued, block).unionByName(common_terms(valued, at_once)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    up = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(up).alias("rank"))
    gap = F.col("p") - F.col("q")
    terms = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         F.call_function("div", gap * gap, F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= top)  # tasks keep `top` rows a group before the shuffle
    return pairs.unionByName(terms.withColumn("item", F.col("item").cast("string")))


def audit_sql(least_docs: int = 3, scale: int = 10**9, top: int = 200) -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{up}', '{low}') AS t FROM documents),
o AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM o GROUP BY ALL HAVING count(DISTINCT i) >= {least_docs}),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(max(n.n), 0) AS n, coalesce(max(v.v), 0) AS v, coalesce(max(v.n), 0) AS all_n FROM d LEFT JOIN v USING (lang)
    LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) n USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + {scale}::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS HUGEINT) AS p,
    CAST(1 + {scale}::HUGEINT * (k.whole + 1) // (g.all_n + g.v) AS HUGEINT) AS q
    FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {top}"""
