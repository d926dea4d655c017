"""Retrieval, contamination and spread operators on embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.functions.vectors import cosine
from duologue.operators.joins import one_perspective
from duologue.operators.nearest import Rule, above, best_match, closest_pairs, counted, duplicates, top_k, vectors


def neighbours_other_lineage(rows: DataFrame, k: int, id_col: str, vec: str, root: Column, source: Column, side: Column) -> DataFrame:
    """D12 with D11: the anchor as rank 0 and the k - 1 nearest rows of other lineages, one for each source.

    From the rows of a source outside the anchor's lineage the last one on the anchor's side stands for it, else the first. Of the anchor's own
    source only the anchor takes part. Where fewer than k rows are outside the lineage (the anchor counted), the anchor is alone.

    A source within one lineage has one candidate for each side. A source with rows of several lineages has further ones, each for
    the anchors of one of its lineages only, chosen without that lineage's rows.
    """
    v = vectors(rows, id_col, vec, group=root)
    about = rows.select(F.col(id_col).cast("bigint").alias("id"), root.cast("bigint").alias("root"), source.cast("bigint").alias("src"), side.cast("int").alias("side"))
    v = v.join(about.select("id", "src", "side"), "id")
    about = about.join(v.select("id"), "id", "left_semi")
    per_root = about.groupBy("src", "root").agg(F.min("id").alias("first"), *[F.max(F.when(F.col("side") == s, F.col("id"))).alias(f"last{s}") for s in (0, 1)])
    by_source = per_root.groupBy("src").agg(F.collect_list(F.struct("root", "first", "last0", "last1")).alias("own"))
    nothing = F.lit(None).cast("bigint")
    found = None
    for s in (0, 1):
        def chosen(own: Column, s: int = s) -> Column:
            return F.coalesce(F.array_max(F.transform(own, lambda x: x[f"last{s}"])), F.array_min(F.transform(own, lambda x: x["first"])))

        whole = by_source.select("src", chosen(F.col("own")).alias("id"), F.transform("own", lambda x: x["root"]).alias("bar"), nothing.alias("only"))
        each = by_source.where(F.size("own") > 1).select("src", "own", F.explode(F.transform("own", lambda x: x["root"])).alias("only"))
        parts = each.select("src", chosen(F.filter("own", lambda x: x["root"] != F.col("only"))).alias("id"), F.lit(None).cast("array<bigint>").alias("bar"), "only")
        corpus = whole.unionByName(parts).join(v.select("id", "vec", "grp", "ord"), "id")
        one = top_k(v.where(F.col("side") == s), corpus, k - 1, Rule(pool=True))
        found = one if found is None else found.unionByName(one)
    inside = v.groupBy("grp").agg(F.count(F.lit(1)).alias("inside"))
    size = v.agg(F.count(F.lit(1)).alias("n"))  # one row
    enough = v.select("id", "grp").join(inside, "grp").crossJoin(F.broadcast(size)).where(F.col("n") - F.col("inside") + 1 >= k).select("id")
    own = v.select("id", F.lit(0).alias("rank"), F.col("id").alias("nid"), F.lit(1.0).alias("sim"))
    return found.select("id", "rank", "nid", "sim").join(enough, "id", "left_semi").unionByName(own)


def retrieve_one_perspective(queries: DataFrame, rows: DataFrame, k: int, prefer: int) -> DataFrame:
    """D10 + D11: candidates are cut to one row for each source before the search."""
    one = one_perspective(rows, "source_id", "id", F.col("perspective") == prefer, ["id", "embedding"])
    return top_k(vectors(queries, "id", "embedding"), vectors(one, "id", "embedding"), k)


def contamination_summary(n_exact: DataFrame, semantic: DataFrame, limit: float) -> DataFrame:
    """D14 flag: exact id overlaps or any pair above the limit."""
    e = n_exact.agg(F.count(F.lit(1)).alias("n_exact"))
    s = semantic.agg(F.coalesce(F.sum(F.col("copies") * F.col("n_copies")), F.lit(0)).alias("n_semantic"))
    return e.crossJoin(F.broadcast(s)).select("*", F.lit(limit).alias("threshold"),
                                              ((F.col("n_exact") > 0) | (F.col("n_semantic") > 0)).alias("contaminated"))


def batch_duplicates(batch: DataFrame) -> DataFrame:
    """Highest cosine of each row to the earlier rows of its batch (0 for the first)."""
    found = best_match(batch, batch, Rule(earlier=True, other_group=False))
    return batch.select("id").join(found.select("id", "sim"), "id", "left").select(
        "id", F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)).alias("within_batch_dupe"))


def nearest_distance(a: DataFrame, b: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Cosine distance to the closest row of b."""
    return best_match(a, b, Rule(not_self=exclude_self)).select("id", (1 - F.col("sim")).alias("distance"))


def target_side(rows: DataFrame, anchor: str, side0: str, side1: str, generated: Column) -> DataFrame:
    """The side whose goal is closest to the anchor goal, first wins ties; generated rows keep side 0."""
    s0, s1 = cosine(F.col(anchor), F.col(side0)), cosine(F.col(anchor), F.col(side1))
    return rows.withColumn("target", F.when(generated | (s0 >= s1), 0).otherwise(1))


def mean_pairwise_distance(rows: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Mean cosine distance inside a group in closed form, linear in the rows.

    The sum of all pair products is (|sum u|^2 - sum |u|^2) / 2 for unit vectors u. Coordinates are
    summed on the map side; groups with fewer than two rows give no value.
    """
    from duologue.functions.vectors import unit

    parts = rows.select(*by, F.posexplode(unit(F.col(vec))).alias("dim", "x")).groupBy(*by, "dim").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    g = parts.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("a"), F.sum("ss").alias("b"), F.max("n").alias("n"))
    n = F.col("n")
    return g.select(*by, "n", F.when(n >= 2, 1 - (F.col("a") - F.col("b")) / (n * (n - 1))).alias("mean_distance"))


def repeated_sources(trials: DataFrame, trial: str, source: str) -> DataFrame:
    """Retrieval windows holding two rows of one source; an empty result is a pass."""
    return trials.groupBy(trial, source).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


__all__ = ["Rule", "above", "batch_duplicates", "best_match", "closest_pairs", "contamination_summary", "counted", "duplicates",
           "mean_pairwise_distance", "nearest_distance", "neighbours_other_lineage", "repeated_sources",
           "retrieve_one_perspective", "target_side", "top_k", "vectors"]
