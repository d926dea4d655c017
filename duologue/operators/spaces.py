"""Projections, cells, coverage and niches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.operators.joins import first_per_key
from duologue.operators.scale import running_sums, salted_join
from duologue.session import exists


def project(df: DataFrame, vec: str, keep: Sequence[str]) -> DataFrame:
    """K1: fit one PCA on all rows and project them to x, y (the shift by the mean does not matter here)."""
    v = df.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(v)
    p = vector_to_array(F.col("__p"))
    return model.transform(v).select(*keep, p[0].alias("x"), p[1].alias("y"))


def explained_variance(df: DataFrame, vec: str) -> DataFrame:
    v = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    ev = PCA(k=2, inputCol="__v", outputCol="__p").fit(v).explainedVariance
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(ev)], "component int, variance double")


def cells(df: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Grid cell of each point on the extent shared by all rows; a flat axis uses range 1."""
    lim = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row

    def cell(v, lo, hi):
        span = F.col(hi) - F.col(lo)
        share = (F.col(v) - F.col(lo)) / F.when(span == 0, F.lit(1.0)).otherwise(span)
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")

    return df.crossJoin(F.broadcast(lim)).withColumn("cx", cell("x", "x0", "x1")).withColumn(
        "cy", cell("y", "y0", "y1")).drop("x0", "x1", "y0", "y1")


def coverage(df: DataFrame, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Share of cells in use; fewer than two rows cover nothing."""
    c = cells(df, bins).groupBy(*by, "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows")).withColumn(
        "coverage", F.when(F.col("n_rows") < 2, F.lit(0.0)).otherwise(F.col("n_cells") / F.lit(float(bins * bins))))


def occupancy(df: DataFrame, bins: int, by: str, cap: int = 10) -> DataFrame:
    """Rows in each cell of each method on one shared extent, and the capped count for display."""
    return cells(df, bins).groupBy(by, "cx", "cy").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "shown", F.least(F.col("n"), F.lit(cap)))


def coverage_growth(df: DataFrame, order: str, bins: int) -> DataFrame:
    """F8: coverage after each iteration: a cell counts from the first row in it."""
    first = cells(df, bins).groupBy("cx", "cy").agg(F.min(order).alias(order))
    new = first.groupBy(order).agg(F.count(F.lit(1)).alias("new_cells"))
    steps = df.groupBy(order).agg(F.count(F.lit(1)).alias("n_rows")).join(new, order, "left")
    run = running_sums(steps, [], [F.col(order)], {"n_cells": F.coalesce("new_cells", F.lit(0)),
                                                    "archive_size": F.col("n_rows")}, F.col(order))
    return run.select(order, "archive_size", (F.col("n_cells") / F.lit(float(bins * bins))).alias("coverage"))


def niche_count(n: int) -> int:
    """K2: between 8 and 15 niches, one for every eight rows, never more than rows."""
    return min(n, max(8, min(15, n // 8)))


def niches(df: DataFrame, key: str, vec: str, seed: int = 42) -> DataFrame:
    """K2: k-means niches; fewer than two rows all fall in niche 0."""
    v = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    n = v.count()
    if n < 2:
        return v.select(key, F.lit(0).alias("niche"))
    return KMeans(k=niche_count(n), seed=seed, predictionCol="niche").fit(v).transform(v).select(key, "niche")


def assign_niche(vec: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """K2: nearest of the (at most 15) centroids, first wins ties; none yet gives 0."""
    if not centroids:
        return F.lit(0)
    options = [F.struct(F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in c]),
                                               lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"),
                        F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return F.array_min(F.array(*options))["i"]


def centroids_of(assigned: DataFrame, vec: str, niche: str = "niche") -> DataFrame:
    """K2: (niche, centroid): the mean vector of each niche; sums are made by niche and dimension before the shuffle."""
    parts = assigned.select(niche, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x")).groupBy(niche, "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy(niche).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("centroid"))


class NicheManager:
    """K2 over batches: rows go to the nearest stored centroid, and after ``refit_every`` assignments the centroids move.

    The state is a folder: ``log`` has what each batch was assigned, ``state`` the centroids and counters after each. A manager that is given the folder of an
    earlier one, and no ``first``, goes on where that stopped. Without a model every row is niche 0. A refit starts from the present centroids (at first from ``first``, or
    k-means of the rows so far) and takes ``steps`` steps of Lloyd's algorithm over all rows assigned so far; a niche that loses all its rows keeps its centroid.
    """

    def __init__(self, spark: SparkSession, folder: str, first: Sequence[Sequence[float]] | None = None, refit_every: int = 10, steps: int = 1):
        self.spark, self.folder, self.refit_every, self.steps = spark, folder, refit_every, steps
        self.batches, self.since, self.fits, self.centroids = 0, 0, 0, [list(map(float, c)) for c in first or ()]
        if first is None and exists(spark, f"{folder}/state"):
            last = spark.read.parquet(f"{folder}/state").orderBy(F.desc("batches")).head()
            self.batches, self.since, self.fits = last.batches, last.since, last.fits
            self.centroids = [list(c) for c in last.centroids]

    def rows(self) -> DataFrame:
        """(id, vec, niche, batch) of all rows assigned so far; a row keeps the niche it got."""
        return self.spark.read.parquet(f"{self.folder}/log")

    def assign(self, batch: DataFrame, key: str, vec: str) -> DataFrame:
        """Assigns a batch, refits if it is time, and returns (id, niche) of the batch."""
        got = batch.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
        path = f"{self.folder}/log/batch={self.batches}"
        got.withColumn("niche", assign_niche(F.col("vec"), self.centroids)).write.mode("overwrite").parquet(path)
        got = self.spark.read.parquet(path)
        self.batches += 1
        if self.centroids:
            self.since += got.count()
        if self.since >= self.refit_every or not self.centroids:
            self.refit()
        state = [(self.batches, self.since, self.fits, self.centroids)]
        self.spark.createDataFrame(state, "batches long, since long, fits long, centroids array<array<double>>").coalesce(1).write.mode("append").parquet(
            f"{self.folder}/state")
        return got.select("id", "niche")

    def refit(self) -> None:
        rows = self.rows().select("id", "vec")
        n = rows.count()
        if not self.centroids:
            if n < 2:
                return
            model = KMeans(k=niche_count(n), seed=42).fit(rows.select(array_to_vector("vec").alias("features")))
            self.centroids = [c.tolist() for c in model.clusterCenters()]  # at most 15
        for _ in range(self.steps):
            moved = centroids_of(rows.withColumn("niche", assign_niche(F.col("vec"), self.centroids)), "vec").collect()
            for r in moved:
                self.centroids[r.niche] = list(r.centroid)
        self.since, self.fits = 0, self.fits + 1


def pooled_texts(archives: dict[str, DataFrame], text: str) -> tuple[DataFrame, DataFrame]:
    """H1: pool archives, keep each text once (first row by key), map every row to its text's row."""
    pool = None
    for name, df in archives.items():
        one = df.withColumn("archive", F.lit(name))
        pool = one if pool is None else pool.unionByName(one, allowMissingColumns=True)
    unique = first_per_key(pool, [text], F.struct("archive", "id"), ["archive", "id"])
    ids = unique.select(text, F.col("archive").alias("unique_archive"), F.col("id").alias("unique_id"))
    return unique, salted_join(pool, ids, [text], "inner", ["archive", "id"])
