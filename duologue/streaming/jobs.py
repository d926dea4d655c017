"""Streaming twins of the running summaries, over a folder that runs keep writing to.

Every sink writes a folder for each micro-batch and replaces it on replay, so a restarted query never
counts a batch twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from duologue.operators.nearest import Rule, best_match, vectors
from duologue.operators.summaries import child_votes, n_rows
from duologue.session import cut, exists, fresh_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; a single file is picked out of its folder by name."""
    r = spark.readStream.schema(schema).format("parquet")
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):
        r, path = r.option("pathGlobFilter", name), folder
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def drain(stream: DataFrame, mode: str, out: str, checkpoint: str,
          work: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Run all available input through; batch n lands in ``out/batch=n``."""

    def save(df: DataFrame, batch: int) -> None:
        res = df if work is None else work(df, batch)
        res.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(
        availableNow=True).start()
    q.awaitTermination()


def run_to_table(stream: DataFrame, mode: str, work=None, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain into a folder and read it back. A job that is given its two paths again goes on where it stopped."""
    spark = stream.sparkSession
    out = out or fresh_path(spark, "stream")
    drain(stream, mode, out, checkpoint or fresh_path(spark, "checkpoint"), work)
    return spark.read.parquet(out)


def tumbling(stream: DataFrame, time: str, size: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of each key and window of event time; append mode gives a window once it is older than ``late``."""
    w = F.window(time, size)
    return _flat_window(stream.withWatermark(time, late).groupBy(*keys, w).agg(*aggregates), "window")


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of each key's sessions: rows of a key that follow each other within ``gap``."""
    s = F.session_window(time, gap)
    return _flat_window(stream.withWatermark(time, late).groupBy(*keys, s).agg(*aggregates), "session_window")


def _flat_window(df: DataFrame, window: str) -> DataFrame:
    rest = [c for c in df.columns if c != window]
    return df.select(F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("stop"), *rest)


def without_repeats(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """First row of each key; a key is remembered for ``late`` of event time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def fed(parts: Iterable[DataFrame], job: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Feeds a folder part by part and lets ``job(stream, out, checkpoint)`` go on after each: every part is a micro-batch of its own,
    read and written in parallel. Returns what the last run gave."""
    spark, result = None, None
    for part in parts:
        if spark is None:
            spark = part.sparkSession
            source, out, checkpoint = (fresh_path(spark, x) for x in ("fed", "stream", "checkpoint"))
        part.write.mode("append").parquet(source)
        result = job(file_stream(spark, source, part.schema), out, checkpoint)
    return result


def last_batch(table: DataFrame) -> DataFrame:
    """Newest complete-mode result."""
    last = table.agg(F.max("batch").alias("b"))  # one row
    return table.join(F.broadcast(last), F.col("batch") == F.col("b")).drop("batch", "b")


def last_value(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest update-mode row of each key."""
    vals = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch").alias("v")).select(*keys, "v.*")


def latest_versions(stream: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version of each live record; the batch keeps one row a key before anything is written."""
    vals = [c for c in stream.columns if c != key]

    def newest(df: DataFrame, _: int) -> DataFrame:
        return df.groupBy(key).agg(F.max_by(F.struct(*vals), version).alias("v")).select(key, "v.*")

    t = run_to_table(stream, "append", newest).drop("batch")
    return t.groupBy(key).agg(F.max_by(F.struct(*vals), version).alias("v")).select(key, "v.*")


def completed_only(latest: DataFrame, status: str = "status") -> DataFrame:
    """Readers ignore records in progress."""
    return latest.where(~F.col(status).eqNullSafe("in_progress"))


def rolling_summary(stream: DataFrame, by: str, passed: Column, error: Column) -> DataFrame:
    """Totals by source after every finished episode (complete mode)."""
    return stream.groupBy(by).agg(n_rows().alias("total"), n_rows(error).alias("errors"),
                                  n_rows(~error & passed).alias("passed"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlopeState(StatefulProcessor):
    """The last ``width`` (order, value) pairs of a key as typed list state. It has no time to live: that needs processing-time mode, in which a run
    over what is available does not end."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "o double, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = [(o, v) for o, v in self.window.get()]
        for c in rows:  # a chunk is one Arrow batch, never the whole group
            new = c.nlargest(self.width, "o")
            window = sorted(window + list(zip(new["o"].tolist(), new["v"].tolist())))[-self.width:]
        self.window.put(window)
        vals = [v for _, v in window]
        mid = len(vals) // 2
        slope = 0.0 if len(vals) < 4 else sum(vals[mid:]) / (len(vals) - mid) - sum(vals[:mid]) / mid
        yield pd.DataFrame({"key": [key[0]], "n": [len(vals)], "slope": [slope]})

    def close(self) -> None:
        pass


def bounded_slope(stream: DataFrame, key: str, order: str, value: str, width: int = 10) -> DataFrame:
    """S3: slope over the last ``width`` values of each key; the state holds those values only.

    State lies in the RocksDB store of the executors; ``stateful`` starts such a stream.
    """
    src = stream.select(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("_default")).alias("key"),
                        F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v"))
    return src.groupBy("key").transformWithStateInPandas(
        SlopeState(width), "key string, n int, slope double", "Update", "None")


def stateful(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Like run_to_table in update mode, with state kept in RocksDB for this run."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        return run_to_table(stream, "update", None, out, checkpoint)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def admit(stream: DataFrame, id_col: str, vec: str, limit: float, order: str, out: str | None = None, checkpoint: str | None = None,
          pivots: int = 64) -> DataFrame:
    """A row is admitted if nothing admitted in an earlier batch is too close.

    ``within_batch_dupe`` logs the closest earlier row of the same batch, it never rejects. Admitted rows are an index that grows by a
    folder for each batch and cell: the cell is the nearest of some pivots, which the first rows gave, and a batch reads only the cells that can hold
    something closer than ``limit``. With the two paths of an earlier run the job goes on where that stopped.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, "admitted")
    wide = math.acos(max(-1.0, min(1.0, limit))) + 1e-7

    def gate(df: DataFrame, batch: int) -> None:
        v = cut(vectors(df, id_col, vec, order=F.col(order)))
        if batch == 0 or not exists(spark, f"{out}/pivots"):
            v.orderBy(F.xxhash64("id"), "id").limit(pivots).select("id", "vec").coalesce(1).write.mode("overwrite").parquet(f"{out}/pivots")
        chosen = spark.read.parquet(f"{out}/pivots").orderBy("id").toPandas()["vec"]  # at most ``pivots`` rows
        grid = np.vstack(chosen.to_numpy()) if len(chosen) else np.zeros((0, 1))

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each row's own cell, and the cells where something may be close to it."""
            for b in batches:
                if len(b) and len(grid):
                    angle = np.arccos(np.clip(np.vstack(b["vec"].to_numpy()) @ grid.T, -1.0, 1.0))
                    near = (angle - angle.min(axis=1)[:, None]) / 2.0 <= wide
                    yield pd.DataFrame({"id": b["id"].to_numpy(), "home": angle.argmin(axis=1), "cells": [np.flatnonzero(r) for r in near]})

        places = cut(v.mapInPandas(placed, "id bigint, home bigint, cells array<bigint>"))
        close = None
        index = f"{out}/index"
        if batch > 0 and exists(spark, index):
            asked = [r.cell for r in places.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most ``pivots``
            rows = spark.read.option("basePath", index).parquet(index).where((F.col("batch") < batch) & F.col("cell").isin(asked or [-1]))
            live = v.where(F.exists("vec", lambda x: x != 0))
            close = best_match(live, rows.select("id", "vec", "grp", "ord"), min_sim=limit).select("id", F.col("sim").alias("max_sim"))
        log = best_match(v, v, Rule(earlier=True)).select("id", F.col("sim").alias("__w"))
        res = v.join(log, "id", "left").withColumn("within_batch_dupe", F.greatest(F.coalesce("__w", F.lit(0.0)), F.lit(0.0))).drop("__w")
        res = res.join(close, "id", "left") if close is not None else res.withColumn("max_sim", F.lit(None).cast("double"))
        res = cut(res.withColumn("admitted", F.col("max_sim").isNull()))
        res.write.mode("overwrite").parquet(f"{out}/log/batch={batch}")
        kept = res.where("admitted").join(places.select("id", F.col("home").alias("cell")), "id")
        kept.select("id", "vec", "grp", "ord", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{index}/batch={batch}")

    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint or fresh_path(spark, "checkpoint")).foreachBatch(
        gate).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/log")


def posterior_stream(stream: DataFrame, anchor: str = "anchor", state: str = "terminal_state", improved: str = "improved",
                     total: str = "total") -> DataFrame:
    """Beta votes of each anchor from a stream of child outcomes."""
    alpha, beta = child_votes(F.col(state), F.coalesce(improved, F.lit(0)), F.coalesce(total, F.lit(0)))
    return stream.groupBy(anchor).agg(F.sum(alpha).alias("alpha_votes"), F.sum(beta).alias("beta_votes"),
                                      n_rows().alias("n_selected"))


def every_n_rows(stream: DataFrame, n: int, job: Callable[[int], None], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run ``job(total)`` whenever another ``n`` rows have arrived; returns (batch, total, fired).

    The count so far is read from the sink, so a restart with the two paths of an earlier run neither loses nor repeats a trigger.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, "ticks")

    def tick(df: DataFrame, batch: int) -> None:
        before = 0
        if batch > 0:
            before = spark.read.parquet(out).where(F.col("batch") < batch).agg(F.max("total")).head()[0] or 0
        total = before + df.count()
        fired = total // n > before // n
        if fired:
            job(total)
        spark.range(1).select(F.lit(total).cast("bigint").alias("total"), F.lit(fired).alias("fired")).write.mode(
            "overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint or fresh_path(spark, "checkpoint")).foreachBatch(
        tick).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
