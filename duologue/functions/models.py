"""U4: call an outside model over rows, in batches, with retries; failures become rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_model(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[str]], batch: int = 100,
               tries: int = 5, first_delay: float = 2.0) -> DataFrame:
    """(key, answer, error). ``client`` takes a list of texts and answers in the same order."""

    def ask(texts: list[str]) -> tuple[list[str] | None, str | None]:
        delay, last = first_delay, ""
        for attempt in range(tries):
            try:
                got = client(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers for {len(texts)} texts")
                return list(got), None
            except Exception as e:  # noqa: BLE001
                last = f"{type(e).__name__}: {e}"
                if attempt + 1 < tries:
                    time.sleep(delay)
                    delay *= 2
        return None, last

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), batch):
                part = b.iloc[start:start + batch]
                got, err = ask(part["t"].tolist())
                n = len(part)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "answer": got or [None] * n, "error": [err] * n})

    src = df.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return src.mapInPandas(go, "k string, answer string, error string").withColumnRenamed("k", key)


def neutral_votes(votes: DataFrame) -> DataFrame:
    """A failed judge call is a neutral vote; other verdicts are normalised to A, B or no_difference."""
    v = F.lower(F.trim("answer"))
    return votes.withColumn("is_error", F.col("error").isNotNull()).withColumn(
        "verdict", F.when(F.col("error").isNull() & (v == "a"), "A").when(F.col("error").isNull() & (v == "b"), "B")
        .otherwise("no_difference"))


def needs_revote(votes: DataFrame, lp: DataFrame) -> DataFrame:
    """Failed votes of scenarios whose progress value is exactly 0: they are cast once more."""
    zero = lp.where((F.col("lp_value") == 0) & (F.col("n_error_votes") > 0)).select("scenario")
    return votes.where("is_error").join(zero, "scenario", "left_semi")
