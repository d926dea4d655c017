"""What the operators of this package share: tables, written steps and word hashes.

Tables are cut to the named columns first, so extra columns never reach an operator.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.session import cut, fresh_path, shared_dir

__all__ = ["WordHash", "column", "cut", "fresh_path", "mix", "shared_dir", "table", "texts_of", "wanted"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of an Arrow batch; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


class WordHash(dict):
    """64-bit hash of each word, kept for words seen before. The store is emptied when full: it only saves time."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (the finaliser of splitmix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def wanted(df: DataFrame, ids: DataFrame, column: str, bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose ``column`` may be among ids(column): a filter before a join, so that the rest is not shuffled.

    Hashes of the ids are bits of a map of fixed size (8 MB), which is built by an aggregate and broadcast in pieces of 4 KB. All wanted
    rows stay; others stay with the probability that their bit is set.
    """
    h = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)) + 1
    place, bit = F.bitmap_bucket_number(h), F.bitmap_bit_position(h)
    map_ = ids.groupBy(place.alias("__place")).agg(F.bitmap_construct_agg(bit).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.col("__bit") % 8
    set_ = (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), on.cast("int")))) > 0
    return df.withColumns({"__place": place, "__bit": bit}).join(F.broadcast(map_), "__place").where(set_).drop("__place", "__bit", "__map")
