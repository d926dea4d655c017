"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length l belongs to class j = capacity // l, and a bin of class j takes exactly j pieces, so a worker
fills the bins of a class by counting, without looking at other workers: there is no shuffle. Documents may be cut.
What is longer than the capacity gives whole sequences; the rest is taken whole where j such pieces leave little room,
else a head of capacity // (j + 1) is cut off and the tail, at most 1 / j(j + 1) of the capacity, goes on. Tails of
classes above ``classes`` run on through one sequence after another. Bins still open when a worker ends are emptied
into that run, and the last stretch of the run is cut at powers of two, which need no padding.

A worker holds one Arrow batch and at most ``classes`` squared waiting pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK = re.compile(r"\s*\S+|\s+")
#: Separators that only one of the two pattern languages counts as white space.
ODD = re.compile("[\x1c-\x1f]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Tokens that a tokenizers JSON finds in a text before all else, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens with conditions on what stands beside them")
    return {t["content"]: t["id"] for t in found}


class Encoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The pre-tokenizer never joins what stands before white space with it, so a text is the sequence of its chunks
    (white space, then other characters), and chunks seen before are looked up. ``added`` tokens are cut out first.
    """

    def __init__(self, ranks_path: str, most: int = 300_000, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.most = most
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64:  # long chunks are rarely met again
            return self.plain(chunk)
        if len(self) >= self.most:
            self.clear()
        ids = self[chunk] = self.plain(chunk)
        return ids

    def ids(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            return b"".join(self.added[t] if k % 2 else self.ordinary(t) for k, t in enumerate(parts))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if ODD.search(text):
            return self.plain(text)
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def cuts(n: int, capacity: int, slack: int, classes: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens; class 0 is the run of small tails."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if j > classes:
            out.append((rest, 0))
            break
        if j * rest >= capacity - slack:
            out.append((rest, j))
            break
        head = capacity // (j + 1)
        out.append((head, j + 1 if j < classes else 0))
        rest -= head
    return out


class Bins:
    """The open bins of one worker; ``rows`` collects placed pieces."""

    def __init__(self, capacity: int, classes: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: list[list[tuple]] = [[] for _ in range(classes + 1)]
        self.run: list[tuple] = []
        self.used = 0
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        """One finished sequence."""
        at = 0
        for doc, total, ids, start, length in pieces:
            self.rows.append((doc, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)]), total, self.next,
                              at, ids))
            at += length
        self.next += 1

    def add(self, piece: tuple, j: int) -> None:
        if j == 0:
            self.add_run(piece)
            return
        bin_ = self.open[j]
        bin_.append(piece)
        if len(bin_) == j:
            self.place(bin_)
            self.open[j] = []

    def add_run(self, piece: tuple) -> None:
        doc, total, ids, start, length = piece
        while length:
            take = min(length, self.capacity - self.used)
            self.run.append((doc, total, ids, start, take))
            start, length, self.used = start + take, length - take, self.used + take
            if self.used == self.capacity:
                self.place(self.run)
                self.run, self.used = [], 0

    def close(self) -> None:
        for bin_ in self.open:
            for piece in bin_:
                self.add_run(piece)
        queue, left = list(self.run), self.used
        while left:
            room = 1 << (left.bit_length() - 1)
            part, size = [], room
            while size:
                doc, total, ids, start, length = queue.pop(0)
                take = min(length, size)
                part.append((doc, total, ids, start, take))
                if take < length:
                    queue.insert(0, (doc, total, ids, start + take, length - take))
                size -= take
            self.place(part)
            left -= room


def pack(docs: DataFrame, capacity: int = 2048, slack: int = 16, classes: int = 32, end_id: int = 1,
         ranks_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
         added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on request).

    Every token id of every document, its final ``end_id`` included, lies in exactly one piece. A null or empty text is
    the single token ``end_id``; a null id is kept. Repeated rows are packed once each. ``docs`` must give the same rows
    in the same order when a partition is computed again, as a scan of written files does. At most ``slack`` tokens
    of padding are accepted where a rest is taken whole. ``added`` tokens in a text give their own id (``added_tokens`` reads
    them from the tokenizer's JSON); without them their characters are text like others.
    """
    path = ranks_path or vocabulary("byte_bpe_50k.tiktoken")
    fields = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"]
    schema = f"{id_col} long, " + ", ".join(fields + ["ids array<int>"] * with_ids)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(list(c), pa.int64()) for c in list(zip(*rows, strict=True))[:7]] if rows else [pa.array([], pa.int64())] * 7
        if with_ids:
            cols.append(pa.array([np.frombuffer(r[7], "<u4")[r[1]: r[1] + r[2]].astype(np.int32) for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path, added=added), np.array([end_id], "<u4").tobytes()
        bins = Bins(capacity, classes, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                for length, j in cuts(total, capacity, slack, classes):
                    bins.add((doc, total, ids, start, length), j)
                    start += length
                if len(bins.rows) >= 4096:
                    yield emit(bins.rows)
                    bins.rows = []
        bins.close()
        yield emit(bins.rows)

    return docs.select(docs[id_col].cast("long").alias(id_col), text_col).mapInArrow(work, schema)
