"""Chat formatting with a loss mask that is aligned by character offsets.

The turns of a conversation are rendered into one string, noting the stretch of every text that counts for the loss. The string is
encoded once, with the character offsets of each token, and both lists being in order, the tokens of a stretch are found by binary
search. The template's marks are special tokens, so that no token reaches over the edge of a text, and a string of control characters
inside a role or a text gets a backslash after its first character (or one more, if it has some), which can be taken back.

Rows are dealt by ranges of (conversation, turn). A conversation inside one range is rendered and encoded whole; one that
crosses ranges, or has more characters than ``stretch``, continues in further pieces, which start at a turn. Since turns begin with a
special token, the ids are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.packing import CHUNK, ODD

TURN, TEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings with a meaning to this template or to others in wide use.
CONTROLS = (TURN, TEXT, END, "<|im_system|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
            "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")


class Escapes:
    """Takes control strings in a text apart, and back."""

    def __init__(self, controls: tuple[str, ...] = CONTROLS):
        heads = {c[0] for c in controls}
        if any("\\" in c or len(c) < 2 or heads & set(c[1:]) for c in controls):
            raise ValueError("a control string has two characters at least, no backslash, and no first character of one after its own first")
        kinds = [(re.escape(c[0]), re.escape(c[1:])) for c in sorted(controls, key=len, reverse=True)]
        self.bare = re.compile("|".join(rf"{a}\\*{b}" for a, b in kinds))
        self.escaped = re.compile("|".join(rf"{a}\\+{b}" for a, b in kinds))

    def put(self, text: str) -> str:
        return self.bare.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def take(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([TURN, TEXT, END])
    return tok


class OffsetEncoder(dict):
    """Token ids of a string with their offsets. The pre-tokenizer never joins what stands before white space with it, so a string is the
    sequence of its marks and chunks (white space, then other characters), and chunks seen before are looked up."""

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        self.tok, self.most = tokenizer(path), most
        self.marks = re.compile("(" + "|".join(map(re.escape, (TURN, TEXT, END))) + ")")

    def __missing__(self, chunk: str) -> tuple[bytes, bytes, int]:
        e = self.tok.encode(chunk, add_special_tokens=False)
        got = np.array(e.ids, np.int32).tobytes(), np.array(e.offsets, np.int32).tobytes(), len(e.ids)
        if len(chunk) <= 64:  # long chunks are rarely met again
            if len(self) >= self.most:
                self.clear()
            self[chunk] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chunks: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2 or ODD.search(part):
                chunks.append(part)
            else:
                chunks += CHUNK.findall(part)
        found = list(map(self.__getitem__, chunks))
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        base = np.repeat((np.cumsum(size) - size).astype(np.int32), np.fromiter((f[2] for f in found), np.int64, len(found)))
        at = np.frombuffer(b"".join(f[1] for f in found), np.int32).reshape(-1, 2)
        return np.frombuffer(b"".join(f[0] for f in found), np.int32), at[:, 0] + base, at[:, 1] + base


@lru_cache(1)
def encoder_of(path: str) -> OffsetEncoder:
    """Loaded once in the life of a worker process."""
    return OffsetEncoder(path)


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with one of the spans; tokens and spans are in order."""
    lo = np.searchsorted(ends, [a for a, _ in spans], "right")
    hi = np.searchsorted(starts, [b for _, b in spans], "left")
    step = np.zeros(len(starts) + 1, np.int64)
    full = lo < hi
    np.add.at(step, lo[full], 1)
    np.add.at(step, hi[full], -1)
    return np.cumsum(step[:-1]) > 0


def formatted(turns: DataFrame, learn: tuple[str, ...] = ("assistant",), tokenizer_path: str | None = None, stretch: int = 1 << 20, id_col: str = "conv_id",
              turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, piece, n_turns, text, ids, starts, ends and loss for each piece; in the order of ``piece`` the pieces of a conversation make it up.

    ``loss`` marks the tokens of the texts of the ``learn`` roles, ``starts`` and ``ends`` are offsets in ``text`` in code points. Turns are in the order of
    turn (null last), role and text; repeated rows are turns of their own. A null role or text is empty; rows with a null id are one conversation.
    A text is never cut, however long. Other columns are not read; an empty table gives no rows. Pieces are numbered over ranges, so ``turns`` must be
    the same when read again, as written files are.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last()]
    plain = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, escapes, number = encoder_of(tokenizer_path), Escapes(), TaskContext.get().partitionId() << 32
        waiting: list[tuple[int | None, int, str, list[tuple[int, int]]]] = []
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        conv, size, n, held = None, 0, 0, 0

        def close() -> None:
            nonlocal parts, spans, size, n, held
            if n:
                waiting.append((conv, n, "".join(parts), spans))
                held += size
            parts, spans, size, n = [], [], 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal number, held
            ids, starts, ends, loss = [], [], [], []
            for *_, text, where in waiting:
                i, a, b = encoder.encode(text)
                ids.append(i)
                starts.append(a)
                ends.append(b)
                loss.append(masked(a, b, where))
            ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [pa.array([w[0] for w in waiting], pa.int64()), pa.array(range(number, number + len(waiting)), pa.int64()),
                 pa.array([w[1] for w in waiting], pa.int64()), pa.array([w[2] for w in waiting], pa.string()),
                 pa.array(ids, ints), pa.array(starts, ints), pa.array(ends, ints), pa.array(loss, flags)],
                ["conv_id", "piece", "n_turns", "text", "ids", "starts", "ends", "loss"])
            number += len(waiting)
            waiting.clear()
            held = 0
            return out

        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if c != conv or size > stretch:
                    close()
                    if held > 1 << 18:
                        yield emit()
                    conv = c
                head, body = f"{TURN}{escapes.put(role)}{TEXT}", escapes.put(text.as_py())
                if role in learn:
                    spans.append((size + len(head), size + len(head) + len(body)))
                parts += [head, body, END]
                size += len(head) + len(body) + len(END)
                n += 1
        close()
        yield emit()

    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    return dealt.mapInArrow(work, "conv_id long, piece long, n_turns long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def turns_of(text: str, escapes: Escapes) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted string."""
    turns = [t.split(TEXT) for t in text.split(END)[:-1]]
    return [(escapes.take(head[len(TURN):]), escapes.take(body)) for head, body in turns]


def learnt(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray, escapes: Escapes) -> list[str]:
    """The stretches of a formatted string under the mask."""
    on = np.flatnonzero(loss)
    if not len(on):
        return []
    breaks = np.flatnonzero(np.diff(on) > 1)
    return [escapes.take(text[starts[a]: ends[b]]) for a, b in zip(on[np.r_[0, breaks + 1]], on[np.r_[breaks, len(on) - 1]], strict=True)]


def digests(pieces: DataFrame, hold: int = 4 << 20) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted pieces.

    ``pieces`` are in order inside their partitions, as ``formatted`` gives them. A conversation that certainly lies in one partition, and is short, is
    finished there. Of the first and the last of a partition, and of long ones, the bytes go on to a second pass, where one task reads them in order: a digest
    can't be had from digests of parts. That pass keeps no conversation in memory.
    """
    names = ["conv_id", "piece", "n_turns", "turns", "loss", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes, out = Escapes(), []
        open_: list[tuple] = []  # pieces of the conversation being read
        conv, first, size = None, True, 0

        def finish(edge: bool) -> None:
            if edge or size > hold:
                out.extend(open_)
            elif open_:
                turns, loss = b"".join(r[3] for r in open_), b"".join(r[4] for r in open_)
                out.append((conv, open_[0][1], sum(r[2] for r in open_), None, None, sum(r[5] for r in open_), sum(r[6] for r in open_),
                            hashlib.sha256(turns).hexdigest(), hashlib.sha256(loss).hexdigest()))
            open_.clear()

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            starts, ends, loss = (b.column(b.schema.get_field_index(c)) for c in ("starts", "ends", "loss"))
            for k, (c, piece, n, text) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
                if c != conv and (open_ or size):
                    finish(first)
                    first, size = False, 0
                conv = c
                turns = "".join(f"{role}\n{said}\n" for role, said in turns_of(text, escapes))
                under = "".join(learnt(text, starts[k].values.to_numpy(), ends[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False), escapes))
                open_.append((c, piece, n, turns.encode(), under.encode(), len(under), len(text), None, None))
                size += len(text)
                if size > hold:  # goes on piece by piece
                    out.extend(open_)
                    open_.clear()
                    yield emit()
            yield emit()
        finish(True)
        yield emit()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        out: list[tuple] = []

        def close() -> None:
            if state:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, _, n, turns, loss, chars, total, done, loss_done in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if done:
                    out.append((c, n, done, chars, loss_done, total))
                    continue
                if state is None or c != conv:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns)
                state[2] += chars
                state[3].update(loss)
                state[4] += total
            yield emit()
        close()
        yield emit()

    schema = "conv_id long, piece long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string"
    back = pieces.select("conv_id", "piece", "n_turns", "text", "starts", "ends", "loss").mapInArrow(read_back, schema)
    return back.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(
        fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests_sql(extra: str) -> str:
    """The digests by SQL; ``extra`` gives further (conv_id, turn, role, text) rows."""
    heads = sorted({c[0] for c in CONTROLS})

    def put(x: str) -> str:
        for h in heads:
            rests = "|".join(re.sub(r"([|/\[\]])", r"\\\1", c[1:]) for c in CONTROLS if c[0] == h)
            x = rf"regexp_replace({x}, '(\{h})(\\*(?:{rests}))', '\1\\\2', 'g')"
        return x

    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({put('role')}) + length({put('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
