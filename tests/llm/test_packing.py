import zlib
from collections import defaultdict

import numpy as np
import pytest

from duologue.llm import packing


def encode(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return [e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)]


def hold(rows, docs, capacity):
    """Every id in one piece, checksums right, sequences gapless and within the capacity; returns the padding."""
    want = dict(zip([d for d, _ in docs], encode([t or "" for _, t in docs]), strict=True))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            ids = want[d][p.start: p.start + p.length]
            assert p.start == at and p.length == len(ids) > 0 and p.doc_tokens == len(want[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    pad = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_pack_exact(spark):
    words = ["tion", "dée", "  x", "\n\n", "don't", "1234", "<|endoftext|>", " ", "\x1c", "日本", "a" * 90]
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 900)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " "), (303, "the " * 30000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, length string").repartition(3)
    df.write.mode("overwrite").parquet(path := packing_path(spark))
    rows = packing.pack(spark.read.parquet(path)).collect()
    total = sum(r.length for r in rows)
    assert hold(rows, docs, 2048) < 0.02 * total


def packing_path(spark):
    from duologue.llm.common import fresh_path

    return fresh_path(spark, "packing")


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    rows = packing.pack(df, with_ids=True).collect()
    assert sorted((r.doc_id or -1) for r in rows if r.start == 0) == [-1, 5, 5]
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 31, 64, 65, 682, 683, 1023, 1100, 2047, 2048, 2049, 10_000])
def test_cuts_add_up(n):
    parts = packing.cuts(n, 2048, 16, 32)
    assert sum(x for x, _ in parts) == n and all(j == 0 or j * x <= 2048 for x, j in parts)


def test_added_tokens_as_the_tokenizer_has_them(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from duologue.llm.queries import QUERIES

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x\n", "no\x1c <|endoftext", "x" * 90 + " <|endoftext|>\n\n y", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (QUERIES["op2_harmonic_packing"](spark, str(tmp_path)).collect(), corpus_pipeline.packed(spark, df, "").collect()):
        for d, t in enumerate(texts):
            want = tok.encode(t, add_special_tokens=False).ids + [1]
            got = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
            assert sum(r.length for r in got) == len(want)
            assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(want[r.start: r.start + r.length], "<u4").tobytes()) for r in got]
