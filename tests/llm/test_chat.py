import hashlib
import random

import numpy as np
import pytest

from duologue.llm import chat

KIND = "conv_id long, turn long, role string, text string, piece string"


def want(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        said = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(said),
                  hashlib.sha256(said.encode()).hexdigest())
    return out


def made(seed=3):
    rng = random.Random(seed)
    bits = ["</s>", "[INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\/s>", "<", "\\", "|im_end|>", " ", "\n", "é", "漢字", "👩‍👩‍👧", "word", "  ", "<|endoftext|>", "<|im_start|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|im_sep|>"]), "".join(rng.choices(bits, k=rng.randrange(0, 12))), "x")
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"turn {t} </s>", "x") for t in range(400)]  # spans ranges
    rows += [(50, 0, "assistant", "long é " * 60_000, "x"), (51, 0, None, None, "x"), (52, 0, "assistant", "", None), (None, 1, "user", "no id", "x"),
             (None, 0, "assistant", "first", "x"), (53, None, "assistant", "late", "x"), (53, 5, "user", "early", "x"),
             (54, 0, "assistant", "twice", "x"), (54, 0, "assistant", "twice", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("stretch, hold", [(1 << 20, 16 << 20), (200, 300)])
def test_read_back(spark, stretch, hold):
    rows = made()
    turns = spark.createDataFrame(rows, KIND).repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns, stretch=stretch), hold).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want(rows)


def test_pieces_are_the_whole(spark):
    import public_tokenizers

    rows = made(4)
    pieces = chat.formatted(spark.createDataFrame(rows, KIND), stretch=150).collect()
    tok = chat.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    convs = {}
    for p in sorted(pieces, key=lambda p: p.piece):
        convs.setdefault(p.conv_id, []).append(p)
    assert max(len(ps) for ps in convs.values()) > 10
    for ps in convs.values():
        whole = tok.encode("".join(p.text for p in ps), add_special_tokens=False)
        assert [i for p in ps for i in p.ids] == whole.ids
        # the marks are not in the mask, and nothing of another turn is
        marks = {tok.token_to_id(t) for t in (chat.TURN, chat.TEXT, chat.END)}
        assert not any(on and i in marks for p in ps for i, on in zip(p.ids, p.loss))


def test_escapes():
    e, rng = chat.Escapes(), random.Random(5)
    alphabet = ["<", "\\", "|", "im_end", "|>", "/s>", "s>", "[", "/", "INST]", "a", *chat.CONTROLS]
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 10)))
        put = e.put(text)
        assert e.take(put) == text and not any(c in put for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        chat.Escapes(("<<SYS>>",))


def test_mask_is_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        starts = np.cumsum(rng.integers(0, 3, 20))
        ends = np.maximum.accumulate(starts + rng.integers(1, 4, 20))
        spans = sorted((int(a), int(a + n)) for a, n in zip(rng.choice(40, 3, False), rng.integers(0, 6, 3)))
        slow = [any(s < b and e > a and a < b for a, b in spans) for s, e in zip(starts, ends)]
        assert chat.masked(starts, ends, spans).tolist() == slow or any(a == b for a, b in spans)


def test_empty(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], KIND))).count() == 0
