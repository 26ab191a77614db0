import random
import zlib

import numpy as np
import pytest
from helpers import ODD, frame

from parallax.llm import packing
from parallax.llm.registry import tokenizer_path


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("block", [2_000_000, 3000])
def test_round_trip(spark, block):
    r = random.Random(0)
    texts = [*ODD, "<|endoftext|> in text", "a <|endoftext|> b", "x<|endoftext|>y <|endoftext|>  z", "tab\t a \u00a0 b\u3000 c\x1c d\x85 e  f \n g 's it's ''s", "né à la\u2009mi \u200b x", *[" ".join(r.choice(["alpha", "be,ta.", "γάμμα", "\n\n", "12 3"]) for _ in range(r.randint(0, 3000))) for _ in range(25)]]
    ids = reference_ids(texts)
    rows = packing.pack(frame(spark, texts), tokenizer_path(), block_tokens=block, with_ids=True).collect()
    at = {}
    for x in sorted(rows, key=lambda x: (x.doc_id, x.start)):
        want = ids[x.doc_id][x.start : x.start + x.length]
        assert x.start == at.get(x.doc_id, 0) and x.length == len(want) and list(x.ids) == want
        assert x.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes()) and x.doc_tokens == len(ids[x.doc_id])
        at[x.doc_id] = x.start + x.length
    assert at == {i: len(t) for i, t in enumerate(ids)}
    end, size = {}, {}
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == end.get(x.sequence_id, 0)
        end[x.sequence_id] = x.offset + x.length
        size[x.sequence_id] = x.tier
    assert end == size and all(n <= 1024 and n & (n - 1) == 0 for n in end.values())


def test_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_blocks_are_exact():
    r = random.Random(1)
    for _ in range(300):
        lengths = [r.choice([1, 2, 30, 255, 256, 257, 511, 512, 513, 1023, 1024, 1025, 5000]) for _ in range(r.randint(0, 30))]
        seen = [[] for _ in lengths]
        for size, window in packing.pack_block(lengths):
            assert sum(n for _, _, n in window) == size
            for d, s, n in window:
                seen[d].append((s, n))
        for n, own in zip(lengths, seen):
            at = 0
            for s, k in sorted(own):
                assert s == at and k > 0
                at += k
            assert at == n


def test_named_tokenizer():
    t = packing.tokens(tokenizer_path())
    assert np.frombuffer(t.encode(["a <|endoftext|> b"])[0], dtype="<u4").tolist() == [64, 220, 50256, 275, 0]


def test_ranks_change_nothing():
    r = random.Random(4)
    t, odd = packing.tokens(tokenizer_path()), ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "9", "é", "ß", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "!", "日", "<|endoftext|>", "\u200d", "😀", "\u180e", "\u2028", "\ufeff", "\u0301", "Ⅷ", "²", "ª", "\x00", "\u1680", "I'll"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    assert t.ranks and t.encode(texts) == [i + packing.END for i in t.whole(texts)]


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r", "\u2003"])
def test_long_runs_of_blanks(blank):
    t, text = packing.tokens(tokenizer_path()), blank * 2_000_000 + "x"
    assert t.encode([text]) == [x + packing.END for x in t.whole([text])]
