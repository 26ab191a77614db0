"""Hierarchical multi-length packing of token sequences.

Documents are routed by length to context-size tiers. Whole windows of the longest tier are cut off first; what is left
goes to the smallest tier that holds it. Each tier is packed, the longest first; gaps of its windows are filled from
shorter tiers, with whole remainders that fit best and at last with a cut one. What no full window takes at the end of
a partition is laid out at powers of two, so that nothing is padded. Windows of one size and of near attention cost (the sum of
squares of their pieces) are dealt into step groups of equal tokens, so that the members of a step take alike long.

Work is narrow: a partition packs its own documents in blocks of bounded tokens, and sequence numbers carry the
partition's number. Nothing is shuffled.

Defined cases: a null text is empty; an empty document is its end mark alone; a document of any length is cut as
needed; repeated rows are packed each on their own; empty input gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, sub_batches

TIERS = (256, 512, 1024)
#: Tokens of a step group.
STEP_TOKENS = 8192
#: Tokens that a block holds before it is packed.
BLOCK_TOKENS = 2_000_000
#: How a byte-level tokenizer splits text before it merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Signs that engines of regular expressions do not all count as white space.
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e]")
#: The rank encoder gives up on runs of white space near a million; texts with runs of this length go through the tokenizer itself.
_LONG_RUN = re.compile(r"\s{50000}")
END = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
PIECES_WITH_IDS = PIECES + ", ids array<int>"
_tokenizers: dict[str, Tokens] = {}


def _alphabet() -> dict[str, int]:
    """The signs by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit numbers.

    A file of plain byte-level merges in the order of their ids, its added tokens taken as they stand, is read into a rank encoder, which
    gives the same ids several times faster. Other files, and texts with signs that the two might split apart differently, go
    through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.ranks = self._ranks(json.load(f))

    @staticmethod
    def _ranks(file: dict):
        import tiktoken

        model, before = file["model"], file.get("pre_tokenizer") or {}
        byte, vocab = _alphabet(), model.get("vocab", {})
        added = file.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special} if all(c in byte for t in vocab if t not in special for c in t) else {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        simple = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not file.get("normalizer")
        simple = simple and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        simple = simple and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        ids = [vocab[a + b] for a, b in merges] if simple and ranks else []
        if not ids or ids != sorted(ids) or len(ids) + 256 != len(ranks):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the tokenizer itself."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end mark."""
        known: dict[str, bytes] = {}
        for t in texts:
            if t not in known:
                ids = self.whole([t])[0] if self.ranks is None or _UNSURE.search(t) or (len(t) >= 50_000 and _LONG_RUN.search(t)) else array("I", self.ranks.encode(t, allowed_special="all")).tobytes()
                known[t] = ids + END
        return [known[t] for t in texts]


def tokens(path: str) -> Tokens:
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (size, [(document, start, length)]); every window is full, and its size a tier or, at the end, a power of two."""
    top = tiers[-1]
    short: list[tuple[int, int, int]] = []  # (length, document, start) of remainders that no window has yet, in order
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        whole = n // top
        for k in range(whole):
            yield top, [(d, k * top, top)]
        if r := n - whole * top:
            routed[next(t for t in tiers if r <= t)].append((r, d, whole * top))
    for t in tiers[:-1]:
        short += routed[t]
    short.sort()
    rest: list[tuple[int, int, int]] = []
    for t in reversed(tiers):
        own = sorted(routed[t], reverse=True) if t == top else []
        if t != top:  # remainders of this tier that longer windows have not taken
            at = bisect.bisect_left(short, (t // 2 + 1 if t != tiers[0] else 1,))
            own, short = short[at:][::-1], short[:at]
        while own:
            n, d, s = own.pop(0) if t != tiers[0] else own.pop()
            window, gap = [(d, s, n)], t - n
            stock = short if t != tiers[0] else own
            if t == tiers[0]:
                stock.reverse()
            while gap and stock:
                at = bisect.bisect_right(stock, (gap, 1 << 62, 0))
                if at:
                    n, d, s = stock.pop(at - 1)
                    window.append((d, s, n))
                    gap -= n
                else:
                    n, d, s = stock.pop(0)
                    window.append((d, s, gap))
                    bisect.insort(stock, (n - gap, d, s + gap))
                    gap = 0
            if t == tiers[0]:
                stock.reverse()
            if gap:
                rest += [(n, d, s) for d, s, n in window]
            else:
                yield t, window
    # What is left lies end to end in windows of the longest tier, the last of them cut at powers of two.
    left = sum(n for n, _, _ in rest)
    while left:
        size = min(top, 1 << (left.bit_length() - 1))
        window, gap = [], size
        while gap:
            n, d, s = rest.pop()
            take = min(n, gap)
            window.append((d, s, take))
            if take < n:
                rest.append((n - take, d, s + take))
            gap -= take
        left -= size
        yield size, window


def _packed(tokenizer: str, with_ids: bool, block_tokens: int, tiers: tuple[int, ...]):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    schema = pa.schema([(n, pa.int64()) for n in names[:7]] + [("tier", pa.int32()), ("step_group", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = tokens(tokenizer)
        number = TaskContext.get().partitionId() << 36
        group, in_group = number, 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, group, in_group
            lengths = [len(b) // 4 for b in ids]
            rows: list[tuple] = []
            for size, window in sorted(pack_block(lengths, tiers), key=lambda x: (-x[0], sum(n * n for _, _, n in x[1]))):
                at = 0
                for d, s, n in window:
                    own = ids[d][4 * s : 4 * (s + n)]
                    row = (docs[d], s, n, zlib.crc32(own), lengths[d], number, at, size, group)
                    rows.append((*row, np.frombuffer(own, dtype="<i4")) if with_ids else row)
                    at += n
                number += 1
                in_group += size
                if in_group >= STEP_TOKENS:
                    group, in_group = group + 1, 0
                if len(rows) >= 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            ids.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for part in sub_batches(batch, "text", 1 << 20):
                docs += part.column("doc_id").to_pylist()
                new = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                ids += new
                held += sum(map(len, new)) // 4
                if held >= block_tokens:
                    yield from packed()
                    held = 0
        yield from packed()

    return run


def pack(docs: DataFrame, tokenizer: str, *, with_ids: bool = False, block_tokens: int = BLOCK_TOKENS, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece of a document in a sequence; with ids also the piece's token ids."""
    bound_batches(docs)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return only.mapInArrow(_packed(tokenizer, with_ids, block_tokens, tiers), PIECES_WITH_IDS if with_ids else PIECES)
