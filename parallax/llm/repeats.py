"""Removal of repeated passages with suffix arrays.

A passage is a string of ``LENGTH`` bytes. Of the hashes of its short grams the smallest is its anchor, so that equal
passages have equal anchors; passages of a document that share an anchor form one span of text. Anchors seen once hold
no repeat. Where all spans of an anchor are equal, all their passages repeat. Other spans go, once for each different
text, to shards dealt by anchor. A shard sorts the suffixes of its spans by Larsson-Sadakane refinement and finds the
common prefixes of neighbours by Kasai's method, many spans side by side. An anchor with too many spans is dealt to several
shards; those send the keys of passages that they hold once to merge shards, each of which has a range of keys and finds those of several shards by binary search
in their sorted lists. What repeats goes back to the documents, which lose every byte that a repeated passage covers.

Defined cases: a null text is empty; texts shorter than a passage keep all; overlapping repeats within a document
count; all copies of a repeated row lose their bytes, if long enough; an empty table gives no rows; columns other than
doc_id and text are ignored. Rows with equal doc_id and different text are told
apart by a hash of the text (64 bits, 128 without an id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, cut

LENGTH, GRAM = 200, 40
REACH = LENGTH - GRAM + 1
#: Bytes of text whose hashes are computed together; positions within take PLACE_BITS.
BLOCK_BYTES, PLACE_BITS = 1 << 19, 20
#: Spans of one anchor that a shard takes, and bytes of all documents for each shard.
SPANS, BYTES_PER_SHARD = 16_000, 4 << 20
SEGMENTS = "key long, th long, anchor long, span long, pos long"
FOUND = "anchor long, span long, first int, last int, salt long, k1 long, k2 long"
_MASK = np.uint64((1 << PLACE_BITS) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        base = 0x9E3779B97F4A7C15
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return _powers[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of a width."""
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(v)] = v
    full = full.reshape(rows, width)
    up = np.minimum.accumulate(full, axis=1).reshape(-1)
    down = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of passages that begin in [starts, ends): the text's number, anchor, hash of the span, first and last passage."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < LENGTH or not (ends > starts).any():
        return none
    up, back = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    grams = len(data) - GRAM + 1
    h = _mix((total[GRAM:] - total[:grams]) * back[:grams])
    place = np.arange(grams, dtype=np.uint64)
    least = _least((h & ~_MASK) | place, REACH) & _MASK
    owner = np.full(len(least) + 1, -1, dtype=np.int64)
    mark = np.zeros(len(least) + 1, dtype=np.int64)
    own = np.flatnonzero(ends > starts)
    mark[starts[own]] += own + 1
    np.subtract.at(mark, np.minimum(ends[own], len(least)), own + 1)
    owner = np.cumsum(mark)[:-1] - 1
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    keep = owner[first] >= 0
    first, last = first[keep], last[keep]
    length = (last - first + LENGTH).astype(np.uint64)
    span = _mix((total[last + LENGTH] - total[first]) * back[first] + length * np.uint64(0xD6E8FEB86659FD93))
    return owner[first], h[least[first].astype(np.int64)], span, first, last


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "th", "anchor", "span", "pos"]

    def emitted(group: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        # group: key, hash, bytes, and where these bytes begin in their text
        sizes = np.array([len(g[2]) for g in group], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        owner, anchor, span, first, last = segments(np.frombuffer(b"".join(g[2] for g in group), dtype=np.uint8), begin, begin + np.maximum(0, sizes - LENGTH + 1))
        j0 = first - begin[owner] + np.array([g[3] for g in group], dtype=np.int64)[owner]
        pos = j0 << 9 | (last - first + 1)
        ids, th = pa.array([g[0] for g in group], pa.int64()), pa.array([g[1] for g in group], pa.int64())
        at = pa.array(owner)
        return pa.record_batch([ids.take(at), th.take(at), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(pos)], names=names)

    group, held = [], 0
    for batch in batches:
        for key, th, raw in zip(batch.column("key").to_pylist(), batch.column("th").to_pylist(), batch.column("raw").to_pylist()):
            for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK_BYTES):
                piece = raw[at : at + BLOCK_BYTES + LENGTH - 1]
                if held + len(piece) > BLOCK_BYTES and group:
                    yield emitted(group)
                    group, held = [], 0
                group.append((key, th, piece, at))
                held += len(piece)
    if group:
        yield emitted(group)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of all suffixes: sorted by their first symbols, then by ranks twice as far each round, unsorted groups only."""
    n, h = len(data), 7
    # Seven symbols of nine bits; the end is the smallest symbol.
    symbol = np.zeros(n + h, dtype=np.uint64)
    symbol[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(h):
        key = key << np.uint64(9) | symbol[k : k + n]
    sa = np.argsort(key, kind="stable")
    own = key[sa]
    head = np.ones(n, dtype=bool)
    head[1:] = own[1:] != own[:-1]
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    del own, key, symbol
    at = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of groups of more than one
    while len(at):
        p = sa[at]
        near, far = rank[p], rank[np.minimum(p + h, n)]
        order = np.argsort(near * (n + 2) + far, kind="stable")
        p, near, far = p[order], near[order], far[order]
        sa[at] = p
        new = np.ones(len(p), dtype=bool)
        new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        head[at] = new
        rank[p] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def repeated(data: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each of ``count`` passages from ``begin`` of each span on, whether it occurs elsewhere; flat, in order of spans.

    Neighbours in the suffix array, passages only, are compared by Kasai's method: the common prefix of a passage with its
    predecessor is at least that of the passage one byte before, less one. All spans advance together, a byte at a time.
    """
    sa = suffix_array(data)
    good = np.zeros(len(data) + 1, dtype=bool)
    flat = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, count)]) if len(begin) else np.empty(0, np.int64)
    good[flat] = True
    order = sa[good[sa]]
    before = np.full(len(data) + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(data) + 1, dtype=np.int16)
    i, stop, l = begin.copy(), begin + count, np.zeros(len(begin), dtype=np.int64)
    live = np.arange(len(begin))
    while len(live):
        a, k = i[live], l[live]
        b = before[a]
        more = (b >= 0) & (k < length)
        same = np.zeros(len(live), dtype=bool)
        same[more] = data[a[more] + k[more]] == data[b[more] + k[more]]
        l[live[same]] += 1
        done = live[~same]
        common[i[done]] = l[done]
        j = before[i[done]]
        l[done] = np.where((j >= 0) & good[np.maximum(j, 0) + 1], np.maximum(l[done] - 1, 0), 0)
        i[done] += 1
        live = live[i[live] < stop[live]]
    hit = np.zeros(len(data) + 1, dtype=bool)
    pair = common[order] >= length
    hit[order[pair]] = True
    hit[order[:-1][pair[1:]]] = True
    return hit[flat]


def _judged(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Spans of a shard in a set order, where the passages of each begin in a flat list, and which of them repeat."""
    pdf = pdf.sort_values(["anchor", "span"], kind="stable")
    texts = list(pdf["t"])
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = sizes - LENGTH + 1
    hit = repeated(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes) - sizes, count)
    begin = np.cumsum(count) - count
    many = np.repeat(pdf["n"].to_numpy() > 1, count)
    return pdf, begin, hit | many


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated passages of each span, and for divided anchors the keys of passages, one of each."""
    pdf, begin, hit = _judged(pdf)
    edge = np.zeros(len(hit), dtype=bool)
    edge[begin] = True
    a = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
    b = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
    own = np.searchsorted(begin, a, side="right") - 1
    anchor, span = pdf["anchor"].to_numpy(), pdf["span"].to_numpy()
    runs = pd.DataFrame({"anchor": anchor[own], "span": span[own], "first": a - begin[own], "last": b - begin[own], "salt": -1, "k1": 0, "k2": 0})
    rows: dict[tuple[int, bytes], tuple] = {}
    for row, at in zip(pdf.itertuples(), begin):
        if row.parts > 1:
            for i in range(len(row.t) - LENGTH + 1):
                d = hashlib.blake2b(row.t[i : i + LENGTH], digest_size=16).digest()
                rows.setdefault((row.anchor, d), (row.anchor, row.span, i, i, row.salt, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    keys = pd.DataFrame(list(rows.values()), columns=runs.columns)
    both = pd.concat([runs, keys]) if len(keys) else runs
    return both.astype({"first": "int32", "last": "int32"})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Passages of a range of keys that several shards hold: each shard's sorted list is searched for the others' keys."""
    key = np.rec.fromarrays([pdf["anchor"].to_numpy(), pdf["k1"].to_numpy(), pdf["k2"].to_numpy()], names="a,k,l")
    _, number = np.unique(key, return_inverse=True)
    salt = pdf["salt"].to_numpy()
    hit = np.zeros(len(pdf), dtype=bool)
    for s in np.unique(salt):
        own = np.unique(number[salt == s])
        at = np.flatnonzero((salt != s) & ~hit)
        k = np.minimum(np.searchsorted(own, number[at]), len(own) - 1)
        hit[at[own[k] == number[at]]] = True
    return pdf.loc[hit, ["anchor", "span", "first", "last"]]


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [press.compress(t) for t in batch.column("raw").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), batch.column("th"), pa.array(z, pa.binary())], names=["doc_id", "key", "th", "z"])


def _opened(z: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(z)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of spans to be judged."""
    names = ["anchor", "span", "n", "t"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        for z, judge in zip(batch.column("z").to_pylist(), batch.column("judge").to_pylist()):
            raw = _opened(z)
            for x in judge:
                at = x["pos"] >> 9
                rows.append((x["anchor"], x["span"], x["n"], raw[at : at + (x["pos"] & 511) + LENGTH - 1]))
            if len(rows) > 10_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out: list[tuple] = []
        for doc_id, z, runs in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "z", "runs")]):
            raw, kept, spans, end = _opened(z), [], 0, 0
            # A run is where it begins, and how much further on its last passage does.
            for a, b in sorted((p >> 9, (p >> 9) + (p & 511)) for p in runs or []):
                if a > end or not spans:
                    kept.append(raw[end:a])
                    spans += 1
                end = max(end, b + LENGTH)
            kept.append(raw[end:])
            text = b"".join(kept)
            out.append((doc_id, len(raw), len(raw) - len(text), spans, text))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=names)


def _again(raw: DataFrame) -> DataFrame:
    """Segments of anchors that occur again; ``equal`` if all spans of the anchor are."""
    rows = raw.mapInArrow(_scan, SEGMENTS)
    anchors = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    # Counted apart, so that both sides of the join are dealt for it and a frequent anchor's rows can be split.
    again = cut(anchors.where("n > 1").select("anchor", "n", (F.col("lo") == F.col("hi")).alias("equal")))
    return rows.join(again, "anchor")


def _with_lists(squeezed: DataFrame, rows: DataFrame, value, name: str, how: str) -> DataFrame:
    """One list of distinct values for each key and text; all rows of that key and text get it."""
    lists = rows.groupBy("key", "th").agg(F.collect_set(value).alias(name))
    return squeezed.join(lists, ["key", "th"], how).select("doc_id", "z", name)


def _runs(squeezed: DataFrame, judge: DataFrame, shards: int, spans_per_shard: int) -> DataFrame:
    """(anchor, span, first, last) of repeated passages in spans that are not all equal."""
    texts = _with_lists(squeezed, judge, F.struct("anchor", "span", "pos", "n"), "judge", "inner").select("z", "judge").mapInArrow(_cut_out, "anchor long, span long, n long, t binary")
    spans = texts.groupBy("anchor", "span").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("t").alias("t"))
    parts = F.ceil(F.col("n") / spans_per_shard)
    dealt = spans.withColumn("parts", parts).withColumn("salt", F.pmod("span", "parts")).withColumn("shard", F.pmod(F.xxhash64("anchor", "salt"), F.lit(shards)))
    found = cut(dealt.select("shard", "anchor", "span", F.col("copies").alias("n"), "t", "parts", "salt").groupBy("shard").applyInPandas(lambda pdf: _shard(pdf), FOUND))
    keys = found.where("salt >= 0").withColumn("range", F.pmod(F.xxhash64("anchor", "k1"), F.lit(shards)))
    merged = keys.groupBy("range").applyInPandas(lambda pdf: _merged(pdf), "anchor long, span long, first int, last int")
    return found.where("salt < 0").select("anchor", "span", "first", "last").unionByName(merged)


def remove_repeats(docs: DataFrame, *, spans_per_shard: int = SPANS, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (its remaining bytes)."""
    bound_batches(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # Rows of one id are told apart by 64 bits of their text, those without an id by 128.
    raw = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text)).alias("key"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(8, -(-size // bytes_per_shard))
    seen = cut(_again(raw))
    squeezed = raw.mapInArrow(_squeezed, "doc_id long, key long, th long, z binary")
    judge = seen.where("not equal")
    runs = _runs(squeezed, judge, shards, spans_per_shard)
    at = F.shiftright("pos", 9)
    whole = seen.where("equal").select("key", "th", F.shiftleft(at, 9).bitwiseOR(F.col("pos").bitwiseAND(F.lit(511)) - 1).alias("p"))
    part = judge.join(runs, ["anchor", "span"]).select("key", "th", F.shiftleft(at + F.col("first"), 9).bitwiseOR((F.col("last") - F.col("first")).cast("long")).alias("p"))
    full = _with_lists(squeezed, whole.unionByName(part), F.col("p"), "runs", "left")
    return full.mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
