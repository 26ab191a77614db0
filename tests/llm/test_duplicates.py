"""Repeats and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import ODD, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from parallax.llm import repeats, similar, simhash


def mixed_texts():
    r = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(70))
    out = [*ODD, "ab" * 400, "q" * 700, "xyz" * 150]
    for i in range(30):
        body = [r.choice(words) for _ in range(r.randint(20, 150))]
        text = " ".join(body)
        out.append(text + " " + passage + f" tail {i}" if i % 3 == 0 else text)
        if i % 5 == 0:
            body[len(body) // 2] = "edited"
            out.append(" ".join(body))
    return out


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    rows = []
    for t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        rows.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return rows


@pytest.mark.parametrize("limit", [16_000, 3])
def test_repeats(spark, limit):
    texts = mixed_texts()
    rows = repeats.report(frame(spark, texts), spans_per_shard=limit).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == dict(enumerate(brute_removed(texts)))
    assert sum(x.n_removed for x in rows) > 10_000


def test_repeated_rows_and_empty(spark):
    docs = frame(spark, ["z" * 10 + str(list(range(90)))])
    both = docs.unionByName(docs)
    assert [(x.n_bytes, x.n_removed) for x in repeats.report(both).collect()] == [(docs.first().n_chars,) * 2] * 2
    assert repeats.report(docs).first().n_removed == 0 and repeats.report(docs.limit(0)).count() == 0


def test_texts_without_an_id_are_told_apart(spark):
    """Two texts without an id, alike in 32 bits of their hash, of which one shares a passage with another document."""
    passage, other = "".join(random.Random(8).choices("abcdefgh ", k=400)), "".join(random.Random(9).choices("ijklmnop ", k=600))
    made = lambda text, name: spark.range(400_000).select(F.concat(F.lit(text), F.format_string("%07d", "id")).alias(name), F.hash(F.concat(F.lit(text), F.format_string("%07d", "id"))).alias("h"))
    pair = made(passage, "x").join(made(other, "y"), "h").first()
    rows = spark.createDataFrame([(1, passage), (None, pair.x), (None, pair.y)], "doc_id long, text string")
    assert {(x.n_bytes, x.n_removed) for x in repeats.report(rows).collect()} == {(400, 400), (407, 400), (607, 0)}


def test_many_equal_rows(spark):
    text = "".join(random.Random(10).choices("abcdefgh ", k=1000))
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 5).alias("doc_id"), F.lit(text).alias("text"))
    assert [tuple(x) for x in repeats.report(rows).select("n_bytes", "n_removed").distinct().collect()] == [(1000, 1000)]


@given(st.binary(max_size=80) | st.text("ab\0", max_size=120).map(str.encode))
@settings(max_examples=200, deadline=None)
def test_suffix_array(data):
    if data:
        assert repeats.suffix_array(np.frombuffer(data, dtype=np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@given(st.lists(st.text("ab", min_size=6, max_size=25).map(str.encode), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_common_prefixes(spans):
    sizes = np.array([len(s) for s in spans])
    hit = repeats.repeated(np.frombuffer(b"".join(spans), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes - 5, 6)
    seen = Counter(s[i : i + 6] for s in spans for i in range(len(s) - 5))
    assert hit.tolist() == [seen[s[i : i + 6]] > 1 for s in spans for i in range(len(s) - 5)]


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(5000))
    raw = [long.encode(), long[1234:2500].encode()]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([0, 1]), pa.array([0, 0]), pa.array(raw)], names=["key", "th", "raw"])
    covered = {0: set(), 1: set()}
    for out in repeats._scan(iter([batch])):
        for d, pos in zip(out["key"].to_pylist(), out["pos"].to_pylist()):
            own = set(range(pos >> 9, (pos >> 9) + (pos & 511)))
            assert not covered[d] & own
            covered[d] |= own
    assert covered == {i: set(range(len(t) - 199)) for i, t in enumerate(raw)}


def reference_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    u = np.array(fps, dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    return simhash._labels(len(u), a, b)


def test_simhash(spark):
    r = random.Random(5)
    texts = [*mixed_texts(), "A b\tC d", "a  b c\nd"]
    base = [f"t{r.randint(0, 400)}" for _ in range(300)]
    for _ in range(20):
        base[r.randrange(300)] = f"u{r.randint(0, 400)}"
        texts.append(" ".join(base))
    docs = frame(spark, texts)
    rows = sorted(simhash.report(docs).collect())
    fps = [reference_fingerprint(t) for t in texts]
    assert [x.fingerprint for x in rows] == [f"{f:016x}" for f in fps]
    assert [x.component_id for x in rows] == brute_components(fps).tolist()
    kept = simhash.keep_one(docs.unionByName(docs.limit(5)))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_components(fps).tolist()))
    assert simhash.report(docs.limit(0)).count() == 0


def same_groups(spark, x, **options):
    nodes = spark.createDataFrame([(int(v),) for v in x], "fp long")
    roots = {r.node: r.root for r in simhash.connect(simhash.links(nodes, **options)).collect()}
    got = [roots.get(int(v), int(v)) for v in x]
    want = brute_components(x.view(np.uint64)).tolist()
    assert len({(g, w) for g, w in zip(got, want)}) == len(set(got)) == len(set(want))
    return set(want)


def clusters(seed, n, centres):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(2**63), 2**63 - 1, centres)[rng.integers(0, centres, n)]
    for _ in range(2 + 2 * seed):
        x = x ^ np.where(rng.random(n) < 0.7, np.int64(1) << rng.integers(0, 63, n), 0)
    return np.unique(x)


@pytest.mark.parametrize("seed, leaf, crowd", [(0, 512, 16), (1, 16, 16), (3, 16, 16), (2, 16, 1)])
def test_links_connect_the_same(spark, seed, leaf, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    same_groups(spark, clusters(seed, 400, 4), leaf=leaf)


def test_trees_at_their_limits(spark):
    """Many fingerprints at random with planted links, at the limits as they are: the trees have nodes and ask across them."""
    rng = np.random.default_rng(9)
    x = rng.integers(-(2**63), 2**63 - 1, 9000)
    y = x[:3000].copy()
    for k in range(4):  # some of them too far
        y[: 3000 if k < 3 else 1500] ^= np.int64(1) << rng.integers(0, 63, 3000)[: 3000 if k < 3 else 1500]
    x = np.unique(np.concatenate([x, y]))
    trees = [simhash.build(x.view(np.uint64), len(x), m, 1, simhash.LEAF) for m in simhash.HALVES]
    assert all(t.leaves >= 16 for t in trees)
    who, _, asks = simhash.route(trees[0], x.view(np.uint64))
    assert (~asks).sum() == len(x) and asks.any() and len(who) < 6 * len(x)
    assert len(same_groups(spark, x)) < len(x) - 500


@pytest.mark.parametrize("crowd", [16, 1])
def test_dense_ball(spark, crowd, monkeypatch):
    """All fingerprints within two bits of one, and 1,500 at three bits: no distance tells them apart."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(2)
    bit = [1 << i for i in range(63)]
    ball = {0, *bit, *(a | b for a in bit for b in bit)}
    while len(ball) < 3500:
        ball.add(sum(bit[i] for i in rng.choice(63, 3, replace=False)))
    far = [((1 << 62) - 1) ^ v for v in bit[:40]]  # a second, small group in the same table
    x = np.array(sorted(ball | set(far)), dtype=np.int64)
    assert len(same_groups(spark, x, leaf=512)) == 2


def test_homes_and_asks_meet_all_pairs():
    x = clusters(3, 3000, 40).view(np.uint64)
    for mask in simhash.HALVES:
        tree = simhash.build(x, len(x), mask, 1, 32)
        who, leaf, asks = simhash.route(tree, x)
        home = np.empty(len(x), dtype=np.int64)
        home[who[~asks]] = leaf[~asks]
        visits = set(zip(who.tolist(), leaf.tolist()))
        a, b = np.nonzero(np.triu(simhash.hamming(x[:, None] & np.uint64(mask), x[None, :] & np.uint64(mask)) <= 1, 1))
        assert len(a) > 100 and all((i, home[j]) in visits or (j, home[i]) in visits for i, j in zip(a.tolist(), b.tolist()))


def test_tree_beyond_its_sample():
    x = np.random.default_rng(0).integers(0, 1 << 64, 50, dtype=np.uint64)
    tree = simhash.build(x, 100_000, simhash.HALVES[0], 1, 512)
    assert tree.leaves >= 64 and len(simhash.route(tree, x)[0]) >= 50


def test_nothing_is_lost(spark):
    """Rows without an id, or with one id and different text, are documents of their own; only copies go."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(None, texts[0], 1, "k"), (None, texts[1], 2, "k"), (5, texts[2], 3, "k"), (5, texts[3], 4, "k"), (5, texts[3], 4, "k"), (9, texts[0], 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, none int, __key string")
    for module in (simhash, similar):
        kept = module.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(x.none for x in kept.collect()) == [2, 3, 4, 5]


def test_star_contraction(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in simhash.connect(e).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}
