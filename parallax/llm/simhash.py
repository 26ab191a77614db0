"""SimHash near-duplicates, linked exactly with distributed vantage-point trees.

Fingerprints are majorities over hashed word shingles; two of them link if few bits differ. A linked pair differs in at
most half as many bits, rounded down, in one of the two halves of the fingerprint. For each half there is a vantage-point
tree: a node cuts fingerprints by their Hamming distance, in that half, to its vantage point. The trees are built on a bounded
sample; then each distinct fingerprint goes down to its leaf (its home shard), and by the triangle inequality it also asks
every shard across a boundary that may hold a partner, and no other. A shard compares its members with one another and with those that ask, in blocks of
bounded size, and emits links that connect what all its links connect, never all pairs. Links of all shards are joined
into components in rounds with reliable checkpoints.

A crowded shard (dense copies, which no distance tells apart) is not gathered: its members are dealt into pieces that share some
pivots, pieces are linked alone, and then only members outside the shard's largest component are compared with all, piece by piece.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; texts with fewer words than a
shingle are one shingle; repeated rows share a fingerprint; a component is named by its smallest doc_id (null ids count
only where there is no other); an empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, cut, fresh, text_hash

SHINGLE = 3
RADIUS = 3
SEED = 42
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
#: Fingerprints that the trees are built on, at most about; fingerprints of a leaf; leaves of a tree (leaves grow beyond).
SAMPLE, LEAF, LEAVES = 200_000, 512, 1 << 20
#: Members of a shard from which it counts as crowded, as a multiple of a leaf, and rows of a task's group of shards.
CROWD, GROUP_ROWS = 16, 40_000
#: Cells of one comparison, and vantage points that a node tries.
CELLS, TRIES = 1 << 21, 4


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included."""
    import xxhash

    w = text.encode("utf-8", "replace").lower().split() if text else []
    if not w:
        return np.empty(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*[w[k:] for k in range(shingle)])) if len(w) > shingle else iter([b" ".join(w)])
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=max(1, len(w) - shingle + 1))


def majority(h: np.ndarray) -> int:
    """For each bit whether more than half of the hashes have it, as a signed integer."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(hashes(text, shingle))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return own(text)


def hamming(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@dataclass(frozen=True)
class Tree:
    """Nodes: vantage point, cut (inner if at most so far), and both children, as ~number where they are leaves."""

    mask: int
    near: int
    vantage: np.ndarray
    cut: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    leaves: int


def build(sample: np.ndarray, n: int, mask: int, near: int, leaf: int, seed: int = 1) -> Tree:
    """A tree for n fingerprints from a sample of them."""
    rng = np.random.default_rng(seed)
    bits, m = mask.bit_count(), np.uint64(mask)
    vantage, cuts, children = [], [], []
    leaves = 0
    todo = [(sample, float(n), None)]  # a node's sample, how many fingerprints it stands for, and whose child it is
    while todo:
        own, size, parent = todo.pop()
        best = None
        if size > leaf and len(own) >= 16:
            for v in own[rng.integers(0, len(own), TRIES)]:
                hist = np.bincount(hamming(own & m, v & m), minlength=bits + 1 + near)
                inner = np.cumsum(hist)[:bits]
                outer = len(own) - inner
                asks = np.cumsum(hist)[near : bits + near] - inner
                work = (inner.astype(float) ** 2 + outer.astype(float) ** 2 + 2.0 * asks * inner) / len(own) ** 2
                c = int(work.argmin())
                if best is None or work[c] < best[0]:
                    best = (work[c], v, c)
            best = best if best[0] < 0.9 else None
        elif size > leaf:  # too few to measure by: as if bits were drawn at random
            best = (0.5, own[0] if len(own) else rng.integers(0, 1 << 64, dtype=np.uint64), bits // 2)
        if best is None:
            at, leaves = ~leaves, leaves + 1
        else:
            at = len(vantage)
            _, v, c = best
            vantage.append(v)
            cuts.append(c)
            children.append([0, 0])
            near_v = hamming(own & m, v & m) <= c
            share = near_v.mean() if len(own) >= 16 else 0.5
            todo += [(own[near_v], size * share, (at, 0)), (own[~near_v], size * (1 - share), (at, 1))]
        if parent:
            children[parent[0]][parent[1]] = at
    both = np.array(children, dtype=np.int64).reshape(-1, 2)
    return Tree(mask, near, np.array(vantage, dtype=np.uint64), np.array(cuts, dtype=np.int64), both[:, 0], both[:, 1], leaves)


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, leaf, whether it asks there): each fingerprint's home, and the leaves across boundaries that may hold a partner."""
    who, node, asks = np.arange(len(x)), np.full(len(x), 0 if len(tree.vantage) else -1), np.zeros(len(x), dtype=bool)
    found = []
    while len(who):
        ended = node < 0
        found.append((who[ended], ~node[ended], asks[ended]))
        who, node, asks = who[~ended], node[~ended], asks[~ended]
        d = hamming(x[who] & np.uint64(tree.mask), tree.vantage[node] & np.uint64(tree.mask)).astype(np.int64)
        c = tree.cut[node]
        # Both sides keep their own; those just outside ask inside, as pairs across the boundary need one direction only.
        to_inner, to_outer = d <= np.where(asks, c + tree.near, c), d > np.where(asks, c - tree.near, c)
        more = ~asks & (d > c) & (d <= c + tree.near)
        who, asks = np.concatenate([who[to_inner], who[to_outer], who[more]]), np.concatenate([asks[to_inner], asks[to_outer], np.ones(more.sum(), dtype=bool)])
        node = np.concatenate([tree.inner[node[to_inner]], tree.outer[node[to_outer]], tree.inner[node[more]]])
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (who, node, asks)


def spanning(x: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that connect what all links connect: each is compared once with those not reached yet."""
    if len(x) ** 2 <= CELLS:
        i, j = np.nonzero(np.triu(hamming(x[:, None], x[None, :]) <= radius, 1))
        if len(i) <= 8 * len(x):
            return i, j
    left, a, b = np.arange(len(x)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, CELLS // len(left))
            now, front = front[:step], front[step:]
            hits = hamming(x[now, None], x[left][None, :]) <= radius
            got = hits.any(axis=0)
            if got.any():
                new = left[got]
                a.append(now[hits[:, got].argmax(axis=0)])
                b.append(new)
                left, front = left[~got], np.concatenate([front, new])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def shard_links(home: np.ndarray, ask: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard's members with one another and with those that ask, as fingerprints; as few as connect the same."""
    home, ask = np.unique(home), np.unique(ask)
    if not len(home):
        return home, home
    i, j = spanning(home, radius)
    group = _labels(len(home), i, j)
    a, b = [home[i]], [home[j]]
    rows = max(1, CELLS // len(home))
    for at in range(0, len(ask), rows):
        own = ask[at : at + rows]
        p, q = np.nonzero(hamming(own[:, None], home[None, :]) <= radius)
        _, once = np.unique(p * len(home) + group[q], return_index=True)  # one member of each group
        a.append(own[p[once]])
        b.append(home[q[once]])
    return np.concatenate(a), np.concatenate(b)


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(nodes: DataFrame, *, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that connect what all links connect; nodes has distinct ``fp``."""
    spark, n = nodes.sparkSession, nodes.count()
    leaf = max(leaf, n // LEAVES)
    crowd = CROWD * leaf
    part = F.pmod(F.xxhash64("fp"), F.lit(1 << 30))
    # At most about SAMPLE of all.
    sample = nodes.where(part < min(1 << 30, int(SAMPLE / max(1, n) * (1 << 30)))).select("fp").toPandas()["fp"].to_numpy(dtype=np.int64)
    trees = [build(np.sort(sample).view(np.uint64), n, mask, radius // len(HALVES), leaf) for mask in HALVES]
    shared = spark.sparkContext.broadcast(trees)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(x), 10_000):
                for t, tree in enumerate(shared.value):
                    who, shard, asks = route(tree, x[at : at + 10_000])
                    yield pa.record_batch([pa.array(shard * len(HALVES) + t), pa.array(asks), pa.array(x[at + who].view(np.int64))], names=["shard", "asks", "fp"])

    rows = cut(nodes.select("fp").mapInArrow(routed, "shard long, asks boolean, fp long"))
    # As many rows as there are leaves, at most.
    held = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(~F.col("asks")).alias("homes"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = held.where(F.col("homes") > crowd)
    full = crowded.select("shard", F.ceil(F.col("homes") / crowd).alias("pieces")).collect()
    quiet = rows.where(~F.col("shard").isin([r["shard"] for r in full])) if full else rows
    groups = max(1, -(-total // GROUP_ROWS))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_pairs(*shard_links(own.loc[~own["asks"], "fp"].to_numpy().view(np.uint64), own.loc[own["asks"], "fp"].to_numpy().view(np.uint64), radius)) for _, own in pdf.groupby("shard")]
        return pd.concat(out)

    found = quiet.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups))).groupBy("g").applyInPandas(local, "a long, b long")
    if full:
        pieces = spark.createDataFrame([(r["shard"], r["pieces"]) for r in full], "shard long, pieces long")
        found = found.unionByName(crowded_links(rows.join(pieces, "shard"), radius, crowd))
    return found.distinct()


def crowded_links(rows: DataFrame, radius: int, crowd: int) -> DataFrame:
    """(a, b) of shards that are too large for one task; rows: shard, asks, fp, pieces."""
    dealt = rows.where("not asks").withColumn("piece", F.pmod(F.xxhash64("fp"), "pieces"))
    pivots = dealt.groupBy("shard", "piece").agg(F.min("fp").alias("v")).groupBy("shard").agg(F.collect_list("v").alias("pivots"))

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pairs(*shard_links(np.concatenate([np.array(pdf["pivots"].iloc[0], dtype=np.int64), pdf["fp"].to_numpy()]).view(np.uint64), np.empty(0, np.uint64), radius))

    first = cut(dealt.join(pivots, "shard").groupBy("shard", "piece").applyInPandas(alone, "a long, b long").distinct())
    grouped = rows.join(connect(first).withColumnRenamed("node", "fp"), "fp", "left").select("shard", "fp", F.coalesce("root", "fp").alias("root"))
    sizes = grouped.groupBy("shard", "root").agg(F.count("*").alias("c")).groupBy("shard").agg(F.sum("c").alias("n"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most")).where("n > most")
    own = cut(grouped.join(sizes, "shard").select("shard", "fp", "root", F.col("root") != F.col("main"), F.ceil((F.col("n") - F.col("most")) / crowd).alias("p"), F.ceil(F.col("n") / crowd).alias("q")).toDF("shard", "fp", "root", "other", "p", "q"))
    at = F.xxhash64("fp")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    x = own.where("other").select("shard", "fp", "root", F.pmod(at, "p").alias("i"), every("q").alias("j"), F.lit(True).alias("outside"))
    y = own.select("shard", "fp", "root", every("p").alias("i"), F.pmod(at, "q").alias("j"), F.lit(False).alias("outside"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, root, outside = pdf["fp"].to_numpy().view(np.uint64), pdf["root"].to_numpy(), pdf["outside"].to_numpy()
        some, all_ = np.flatnonzero(outside), np.flatnonzero(~outside)
        out, rows_at_once = [], max(1, CELLS // max(1, len(all_)))
        for k in range(0, len(some), rows_at_once):
            now = some[k : k + rows_at_once]
            a, b = np.nonzero((hamming(fp[now, None], fp[all_][None, :]) <= radius) & (root[now, None] != root[all_][None, :]))
            pairs = pd.DataFrame({"r": root[now[a]], "s": root[all_[b]], "a": fp[now[a]].view(np.int64), "b": fp[all_[b]].view(np.int64)})
            out.append(pairs.drop_duplicates(["r", "s"]))  # one link of two groups
        return pd.concat(out)[["a", "b"]] if out else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    return first.unionByName(x.unionByName(y).groupBy("shard", "i", "j").applyInPandas(across, "a long, b long"))


def connect(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an undirected graph the smallest that edges reach, by alternating stars."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: greater neighbours of a node move to its smallest neighbour.
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # Small star: smaller neighbours of a node, and itself, move to the smallest of them.
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("a").alias("x"), "m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        e = cut(small)  # the rounds' plans and shuffle files go as they end, or the driver's heap grows to its limit
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) of each document, and (fp, root, rep): its component and smallest doc_id."""
    bound_batches(docs)
    own = cut(docs.select("doc_id", text_hash(F.col("text")).alias("th"), fingerprints(F.col("text").cast("string"), shingle).alias("fp")))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connect(links(nodes, radius=radius))
    return own, nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")


def components(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fp, component_id."""
    own, named = grouped(docs, shingle, radius)
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, fingerprint (hexadecimal), component_id."""
    found = components(docs, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(own: DataFrame) -> DataFrame:
    """One (doc_id, th) of each component: the smallest id, a null one last, and of equal ids the smallest hash; own: doc_id, th, component."""
    least = own.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("s"))
    return least.select("s.none", F.coalesce("s.doc_id", F.lit(0)).alias("id"), "s.th")


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose id and text are among survivors, each once; columns as they were."""
    none, id_, th = fresh(docs, "none", "id", "th")
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id"), F.lit(0)), th: text_hash(F.col("text"))})
    # The join and the dropping of repeated rows share one dealing of the texts.
    return keyed.join(kept.toDF(none, id_, th), [none, id_, th], "left_semi").dropDuplicates([none, id_, th]).drop(none, id_, th)


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, once; columns as they were.

    The smallest id stays (a null id only where there is no other); of different texts with that id the one with the smallest hash.
    """
    own, by_fp = grouped(docs, shingle, radius)
    return only(docs, survivors(own.join(by_fp, "fp").select("doc_id", "th", F.col("root").alias("component"))))
