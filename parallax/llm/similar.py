"""Near copies by exact similarity of word shingles, on top of SimHash links.

Fingerprints of the shingles are linked by the vantage-point trees of ``simhash``; each link between two texts, and each text with
the fingerprint of another, is then verified on the shingle sets themselves, and what holds is joined into components.

Few differing bits find only part of the pairs that share the asked-for part of their shingles. A second part makes the components
complete. Two texts as similar as asked share a shingle among the first few of each, in any
one order of shingles (prefixes; common shingles come last). Texts of different components that meet in a bucket of such a
shingle are verified exactly, neighbours by size first, until no pair across components is left: the result is
that of comparing all texts with all others.

Defined cases: null, empty and blank texts have no shingles and count as copies of one another; texts with fewer words
than a shingle are one shingle; equal texts and repeated rows are one node; a component is named by its smallest doc_id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, cut, text_hash
from parallax.llm.simhash import RADIUS, connect, hashes, links, majority, only, survivors

SHINGLE, SIMILARITY = 5, 0.8
#: Texts of which shingles are counted to put common ones last (one in so many, but so many at least), and shingles so counted; they
#: change the work, never the result.
ONE_IN, COUNTED, COMMON = 8, 8000, 100_000
#: Neighbours in a bucket that the first round of the second part compares, how many times farther each next one looks, and pairs
#: across components, for each text, up to which all are compared at once.
SPAN, FARTHER, AT_ONCE = 4, 64, 1
#: Bins of the counts that tell pairs apart before their texts are fetched.
BINS = 256
#: Longs of the parities that tell pairs apart where they meet in a bucket.
LONGS = 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(hashes(text, shingle))


def binned(distinct: np.ndarray) -> bytes:
    """How many of the hashes fall into each of BINS; counts end at 255."""
    return np.minimum(np.bincount((distinct % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def parities(distinct: np.ndarray) -> np.ndarray:
    """The hashes as bits in LONGS longs, each the parity of those that fall on it: sets differ in no fewer hashes than bits."""
    odd = np.bincount((distinct % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows of bin counts allow a similarity: two sets share no more than the smaller count of each bin."""
    common, both = np.minimum(a, b).sum(axis=1, dtype=np.int64), a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
    return (common >= similarity * (both - common) - 1e-9) | (a == 255).any(axis=1) | (b == 255).any(axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of texts to be verified; nodes: node, fp. Texts of one fingerprint go with the first of them."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    same = nodes.join(heads.where("n > 1"), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    by = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = links(heads, radius=radius).join(by("a"), "a").join(by("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    both = same.unionByName(near)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by count and hash, of which texts as similar as asked share one; common: sorted hashes, with their counts."""
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    length = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if not len(common):
        return hashes[:length]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    seen = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, seen))[:length]]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text_hash(F.col("text")).alias("th"), text.alias("t"))


def _common(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several of a few texts, sorted, and in how many texts they are."""

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle).view(np.int64) for t in texts])

    some = _texts(docs).where(F.pmod(F.xxhash64("th"), F.lit(max(1, min(ONE_IN, n // COUNTED)))) == 0).groupBy("th").agg(F.first("t").alias("t"))
    counted = some.select(F.explode(hashed("t")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    most = counted.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, seen = most["h"].to_numpy(dtype=np.int64).view(np.uint64), most["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], seen[order]


def _buckets(docs: DataFrame, named: DataFrame, n: int, shingle: int, similarity: float) -> DataFrame:
    """key, node, size, at, pos: texts by the shingles of their prefixes, with the shingle's place there, in order of size; named: th, node, root.

    Only buckets that hold several components, and of buckets with the same texts only the first: what two texts share first lies
    in a bucket before which none has the same texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, n, shingle))

    @F.pandas_udf("size int, keys array<long>")
    def prefixed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            hashes = [shingle_hashes(t, shingle) for t in texts]
            yield pd.DataFrame({"size": np.array([len(h) for h in hashes], dtype=np.int32), "keys": [prefix(h, similarity, *shared.value).view(np.int64) for h in hashes]})

    once = _texts(docs).select("th", prefixed("t").alias("p")).groupBy("th").agg(F.first("p").alias("p"))
    dealt = once.join(named, "th").select(F.posexplode("p.keys").alias("at", "key"), "node", F.col("p.size").alias("size"), "root")
    bucket = W.partitionBy("key")
    mixed = cut(dealt.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).where("low <> high").select("key", "node", "size", "at"))
    # Two hashes of 64 bits stand for a set of texts; places grow from each bucket of a set to the next, for all of its texts alike.
    held = mixed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("at").alias("places"))
    first = held.groupBy("n", "x", "y").agg(F.min_by("key", F.struct("places", "key")).alias("key")).select("key")
    return mixed.join(first, "key", "left_semi").withColumn("pos", F.row_number().over(bucket.orderBy("size", "node")))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b, ...) of texts that are as similar as asked; nodes: th, node, bins. Texts are fetched only for pairs that bins do not tell apart."""

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = [np.frombuffer(b"".join(map(bytes, c)), dtype=np.uint8).reshape(-1, BINS) for c in (x, y)]
        return pd.Series(may_be_alike(*rows, similarity))

    by = lambda c: nodes.select(F.col("node").alias(c), F.col("bins").alias(f"bins_{c}"))
    pairs = cut(pairs.join(by("a"), "a").join(by("b"), "b").where(possible("bins_a", "bins_b")).select(*pairs.columns))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = nodes.select("th", "node").join(wanted, "node", "left_semi")
    texts = cut(_texts(docs).join(named, "th").groupBy("node").agg(F.first("t").alias("t")))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        known = {t: shingle_hashes(t, shingle) for t in {*x, *y}}
        return pd.Series([jaccard(known[s], known[t]) >= similarity for s, t in zip(x, y)], dtype=bool)

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b")
    return both.where(alike("x", "y")).select(*pairs.columns)


def completed(docs: DataFrame, nodes: DataFrame, roots: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) in which every two texts as similar as asked have one root; nodes: th, node, bins, odd; roots: node, root, joined of such texts only.

    Each round compares neighbours by size within the buckets, farther ones than the round before, and joins what is alike. As soon
    as few enough pairs across components are left in all, they are compared at once.
    """
    n = roots.count()
    dealt = _buckets(docs, nodes.select("th", "node").join(roots, "node"), n, shingle, similarity)
    dealt = cut(dealt.join(nodes.select("node", "odd"), "node"))  # only what is left in buckets carries parities
    span, before, sides = SPAN, 0, ("node", "size", "at", "pos", "root", "odd")
    while True:
        live = dealt.join(roots, "node")
        held = live.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max_by("root", F.struct("c", "root")).alias("main")).where("n * n > same")
        held = cut(held)
        left, most = held.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.max("n")).first()
        if not left:
            return roots
        live = live.join(held.select("key", "main"), "key")
        x, y = live.select("key", *[F.col(c).alias(f"{c}_a") for c in sides], "main"), live.select("key", *[F.col(c).alias(f"{c}_b") for c in sides])
        apart = F.abs(F.col("pos_a") - F.col("pos_b"))
        last = left <= AT_ONCE * n or span >= most
        if last:  # each pair across components has a side outside its bucket's largest one
            met = x.where("root_a <> main").join(y, "key").where(apart > before)
        else:
            block = F.floor(F.col("pos_a") / span)
            met = x.withColumn("k", F.explode(F.array(block, block + 1))).join(y.withColumn("k", F.floor(F.col("pos_b") / span)), ["key", "k"]).where((F.col("pos_b") > F.col("pos_a")) & (apart > before) & (apart <= span))
        # Sets of which one is smaller than the share asked of the other cannot be alike.
        close = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6
        # The first shingle that alike texts share has enough shingles behind it in both; they may fail at what they share later.
        close &= F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
        # Alike sets differ in so few shingles, and so in no more bits of their parities.
        apart_bits = reduce(lambda m, n: m + n, [F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(LONGS)])
        close &= apart_bits <= (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-6
        order = F.col("node_a") < F.col("node_b")
        pick = lambda c, d: F.when(order, F.col(c)).otherwise(F.col(d))
        pairs = cut(met.where("root_a <> root_b").where(close).select(pick("node_a", "node_b").alias("a"), pick("node_b", "node_a").alias("b"), pick("root_a", "root_b").alias("p"), pick("root_b", "root_a").alias("q")).distinct())
        links = cut(_verified(docs, nodes, pairs, shingle, similarity).select("p", "q").distinct())
        if not links.isEmpty():
            joined = connect(links.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
            roots = cut(roots.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        if last:
            return roots
        span, before = FARTHER * span, span


def grouped(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, th, component (some name of it)."""
    bound_batches(docs)

    @F.pandas_udf("fp long, bins binary, odd array<long>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = [hashes(t, shingle) for t in texts]
            sets = [np.unique(h) for h in own]
            yield pd.DataFrame({"fp": np.array([majority(h) for h in own], dtype=np.int64), "bins": [binned(h) for h in sets], "odd": [parities(h) for h in sets]})

    own = cut(docs.select("doc_id", text_hash(F.col("text")).alias("th"), sketched(F.col("text").cast("string")).alias("s")).select("doc_id", "th", "s.*"))
    # Numbers of the distinct texts, short in pairs and buckets; they hold as the table is written before it is read.
    nodes = cut(own.groupBy("th").agg(F.first(F.struct("fp", "bins", "odd")).alias("s")).select("th", "s.*", F.monotonically_increasing_id().alias("node")))
    roots = connect(_verified(docs, nodes, cut(edges(nodes)), shingle, similarity)).withColumnRenamed("root", "to")
    first = cut(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("to", "node").alias("root")))
    named = nodes.select("th", "node").join(completed(docs, nodes, first, shingle=shingle, similarity=similarity), "node")
    return own.select("doc_id", "th").join(named.select("th", F.col("root").alias("component")), "th").select("doc_id", "th", "component")


def components(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, component_id."""
    own = cut(grouped(docs, shingle, similarity))
    lowest = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return own.join(lowest, "component").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, once, chosen as ``simhash.keep_one`` does; columns as they were."""
    return only(docs, survivors(grouped(docs, **options)))
