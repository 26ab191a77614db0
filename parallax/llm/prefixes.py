"""Prefix trie of conversations.

Each distinct sequence of a conversation's first turns is a node. A prefix has an identity by itself (sums of hashes of
its turns with their places), so that equal conversations fold into one sequence with a count, and prefixes with only
one sequence left are tails: one child after another, whose sums are running sums.

The rest, where sequences share prefixes, goes to double-array tries. Prefixes of at most CROWD sequences are dealt to
shards; each shard packs its sequences' turns, numbered densely, into BASE and CHECK arrays (child = BASE[state] + turn,
valid if CHECK[child] is the state), walks all sequences through them and sums up its nodes. Prefixes of more sequences
lie above all shards: their partial sums from shards are merged, and what lies between them is added along jumps of
1, 2, 4, ... levels.

Defined cases: turns are ordered by number (null first), equal numbers by role and text; null role or text counts as
empty; repeated rows are turns of their own; turns without a conversation's id belong to none and have no node; an
empty table has no nodes, not even a root. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, cut

#: Distinct sequences under one prefix that a shard takes; a prefix of more lies above the shards.
CROWD = 20_000
#: Turns in a shard, on average.
SHARD_TURNS = 20_000
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()
#: The contract's rebuilt conversations: this many share a donor, and up to this many turns less one come from it.
BLOCK, FROM_DONOR = 20, 4


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (of role and text), words; texts go no further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "key", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (the first h of the block's first conversation, then their own after the first h), and all conversations."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % FROM_DONOR
    rows = cut(rows)
    all_of = rows.select("conv_id").distinct()
    donors = rows.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < FROM_DONOR)).withColumnRenamed("conv_id", "donor")  # a few turns of each
    given = all_of.where(h > 0).withColumn("donor", F.col("conv_id") - F.col("conv_id") % BLOCK).join(donors, "donor").where(F.col("pos") <= h)
    return rows.where(F.col("pos") > h).unionByName(given.select(rows.columns)), all_of


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, d, node, parent, key, words: each turn's prefix as 128 bits, from running sums of four parts of 31 bits."""
    order = W.partitionBy("conv_id").orderBy("pos")
    placed = rows.withColumn("d", F.row_number().over(order))
    x, y = F.xxhash64("key", "d"), F.xxhash64(F.lit("second"), "d", "key")
    parts = [v.bitwiseAND(F.lit((1 << 31) - 1)) for x_ in (x, y) for v in (x_, F.shiftrightunsigned(x_, 33))]
    placed = placed.select("conv_id", "pos", "d", "key", "words", *[F.sum(p).over(order).alias(f"s{i}") for i, p in enumerate(parts)])
    placed = placed.withColumn("node", F.unhex(F.md5(F.concat_ws(",", "d", "s0", "s1", "s2", "s3").cast("binary"))))
    return placed.select("conv_id", "d", "node", F.lag("node", 1, ROOT).over(order).alias("parent"), "key", "words")


def _sequences(ends: DataFrame) -> DataFrame:
    """Distinct sequences from each conversation's last node and length: rep (smallest conv_id), n, len, sha. Ids are streamed in order, one node after another."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rep, n, length, digest = None, 0, 0, 0, hashlib.sha256()
        for pdf in batches:
            nodes = pdf["node"].map(bytes).to_numpy()
            ids, lengths = pdf["conv_id"].to_numpy(), pdf["len"].to_numpy()
            bounds = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)] if len(nodes) else []
            out = []
            for a, b in zip(bounds, bounds[1:]):
                if nodes[a] != now:
                    if n:
                        out.append((rep, n, length, digest.hexdigest()))
                    now, rep, n, length, digest = nodes[a], int(ids[a]), 0, int(lengths[a]), hashlib.sha256()
                digest.update((("," if n else "") + ",".join(map(str, ids[a:b].tolist()))).encode())
                n += b - a
            yield pd.DataFrame(out, columns=["rep", "n", "len", "sha"])
        if n:
            yield pd.DataFrame([(rep, n, length, digest.hexdigest())], columns=["rep", "n", "len", "sha"])

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInPandas(fold, "rep long, n long, len int, sha string")


class DoubleArray:
    """BASE and CHECK over states; state 0 is the root, symbols are numbers from 1."""

    def __init__(self) -> None:
        self.base, self.check, self.free = np.zeros(1024, dtype=np.int64), np.full(1024, -1, dtype=np.int64), 1
        self.check[0] = 0

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.r_[self.base, np.zeros(more, dtype=np.int64)], np.r_[self.check, np.full(more, -1, dtype=np.int64)]

    def add(self, state: int, symbols: np.ndarray) -> None:
        """Place all children of a state, by sorted symbols: at the first of some free places that suits all, else behind all others."""
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        place = max(self.free, int(symbols[0]))
        for _ in range(32):
            self._room(place - int(symbols[0]) + int(symbols[-1]) + 1)
            if (self.check[place - symbols[0] + symbols] < 0).all():
                break
            place += 1
        else:
            place = int(np.flatnonzero(self.check >= 0)[-1]) + 1
            place = max(place, int(symbols[0]))
            self._room(place - int(symbols[0]) + int(symbols[-1]) + 1)
        self.base[state] = place - int(symbols[0])
        self.check[self.base[state] + symbols] = state

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of states by symbols; -1 where there is none."""
        at = self.base[states] + symbols
        found = np.minimum(at, len(self.check) - 1)
        return np.where((at == found) & (self.check[found] == states) & (at > 0), at, -1)


def walked(seq: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """A double array of all sequences, and the state of each row; rows are sorted by depth from 1, without gaps in a sequence."""
    trie, state, out = DoubleArray(), np.zeros(seq.max(initial=-1) + 1, dtype=np.int64), np.zeros(len(seq), dtype=np.int64)
    bounds = [0, *(np.flatnonzero(depth[1:] != depth[:-1]) + 1).tolist(), len(depth)]
    for a, b in zip(bounds, bounds[1:]):
        here, own = state[seq[a:b]], symbol[a:b]
        pairs = np.unique(np.stack([here, own]), axis=1)
        first = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]]) if pairs.shape[1] else []
        for i, j in zip(first, [*first[1:], pairs.shape[1]]):
            trie.add(int(pairs[0, i]), pairs[1, i:j])
        out[a:b] = state[seq[a:b]] = trie.step(here, own)
    return trie, out


_NODE = "node binary, parent binary, depth long, words long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, upper boolean"


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard. Those above shards get partial sums: of members here, and of what lies below children that are here only."""
    pdf = pdf.sort_values(["d", "rep"], kind="stable")
    seq, symbol, d = pd.factorize(pdf["rep"])[0], pd.factorize(pdf["key"].map(bytes))[0] + 1, pdf["d"].to_numpy()
    trie, state = walked(seq, d, symbol)
    size = len(trie.check)
    used, first = np.unique(state, return_index=True)
    rows = pdf.iloc[first]
    n, conv = np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(n, state, pdf["n"].to_numpy())
    np.minimum.at(conv, state, pdf["rep"].to_numpy())
    per_seq = pdf.drop_duplicates("rep")
    n[0], conv[0] = per_seq["n"].sum(), per_seq["rep"].min()
    upper, depth, words, alone = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    upper[0] = True
    upper[used], depth[used], words[used], alone[used] = rows["upper"], rows["d"], rows["words"], ~rows["shared"]
    below = used[~upper[used]]
    children = np.bincount(trie.check[below], minlength=size)
    longer = np.zeros(size, dtype=bool)
    longer[used] = ~rows["shared"].to_numpy() & (rows["d"] < rows["len"]).to_numpy()
    children += longer
    leaves, saved = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    leaves[below] = alone[below] | (children[below] == 0)
    saved[used] = np.where(rows["shared"], (n[used] - 1) * words[used], rows["tail_saved"])
    saved[upper] = 0
    by_depth = below[np.argsort(-depth[below], kind="stable")]
    bounds = [0, *(np.flatnonzero(np.diff(depth[by_depth])) + 1).tolist(), len(by_depth)]
    for a, b in zip(bounds, bounds[1:]):
        level = by_depth[a:b]
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])
    ended = pd.Series(pdf["sha"].to_numpy()).groupby(state).first()  # one sequence ends at a node at most
    out = pd.DataFrame({"node": rows["node"].to_numpy(), "parent": rows["parent"].to_numpy(), "sha": ended.reindex(used).to_numpy()})
    at = used
    if len(pdf):
        out = pd.concat([out, pd.DataFrame([{"node": ROOT, "parent": None, "sha": None}])], ignore_index=True)
        at = np.r_[used, 0]
    up = trie.check[at]
    return pd.DataFrame({
        "node": out["node"], "parent": out["parent"], "depth": depth[at], "words": words[at], "conv_id": conv[at],
        "parent_conv_id": pd.array(conv[up], dtype="Int64").astype(object) if not len(at) else pd.Series(np.where(upper[up], None, conv[up].astype(object)), dtype="object"),
        "n_convs": n[at], "n_children": children[at], "n_leaves": leaves[at], "saved_tokens": saved[at], "ends_sha256": out["sha"].where(out["sha"].notna(), None), "upper": upper[at],
    })


def _below(top: DataFrame) -> DataFrame:
    """leaves and saved of each row plus those of all rows under it; top: node, parent, leaves, saved. Jumps double, so that rounds are the logarithm of the depth."""
    now = cut(top.withColumn("jump", F.col("parent")))
    while not now.where("jump is not null").isEmpty():
        gained = now.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = now.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        now = now.join(gained, "node", "left").join(further, "jump", "left")
        now = cut(now.select("node", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("jump")))
    return now.select("node", "leaves", "saved")


def nodes(rows: DataFrame, all_of: DataFrame, *, crowd: int = CROWD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of a trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, pos, key, words; all_of: every conv_id, those without rows too.
    """
    bound_batches(rows)
    spark = rows.sparkSession
    path = cut(_paths(rows))
    last = path.groupBy("conv_id").agg(F.max("d").alias("len"), F.max_by("node", "d").alias("node"))
    ends = all_of.join(last, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("node", F.lit(ROOT)).alias("node"))
    seqs = cut(_sequences(ends))
    own = path.join(seqs.withColumnRenamed("rep", "conv_id"), "conv_id").withColumnRenamed("conv_id", "rep")
    many = path.join(seqs.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
    own = own.join(many, "node", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    order = W.partitionBy("rep").orderBy("d")
    rest = order.rowsBetween(0, W.unboundedFollowing)
    own = own.select(
        "rep", "d", "node", "parent", "key", "words", "n", "len", (F.col("c") > 1).alias("shared"), (F.col("c") > crowd).alias("upper"),
        F.when(F.col("d") == F.col("len"), F.col("sha")).alias("sha"), ((F.col("n") - 1) * F.sum("words").over(rest)).alias("tail_saved"),
        F.lag(F.col("c") > 1, 1, True).over(order).alias("branching"),
        # the first prefix of few enough sequences, or the last if there is none
        F.coalesce(F.min(F.when(F.col("c") <= crowd, F.struct("d", "node"))).over(W.partitionBy("rep").orderBy("d").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["node"], F.last("node").over(rest)).alias("home"),
    )
    own = cut(own)
    packed = own.where("branching")
    shards = max(1, -(-packed.count() // shard_turns))
    dealt = packed.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards))).drop("home", "branching")
    found = cut(dealt.groupBy("shard").applyInPandas(_shard, _NODE))
    # Above the shards: partial sums meet; the root also has the conversations without turns.
    bare = seqs.where("len = 0").select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.col("sha").alias("ends_sha256"))
    partial = found.where("upper").select(bare.columns).unionByName(bare)
    top = partial.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    inner = top.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("m"))
    top = cut(top.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("m", F.lit(0))))
    mine = top.select("node", "parent", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    over = top.select(F.col("node").alias("parent"), F.col("conv_id").alias("over"))
    sha = F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    top = top.join(_below(mine), "node").join(over, "parent", "left").select("conv_id", "depth", F.col("over").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), sha)
    private = found.where("not upper").join(over, "parent", "left").select("conv_id", "depth", F.coalesce("parent_conv_id", "over").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", sha)
    tails = own.where("not branching").select(F.col("rep").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("tail_saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))
    return private.unionByName(tails).unionByName(top)


def trie(conversations: DataFrame, **limits: int) -> DataFrame:
    """Nodes of the conversations as they are."""
    rows = cut(turns(conversations))
    return nodes(rows, rows.select("conv_id").distinct(), **limits)


def report(conversations: DataFrame, **limits: int) -> DataFrame:
    """Nodes of the rebuilt conversations."""
    return nodes(*rebuilt(turns(conversations)), **limits)


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII signs in SQL, bit by bit; the polynomial and the start are the checksum's."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda j: (ascii(ch)::bigint >> j::int) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda x, bit: xor(x >> 1, 3988292384 * xor(x & 1, bit))), 4294967295)"


#: The same by SQL.
ORACLE_SQL = rf"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, k) as pos, k, words
  from (select conv_id, turn, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null)),
convs as (select conv_id, {_crc32("conv_id::varchar")} % 4 as h from (select distinct conv_id from own)),
re as (
  select c.conv_id, o.pos, o.k, o.words from convs c join own o on o.conv_id = c.conv_id - c.conv_id % 20 and o.pos <= c.h
  union all select c.conv_id, o.pos, o.k, o.words from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h),
paths as (
  select conv_id, row_number() over w as d, string_agg(k, '') over w as p, words from re window w as (partition by conv_id order by pos rows unbounded preceding)
  union all select conv_id, 0, '', 0 from convs),
ended as (select p, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from (select conv_id, max_by(p, d) as p from paths group by conv_id) group by p),
node as (select d, p, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words, case when d > 0 then p[1:32 * (d - 1)] end as up from paths group by d, p),
kids as (select up as p, count(*) as n_children from node where up is not null group by up),
full_node as (select node.*, coalesce(n_children, 0) as n_children, coalesce(ends, sha256('')) as ends from node left join kids using (p) left join ended using (p)),
under as (select v.p, count(*) filter (u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.words) as saved from full_node v join full_node u on u.d >= v.d and starts_with(u.p, v.p) group by v.p)
select v.conv_id, v.d as depth, w.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved::bigint as saved_tokens, v.ends as ends_sha256
from full_node v join under using (p) left join node w on w.p = v.up
"""
