"""Sharding by minimax contiguous partition.

Equal texts are one atomic group; groups are ordered by the digest of their text. A shard is a run of groups, and
the shards' capacity is the smallest that lets a greedy pass over the ordered sizes end within the given number of
shards. That capacity is found by a search whose checks are greedy passes over running sums of the group sizes: the
sums stay in a stored table, of which the driver holds one sum for each of 65,536 buckets of digests and the groups of
the few windows in which the cuts can lie at all. Cuts are digests, so that a document finds its shard by comparing its
own digest with them, without a join.

Where the capacity leaves some freedom (one group may be larger than an even share), cuts move towards even shares.

Defined cases: a null text has no bytes and goes with the empty text; repeated rows are documents of their own, in
one shard, with slots of their own; null ids are numbered like any; fewer groups than shards leave shards empty; an
empty table gives no rows. Columns other than those named are ignored by ``report`` and kept by ``place``, whatever
their names.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.llm.common import checkpoint_folder, cut, fresh, remove_folder, text_hash

SHARDS = 8
#: Digests are dealt into this many buckets by their first BUCKET_BITS bits; the driver holds one sum for each.
BUCKET_BITS = 16
#: Capacities checked in one greedy pass of Spark jobs, and rows of groups that the driver may hold to check the rest itself.
AT_ONCE, HOLD = 512, 50_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one for the document itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _bucket(digest: Column, bits: int) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, bits // 4), 16, 10).cast("int")


class Place(NamedTuple):
    """The end of a group in the order of digests: bytes up to there, and a digest that no later group is at or below."""

    upto: int
    digest: bytes = b""


class Sums:
    """Running sums of ordered group sizes: totals of buckets on the driver, sums within buckets in a stored table."""

    def __init__(self, groups: DataFrame, folder: str, *, bits: int = BUCKET_BITS):
        """groups: digest, size; one row for each group."""
        dealt = groups.withColumn("bucket", _bucket(F.col("digest"), bits))
        dealt.withColumn("upto", F.sum("size").over(W.partitionBy("bucket").orderBy("digest"))).write.parquet(folder)
        self.table, self.bits, self.held = groups.sparkSession.read.parquet(folder), bits, {}
        rows = sorted(self.table.groupBy("bucket").agg(F.sum("size"), F.max("size"), F.count("*")).collect())  # at most 2 ** bits
        self.buckets, self.counts, self.largest = [r[0] for r in rows], [r[3] for r in rows], max((r[2] for r in rows), default=0)
        self.starts = [0, *itertools.accumulate(r[1] for r in rows)]
        self.total = self.starts.pop()

    def within(self, at: int) -> int:
        """Index of the bucket in which a place below the total lies."""
        return bisect.bisect_right(self.starts, at) - 1

    def start(self, k: int) -> Place:
        """Where bucket k begins."""
        return Place(self.starts[k], (self.buckets[k] << (16 - self.bits)).to_bytes(2, "big"))

    def coarse(self, at: int) -> Place:
        """The last bound of buckets at or below a place."""
        return self.end if at >= self.total else self.start(self.within(at))

    @property
    def end(self) -> Place:
        return Place(self.total, b"\xff" * 17)

    def hold(self, windows: list[tuple[int, int]], most: int) -> bool:
        """Fetch the groups of all buckets that the windows touch, if they are no more than ``most``; whether they were."""
        touched = sorted({k for a, b in windows for k in range(self.within(min(a, self.total - 1)), self.within(min(b, self.total - 1)) + 1)})
        if sum(self.counts[k] for k in touched) > most:
            return False
        index = {self.buckets[k]: k for k in touched}
        self.held = {k: [self.start(k)] for k in touched}
        for r in self.table.where(F.col("bucket").isin(list(index))).select("bucket", "upto", "digest").sort("bucket", "upto").collect():
            k = index[r.bucket]
            self.held[k].append(Place(self.starts[k] + r.upto, bytes(r.digest)))
        return True

    def below(self, targets: list[int]) -> list[Place]:
        """The last end of a group at or below each target."""
        out, asked = {}, {}
        for t in set(targets):
            if t >= self.total:
                out[t] = self.end
            elif (k := self.within(t)) in self.held:
                out[t] = self.held[k][bisect.bisect_right(self.held[k], (t, b"\xff" * 17)) - 1]
            else:
                asked[t] = k
        if asked:
            wanted = F.broadcast(self.table.sparkSession.createDataFrame([(t, self.buckets[k], t - self.starts[k]) for t, k in asked.items()], "t long, b int, x long"))  # at most AT_ONCE rows
            near = self.table.where(F.col("bucket").isin(sorted({self.buckets[k] for k in asked.values()}))).join(wanted, F.col("bucket") == F.col("b"))
            for r in near.where("upto <= x").groupBy("t").agg(F.max(F.struct("upto", "digest")).alias("p")).collect():
                out[r.t] = Place(self.starts[asked[r.t]] + r.p.upto, bytes(r.p.digest))
            out |= {t: self.start(k) for t, k in asked.items() if t not in out}
        return [out[t] for t in targets]


def greedy(below: Callable[[list[int]], list[Place]], capacities: list[int], total: int, shards: int) -> list[list[Place]]:
    """Ends of the shards that a greedy pass fills with each capacity; the capacity suffices if the last end is the total."""
    ends: list[list[Place]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        for own, place in zip(ends, below([min(a + c, total) for a, c in zip(at, capacities)])):
            own.append(place)
        at = [own[-1].upto for own in ends]
    return ends


def smallest(low: int, high: int, enough: Callable[[int], bool]) -> int:
    """Binary search for the first capacity that suffices; high does."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return high


def capacity(sums: Sums, shards: int, *, at_once: int = AT_ONCE, hold: int = HOLD) -> int:
    """The smallest capacity of a shard with which a greedy pass ends within so many shards.

    Bounds of buckets alone give a capacity that suffices. Between it and what is needed at least, cuts can only lie in
    windows of the running sums; Spark narrows these, many capacities in a pass, until the driver may hold their groups.
    """
    low = max(sums.largest, -(-sums.total // shards))
    suffices = lambda below: lambda c: greedy(below, [c], sums.total, shards)[0][-1].upto >= sums.total
    coarse = lambda targets: [sums.coarse(t) for t in targets]
    high = smallest(low, -(-sums.total // shards) + sums.largest, suffices(coarse))  # no shard of that upper bound closes below an even share
    first, last = (greedy(coarse, [low], sums.total, shards)[0], [Place(min((k + 1) * high, sums.total)) for k in range(shards)])
    while low < high:
        if sums.hold([(a.upto, b.upto) for a, b in zip(first, last)], hold):
            return smallest(low, high, suffices(sums.below))
        tried = list(range(low, high, -(-(high - low) // at_once)))
        passes = greedy(sums.below, tried, sums.total, shards)
        k = next((k for k, ends in enumerate(passes) if ends[-1].upto >= sums.total), len(tried))
        if k:
            low, first = tried[k - 1] + 1, passes[k - 1]
        if k < len(tried):
            high, last = tried[k], passes[k]
    return high


def cuts(sums: Sums, shards: int, **limits: int) -> list[Place]:
    """Ends of all shards but the last. No shard is over the smallest capacity.

    From the last to the first, a greedy pass's cut moves to the bound of buckets that is nearest to an even share of
    what lies before, if the shard after it stays within the capacity.
    """
    most = capacity(sums, shards, **limits)
    found, after = [], sums.end
    for k, place in reversed(list(enumerate(greedy(sums.below, [most], sums.total, shards)[0][:-1]))):
        even = after.upto * (k + 1) // (k + 2)
        near = [place, after, sums.coarse(even), *([sums.start(i)] if even < sums.total and (i := sums.within(even) + 1) < len(sums.starts) else [])]
        allowed = [p for p in near if after.upto - most <= p.upto <= min(place, after).upto]
        after = min(allowed, key=lambda p: (p.upto == after.upto, abs(p.upto - even)))  # no empty shard where there is a choice
        found.append(after)
    return found[::-1]


def plan(docs: DataFrame, *, shards: int = SHARDS, text: str = "text") -> list[bytes]:
    """Digests at which all shards but the last end."""
    keyed = docs.select(text_hash(F.col(text)).alias("digest"), size_of(F.col(text)).alias("size"))
    return _planned(keyed, shards)


def _planned(keyed: DataFrame, shards: int) -> list[bytes]:
    if shards < 1:
        raise ValueError("there must be a shard")
    folder = f"{checkpoint_folder(keyed.sparkSession)}/shards-{uuid.uuid4().hex}"
    try:
        sums = Sums(keyed.groupBy("digest").agg(F.sum("size").alias("size")), folder)
        return [p.digest for p in cuts(sums, shards)] if sums.total else [b""] * (shards - 1)
    finally:
        remove_folder(keyed.sparkSession, folder)


def _shard(digest: Column, ends: list[bytes]) -> Column:
    return sum((F.when(digest > F.lit(e), 1).otherwise(0) for e in ends), F.lit(0)).cast("int")


def place(docs: DataFrame, ends: list[bytes], *, text: str = "text", column: str = "shard") -> DataFrame:
    """docs with the shard of each document, in place; ends come from ``plan``."""
    (column,) = fresh(docs, column)
    return docs.withColumn(column, _shard(text_hash(F.col(text)), ends))


def write(docs: DataFrame, path: str, *, shards: int = SHARDS, text: str = "text") -> None:
    """docs as Parquet, a folder for each shard."""
    placed = place(docs, plan(docs, shards=shards, text=text), text=text)
    placed.write.partitionBy(placed.columns[-1]).parquet(path)


def numbered(rows: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """rows (a checkpoint or a table, whose partitions stay as they are) numbered from 0 without gaps for each value of ``by``.

    Rows are numbered within their partition; what comes before it is a running sum over one count for each partition.
    """
    pid, n, before = fresh(rows, "part", "n", "before")
    rows = rows.withColumn(pid, F.spark_partition_id())
    counts = rows.groupBy(by, pid).agg(F.count("*").alias(n))
    running = W.partitionBy(by).orderBy(pid).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(by, pid, F.coalesce(F.sum(n).over(running), F.lit(0)).alias(before))
    own = rows.withColumn(column, (F.row_number().over(W.partitionBy(by, pid).orderBy(*order)) - 1).cast("long"))
    return own.join(starts, [by, pid]).withColumn(column, F.col(column) + F.col(before)).drop(pid, before)


def report(docs: DataFrame, *, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shard and slot of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), size_of(F.col(text)).alias("size"), F.crc32(body).alias("text_crc32"), text_hash(F.col(text)).alias("digest")))
    placed = keyed.withColumn("shard", _shard(F.col("digest"), _planned(keyed.select("digest", "size"), shards)))
    out = numbered(placed, "shard", ["digest", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
