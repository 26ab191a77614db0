"""Ranked lexical search of many queries at once, with shared parts evaluated once.

A query's score of a document is a sum of contributions of its terms, and these do not depend on the query. So queries
become sets of terms (a term that occurs several times is in a set of weight 1, 2, 4, ..., one for each bit of its
count), and sets that queries share are mined: terms that occur in the same sets are one node, and the pair of nodes
that most sets have in common becomes a node of its own, again and again. Nodes form a graph in which each is the sum of
its parts. For each batch of documents every node's accumulator is computed once and combined along the graph.

Documents are read twice in effect: their counts of query terms are written once as short arrays, from which
document frequencies come and which the scoring pass reads. Each task keeps the best documents of each query so far, so
that only those are shuffled; no pair of a query with each of its documents leaves a task.

Defined cases: a null or wordless document counts for nothing and is never returned; a wordless query has no rows; each
row of the queries is ranked on its own, equal ones too; repeated documents are ranked each; null ids come last among
equal scores; empty tables give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, cut, sub_batches

TOP = 20
#: Bytes of query text in one block; each block scans the documents in passes of its own.
MAX_BLOCK_BYTES = 4 << 20
#: Parts of one set that are mined together; longer sets are mined in pieces.
PIECE = 512
#: A pair of nodes is worth a node of its own in so many sets: with two, as much would be added up as before.
SHARED = 3
#: Bytes of accumulators in a task at once, and bytes of a text that are split into terms at once.
MAX_CELLS_BYTES, CHUNK = 32 << 20, 1 << 20
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text: runs of ASCII letters and digits (lower-cased) and of all signs beyond ASCII, some at a time."""
    body = text.encode("utf-8", "replace").translate(_KEEP) if text else b""
    at = 0
    while at < len(body):
        end = body.find(b" ", at + CHUNK) if len(body) - at > CHUNK else len(body)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def counted(text: str | None) -> Counter[bytes]:
    total: Counter[bytes] = Counter()
    for some in pieces(text):
        total.update(some)
    return total


class Graph:
    """Sets of queries as sums of shared nodes.

    Nodes 0 to n_terms - 1 are terms. ``sums`` lists the nodes after them, parts before wholes, and ``queries`` for each
    query the nodes that it adds up, with their weights.
    """

    def __init__(self, queries: list[dict[int, int]], n_terms: int):
        """queries: for each its terms with their counts."""
        self.n_terms, self.sums = n_terms, []
        bits: list[tuple[int, int, list[int]]] = []  # query, weight, sorted terms
        for q, counts in enumerate(queries):
            for j in range(max(counts.values(), default=0).bit_length()):
                own = sorted(t for t, n in counts.items() if n >> j & 1)
                bits.extend((q, 1 << j, own[i : i + PIECE]) for i in range(0, len(own), PIECE))
        users: dict[int, list[int]] = defaultdict(list)
        for k, (_, _, own) in enumerate(bits):
            for t in own:
                users[t].append(k)
        together: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t, sets in users.items():
            together[tuple(sets)].append(t)
        sets: list[set[int]] = [set() for _ in bits]
        for where, terms in together.items():
            node = terms[0] if len(terms) == 1 else self._add(terms)
            for k in where:
                sets[k].add(node)
        self._mine(sets)
        self.queries: list[list[tuple[int, int]]] = [[] for _ in queries]
        whole: dict[frozenset[int], int] = {}
        for (q, weight, _), own in zip(bits, sets):
            key = frozenset(own)
            if key not in whole:
                whole[key] = next(iter(own)) if len(own) == 1 else self._add(sorted(own))
            self.queries[q].append((whole[key], weight))

    def _add(self, parts: list[int]) -> int:
        self.sums.append(parts)
        return self.n_terms + len(self.sums) - 1

    def _mine(self, sets: list[set[int]]) -> None:
        """Replace the pair of nodes that most sets share by a node of its own, while SHARED sets have one in common."""
        users: dict[tuple[int, int], set[int]] = defaultdict(set)
        shared = Counter(x for own in sets for x in own)
        for k, own in enumerate(sets):
            for pair in combinations(sorted(x for x in own if shared[x] > 1), 2):
                users[pair].add(k)
        users = defaultdict(set, {p: ks for p, ks in users.items() if len(ks) >= SHARED})
        heap = [(-len(ks), p) for p, ks in users.items()]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            ks = users[pair]
            if len(ks) != -n:  # changed since; its present count has an entry of its own
                continue
            node, here = self._add(list(pair)), sorted(ks)
            changed: set[tuple[int, int]] = set()
            for k in here:
                own = sets[k]
                own.difference_update(pair)
                for x in own:
                    for old in pair:
                        p = (min(x, old), max(x, old))
                        if k in users.get(p, ()):
                            users[p].discard(k)
                            changed.add(p)
            others: dict[int, list[int]] = defaultdict(list)
            for k in here:
                for x in sets[k]:
                    others[x].append(k)
                sets[k].add(node)
            for x, at in others.items():
                if len(at) >= SHARED:
                    users[x, node] = set(at)
                    changed.add((x, node))
            users[pair] = set()
            for p in changed:
                if len(users[p]) >= SHARED:
                    heapq.heappush(heap, (-len(users[p]), p))

    def accumulate(self, terms: np.ndarray) -> np.ndarray:
        """Scores of all queries (rows) from contributions of terms (rows) to documents (columns)."""
        nodes = np.empty((self.n_terms + len(self.sums), terms.shape[1]), dtype=np.int64)
        nodes[: self.n_terms] = terms
        for k, parts in enumerate(self.sums, self.n_terms):
            nodes[parts].sum(axis=0, out=nodes[k])
        out = np.zeros((len(self.queries), terms.shape[1]), dtype=np.int64)
        for q, parts in enumerate(self.queries):
            for node, weight in parts:
                out[q] += nodes[node] if weight == 1 else weight * nodes[node]
        return out

    @property
    def size(self) -> int:
        return self.n_terms + len(self.sums) + len(self.queries)


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for whole in batches:
            for batch in sub_batches(whole, "text", 4 << 20):
                ids, ns, starts, terms, tfs = [], [], [0], [], []
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    found = counted(text)
                    if not found:
                        continue
                    ids.append(doc)
                    ns.append(found.total())
                    for t in found.keys() & number.keys():
                        terms.append(number[t])
                        tfs.append(found[t])
                    starts.append(len(terms))
                at = pa.array(starts, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], schema=COUNTS)

    return count


def contributions(weights: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """w * ((10^9 * tf) div (1000 * tf + 12 * m)), in 64-bit integers."""
    return weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Best:
    """The best documents of each query so far: highest score first, then lowest id (null last)."""

    def __init__(self, n_queries: int, top: int):
        self.top, self.least = top, np.ones(n_queries, dtype=np.int64)
        self.q, self.score, self.none, self.id = (np.empty(0, dtype=d) for d in (np.int64, np.int64, bool, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        q, at = np.nonzero(scores >= self.least[:, None])
        if not len(q):
            return
        q, score, none, ids = (np.concatenate(x) for x in ((self.q, q), (self.score, scores[q, at]), (self.none, none[at]), (self.id, ids[at])))
        order = np.lexsort((ids, none, -score, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = order[rank < self.top]
        self.q, self.score, self.none, self.id = q[rank < self.top], score[keep], none[keep], ids[keep]
        full = rank == self.top - 1
        self.least[q[full]] = score[order[full]]


def _scorer(shared, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights, n_docs, n_terms = shared.value
        best = Best(len(graph.queries), top)
        step = max(1, MAX_CELLS_BYTES // (8 * graph.size))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column("terms")
                terms, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
                n = batch.column("n").to_numpy()
                doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                m = 75 + (25 * n * n_docs) // n_terms
                cells = np.zeros((graph.n_terms, len(n)), dtype=np.int64)
                cells[terms, doc] = contributions(weights, terms, tf, m[doc])
                ids = batch.column("id")
                best.add(graph.accumulate(cells), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.score), pa.array(best.id, mask=best.none)], names=["q", "score", "id"])

    return score


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """Queries in blocks of so many bytes (one query at least); the driver holds one block at a time."""
    own, size = [], 0
    for r in items.toLocalIterator():
        n = len(r[1].encode())
        if own and size + n > most:
            yield own
            own, size = [], 0
        own.append((r[0], r[1]))
        size += n
    if own:
        yield own


def search(docs: DataFrame, queries: DataFrame, *, top: int = TOP, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", item_id: str = "item_id", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The best documents of each query: item_id, rank (from 1), doc_id, score."""
    bound_batches(docs)
    kind = docs.schema[doc_id].dataType.simpleString()
    body = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    items = queries.where(F.col(query_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(query_text).cast("string").alias("t"))
    out = docs.sparkSession.createDataFrame([], f"item_id {queries.schema[item_id].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    for block in _blocks(items, max_block_bytes):
        found = _search_block(body, block, top, items.schema["item_id"].dataType.simpleString())
        if found is not None:
            out = out.unionByName(found.withColumn("doc_id", F.col("doc_id").cast(kind)))
    return out


def _search_block(body: DataFrame, block: list[tuple[object, str]], top: int, item_kind: str) -> DataFrame | None:
    spark = body.sparkSession
    own = [(i, c) for i, t in block if (c := counted(t))]
    terms = sorted({t for _, c in own for t in c})
    if not terms:
        return None
    counts = cut(body.mapInArrow(_counter(spark.sparkContext.broadcast(terms)), "id long, n long, terms array<int>, tf array<long>"))
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    weights = np.full(len(terms), math.floor(1000 * math.log(2 * n_docs + 2)), dtype=np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row for each term of the block
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    number = {t: i for i, t in enumerate(terms)}
    graph = Graph([{number[t]: n for t, n in c.items()} for _, c in own], len(terms))
    shared = spark.sparkContext.broadcast((graph, weights, n_docs, n_terms))
    scored = counts.mapInArrow(_scorer(shared, top), "q long, score long, id long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    # Each task gives the best of each query at most; parts of them are ranked first, so that no task ranks those of all tasks.
    part = F.row_number().over(W.partitionBy("q", "part").orderBy(*order))
    fewer = scored.withColumn("part", F.spark_partition_id() % 64).withColumn("r", part).where(F.col("r") <= top)
    ranked = fewer.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)
    names = F.broadcast(spark.createDataFrame([(q, i) for q, (i, _) in enumerate(own)], f"q long, item_id {item_kind}"))  # one row for each query of the block
    return ranked.join(names, "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


#: The same by SQL, where no item_id is repeated.
ORACLE_SQL = r"""
with terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
wanted as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
tf as (select doc_id, term, count(*) as tf from terms group by all),
df as (select term, count(*) as df from tf group by term),
len as (select doc_id, count(*) as n from terms group by doc_id),
all_of as (select count(*) as n_docs, sum(n)::bigint as n_terms from len),
c as (
  select tf.doc_id, tf.term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) as c
  from tf join df using (term) join len using (doc_id) cross join all_of where term in (select term from wanted)),
s as (select item_id, doc_id, sum(c)::bigint as score from wanted join c using (term) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
"""
