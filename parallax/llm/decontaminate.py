"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised (ASCII lower case, words kept, everything else one space), cut into windows
of consecutive words and put into one automaton. Each document is normalised the same way and scanned once; word
positions of the matches map back to character offsets of the original text.

Defined cases: a null or wordless text has no words and no hits; an item without words has no windows; an item
shorter than a window is one window; equal windows of several items count for each of them; repeated rows are
scanned alone; an empty benchmark hits nothing. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, fresh

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Bytes of benchmark text that one automaton (and one broadcast) may hold; more text is scanned in several passes.
MAX_ITEM_BYTES = 32 << 20
HITS = "n_words long, n_hit long, items array<long>, runs array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>"
#: A word of the text as it was, before lower-casing.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_built: dict[str, object] = {}


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_KEEP).split() if text else []


def windows(text: str | None, width: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _automaton(key: str, items: list[tuple[int, str]], width: int):
    """The automaton of a broadcast, built once in each Python worker."""
    if key not in _built:
        import ahocorasick

        owners: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            for w in windows(text, width):
                owners[w].append(item_id)
        trie = ahocorasick.Automaton()
        for w, ids in owners.items():
            trie.add_word(" " + b" ".join(w).decode() + " ", (len(w), tuple(ids)))
        if owners:
            trie.make_automaton()
        _built.clear()
        _built[key] = trie if owners else None
    return _built[key]


def scan(text: str | None, trie) -> tuple[int, int, list[int], list[tuple[int, int]]]:
    """Number of words, of hit words, ids of the items found, and runs of hit words (first, last)."""
    w = words(text)
    if not w or trie is None:
        return len(w), 0, [], []
    plain = " " + b" ".join(w).decode() + " "
    hit, ids, at, seen = None, set(), 0, 0
    for end, (n, owners) in trie.iter(plain):
        seen += plain.count(" ", at, end)
        at = end
        hit = hit or bytearray(len(w))
        hit[seen - n : seen] = b"\x01" * n
        ids.update(owners)
    if hit is None:
        return len(w), 0, [], []
    runs = [(m.start(), m.end() - 1) for m in re.finditer(rb"\x01+", bytes(hit))]
    return len(w), sum(hit), sorted(ids), runs


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of runs of words in the text as it was."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in runs]


def _scanner(shared, key: str, width: int):
    @F.pandas_udf(HITS)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = _automaton(key, shared.value, width)
        for texts in batches:
            rows = []
            for t in texts:
                n, n_hit, ids, runs = scan(t, trie)
                spans = original_spans(t, runs) if runs else []
                rows.append((n, n_hit, ids, [{"first": a, "last": b} for a, b in runs], [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "runs", "spans"])

    return scanned


def _collected(items: DataFrame, width: int):
    spark = items.sparkSession
    rows = [(r[0], r[1]) for r in items.collect() if r[0] is not None]
    shared = spark.sparkContext.broadcast(rows)
    key = hashlib.sha256(repr((width, sorted(rows, key=repr))).encode()).hexdigest()
    return _scanner(shared, key, width)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",), width: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES, column: str = "hits") -> DataFrame:
    """docs with a struct column of the given name (which docs may not have): n_words, n_hit, items, runs (in words) and spans (in characters).

    The benchmark's size is measured first. Up to ``max_item_bytes`` it is broadcast and documents are scanned in
    place, without a shuffle. Beyond it, items are dealt into parts of that size, each part scans the documents in a
    pass of its own, and only documents with hits are shuffled to be merged.
    """
    bound_batches(docs)
    parts = [benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(c).alias("t")) for c in item_texts]
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = items.where("i is not null and t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size <= max_item_bytes:
        return docs.withColumn(column, _collected(items, width)(F.col(text)))
    n = -(-size // max_item_bytes) + 1
    key = [F.xxhash64(text), F.hash(text), F.length(text)]
    texts = docs.select(F.col(text).alias("t"), *[k.alias(f"k{i}") for i, k in enumerate(key)]).dropDuplicates(["k0", "k1", "k2"])
    found = None
    for k in range(n):
        part = _collected(items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k), width)
        one = texts.select("k0", "k1", "k2", "t", part(F.col("t")).alias("h")).where("h.n_hit > 0")
        found = one if found is None else found.unionByName(one)
    # Pieces of one text meet: a row for each part at most.
    merged = found.groupBy("k0", "k1", "k2").agg(F.first("t").alias("t"), F.first("h.n_words").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items"), F.flatten(F.collect_list("h.runs")).alias("runs"))

    @F.pandas_udf(HITS)
    def joined(n_words: pd.Series, texts: pd.Series, items: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for n, t, ids, rs in zip(n_words, texts, items, runs):
            hit = bytearray(int(n))
            for r in rs:
                hit[r["first"] : r["last"] + 1] = b"\x01" * (r["last"] + 1 - r["first"])
            own = [(m.start(), m.end() - 1) for m in re.finditer(rb"\x01+", bytes(hit))]
            rows.append((n, sum(hit), list(ids), [{"first": a, "last": b} for a, b in own], [{"start": a, "end": b} for a, b in original_spans(t, own)]))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "runs", "spans"])

    names = fresh(docs, *[f"{x}{i}" for x in "km" for i in range(3)], "merged")
    own, other, whole = names[:3], names[3:6], names[6]
    merged = merged.select(*[F.col(f"k{i}").alias(m) for i, m in enumerate(other)], joined("n", "t", "items", "runs").alias(whole))
    none = _scanner(docs.sparkSession.sparkContext.broadcast([]), "none", width)
    keyed = docs.withColumns(dict(zip(own, key)))
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(own, other)]
    out = keyed.join(merged, same[0] & same[1] & same[2], "left")
    return out.withColumn(column, F.coalesce(whole, none(F.col(text)))).drop(*names)


def is_contaminated(hits: Column) -> Column:
    return (hits["n_hit"] > 0) & (SHARE * hits["n_hit"] >= hits["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents; columns as they were."""
    (hits,) = fresh(docs, "hits")
    return find_hits(docs, benchmark, column=hits, **options).where(~is_contaminated(F.col(hits))).drop(hits)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, **options)
    ids = F.array_sort(F.transform("hits.items", lambda x: x.cast("string")))
    return hits.select("doc_id", F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(F.col("hits")).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, w, least(len(w), {WINDOW}) as n from (select item_id, {_SQL_WORDS} as w from benchmark) where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from b)),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw))),
hit as (select doc_id, i, n, item_id from dw join bw using (g, n)),
words as (select doc_id, count(distinct i + k) as n_hit from (select doc_id, i, unnest(range(n)) as k from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
