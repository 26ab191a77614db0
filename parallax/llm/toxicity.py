"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's lower-cased characters (code points) give hashed n-grams of several lengths, each counted once a document. On labelled
rows outside the held-out third, the log of the ratio of their smoothed shares in toxic and other documents scales each
feature; logistic regression on the scaled features, with a quadratic penalty, gives the score of whole texts.

Defined cases: null and empty texts have no features and get the score of the intercept; a text shorter than an n-gram
has those that its end mark completes; without labelled rows of both classes every score is 0; a document labelled twice counts
twice; labels without a document are ignored; repeated rows score alike. Only doc_id, text and labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, cut, held_out

SIZES = (4, 6, 8)
BITS = 20
#: Features kept: those with the surest ratios.
FEATURES = 4000
#: The classifier is fitted on at most about so many labelled documents of each class, chosen by a hash of their id.
SAMPLE_DOCS = 3000
THRESHOLD = 0.7
SMOOTHING = 1.0


@dataclass(frozen=True)
class Model:
    #: For each hash the place of its weight, or 0.
    places: np.ndarray
    weights: np.ndarray
    bias: float


def _prepared(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with an end mark, and where each begins."""
    end = "\0" * max(SIZES)
    own = [(t or "").lower() + end for t in texts]
    starts = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in own], out=starts[1:])
    return np.frombuffer("".join([*own, end]).encode("utf-32-le", "surrogatepass"), dtype="<u4"), starts


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash for each n-gram of a size."""
    h = np.full(len(data) - size + 1, size, dtype=np.uint32)
    for k in range(size):
        h *= np.uint32(0x01000193)
        h += data[k : k + len(h)] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def present(texts: list[str | None], places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) once each; with places only those that have one, as that place."""
    data, starts = _prepared(texts)
    pairs = []
    for size in SIZES:
        h = hashes(data, size)[: starts[-1]]
        if places is None:
            at, f = np.arange(len(h)), h.astype(np.int64)
        else:
            f = places[h]
            at = np.flatnonzero(f)
            f = f[at].astype(np.int64)
        doc = np.searchsorted(starts, at, side="right") - 1
        own = at < starts[doc + 1] - max(SIZES)  # begins in the text, not in its end mark
        pairs.append(doc[own] << BITS | f[own])
    both = np.unique(np.concatenate(pairs))
    return both >> BITS, both & ((1 << BITS) - 1)


def score(model: Model, texts: list[str | None]) -> np.ndarray:
    doc, f = present(texts, model.places)
    z = np.bincount(doc, weights=model.weights[f], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def regress(doc: np.ndarray, place: np.ndarray, r: np.ndarray, y: np.ndarray, *, penalty: float = 1e-4, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of ratio-scaled features, and the intercept; classes weigh alike."""
    w, b = np.zeros(len(r)), 0.0
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    x = r[place]
    for step in range(1, steps + 1):
        z = np.bincount(doc, weights=x * w[place], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * each
        g, gb = np.bincount(place, weights=x * e[doc], minlength=len(r)) + penalty * w, e.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-7)
    return w * r, b


def _batches(it: Iterator[pd.Series], max_bytes: int = 2 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Lists of texts of about max_bytes; the number says how many of the pandas batch are still to come."""
    for texts in it:
        group, held = [], 0
        left = len(texts)
        for t in texts:
            group.append(t)
            held += len(t or "")
            left -= 1
            if held > max_bytes or not left:
                yield left, group
                group, held = [], 0
        if not len(texts):
            yield 0, []


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, features: int = FEATURES) -> Model | None:
    """Fit on labelled rows outside the held-out third; None where a class has no row."""
    bound_batches(docs)
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1 << 30, int(sample_docs / counts[1] * (1 << 30)))).otherwise(min(1 << 30, int(sample_docs / counts[0] * (1 << 30))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # The chosen ids are bounded by the sample's size, so that they may be broadcast.
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, 1 << BITS), dtype=np.int32)
        for pdf in it:
            for y in (0, 1):
                for _, group in _batches(iter([pdf.loc[pdf["y"] == y, "text"]]), 1 << 20):
                    n[y] += np.bincount(present(group)[1], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(n.sum(axis=0))
        yield pd.DataFrame({"f": at, "neg": n[0][at], "pos": n[1][at]})

    def smooth(column: str, n: int):
        return F.log((F.col(column) + SMOOTHING) / (n + 2 * SMOOTHING))

    by_feature = sample.repartition(8, "doc_id").mapInPandas(counted, "f long, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    rated = by_feature.where("neg + pos >= 4").select("f", (smooth("pos", sizes[1]) - smooth("neg", sizes[0])).alias("r"), F.sqrt(1 / (F.col("pos") + SMOOTHING) + 1 / (F.col("neg") + SMOOTHING)).alias("error"))
    best = rated.orderBy(F.desc(F.abs("r") / F.col("error")), "f").limit(features).select("f", "r").collect()
    if not best:
        return None
    best.sort()
    r = np.array([x["r"] for x in best])
    places = np.zeros(1 << BITS, dtype=np.int32)
    places[[x["f"] for x in best]] = np.arange(1, len(best) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("binary")
    def kept(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        out: list[bytes] = []
        for left, group in _batches(it):
            doc, f = present(group, shared.value)
            cuts = np.searchsorted(doc, np.arange(len(group) + 1))
            out += [(f[a:b] - 1).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            if not left:
                yield pd.Series(out, dtype=object)
                out = []

    got = sample.select("doc_id", "y", kept("text").alias("f")).collect()
    got.sort(key=lambda x: (x["doc_id"], x["f"]))
    lists = [np.frombuffer(bytes(x["f"]), dtype=np.int32) for x in got]
    y = np.array([x["y"] for x in got])
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    w, b = regress(doc, np.concatenate(lists), r, y)
    return Model(places, np.append(0.0, w), float(b))


def scorer(docs: DataFrame, model: Model | None):
    bound_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        out: list[float] = []
        for left, group in _batches(it):
            if group:
                out += list(score(shared.value, group)) if shared.value else [0.0] * len(group)
            if not left:
                yield pd.Series(out, dtype=float)
                out = []

    return scored


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = model or fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """docs that score below the threshold; columns as they were."""
    model = model or fit(docs, labels)
    return docs.where(scorer(docs, model)(F.col("text")) < THRESHOLD)
