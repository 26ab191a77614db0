"""Language identification by a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Filters of several widths slide over embedded bytes, each
is max-pooled over its window, and a softmax over the pooled values gives the window's language; a document gets the
mean log-probability of all its windows. Once trained, a filter of width w is a sum of w/2 table look-ups of byte
pairs, so that scoring needs no matrix product per byte.

Defined cases: null text, or text without a letter, is ``und`` with score 0; a text shorter than a window is padded
with zero bytes; without a labelled row every text is ``und``; with one language only, every text with a letter has it
at score 1. Ties between languages go to the first in sorted order. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import bound_batches, fresh, held_out

WINDOW = 192
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBED = 8
#: The network is fitted on at most about so many windows of each language, chosen by a hash from all windows of the whole texts.
SAMPLE_WINDOWS = 6000
UNKNOWN = "und"
RESULT = "lang string, score double"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: For each width: tables (width / 2, 65536, FILTERS) of byte pairs, and the filters' biases.
    tables: tuple[np.ndarray, ...] = ()
    biases: tuple[np.ndarray, ...] = ()
    out_w: np.ndarray | None = None
    out_b: np.ndarray | None = None


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, size) over the whole texts and the text each belongs to; a last short window ends at the text's end."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], dtype=np.int64)
    x = np.zeros((int(counts.sum()), size), dtype=np.uint8)
    k = 0
    for t, n in zip(texts, counts):
        b = np.frombuffer(t, dtype=np.uint8)
        whole = len(b) // size
        x[k : k + whole] = b[: whole * size].reshape(whole, size)
        if whole < n:
            tail = b[-size:] if whole else b
            x[k + whole, : len(tail)] = tail
        k += n
    return x, np.repeat(np.arange(len(texts)), counts)


def train(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], *, epochs: int = 4, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> Model:
    """Adam on the cross-entropy of windows; classes weigh alike whatever their share."""
    if len(langs) < 2 or not len(x):
        return Model(langs)
    rng = np.random.default_rng(seed)
    c = len(langs)
    p = {"e": rng.normal(0, 0.5, (256, EMBED))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["v"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), c))
    p["c"] = np.zeros(c)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    weight = len(y) / (c * np.maximum(1, np.bincount(y, minlength=c)))
    step, length = 0, x.shape[1]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            xb, yb, n = x[own], y[own], len(own)
            emb = p["e"][xb]
            pooled, cache = [], []
            for w in WIDTHS:
                cols = np.lib.stride_tricks.sliding_window_view(emb.reshape(n, -1), w * EMBED, axis=1)[:, ::EMBED]
                z = cols @ p[f"w{w}"] + p[f"b{w}"]
                top = z.argmax(axis=1)
                best = np.take_along_axis(z, top[:, None, :], axis=1)[:, 0, :]
                cache.append((cols, top, best))
                pooled.append(np.maximum(best, 0))
            h = np.concatenate(pooled, axis=1)
            logits = h @ p["v"] + p["c"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob
            d[np.arange(n), yb] -= 1
            d *= (weight[yb] / n)[:, None].astype(np.float32)
            g = {"v": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = d @ p["v"].T
            for k, w in enumerate(WIDTHS):
                cols, top, best = cache[k]
                dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * (best > 0)
                hit = cols[np.arange(n)[:, None], top]  # n, FILTERS, w * EMBED
                g[f"w{w}"] = np.einsum("nfe,nf->ef", hit, dz)
                g[f"b{w}"] = dz.sum(axis=0)
                back = dz[:, :, None] * p[f"w{w}"].T[None]
                bytes_hit = xb[np.arange(n)[:, None, None], top[:, :, None] + np.arange(w)]
                np.add.at(g["e"], bytes_hit.ravel(), back.reshape(-1, EMBED))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    del length
    tables = []
    for w in WIDTHS:
        single = np.stack([p["e"] @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)])  # w, 256, FILTERS
        tables.append(np.stack([(single[2 * k][:, None, :] + single[2 * k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(w // 2)]).astype(np.float32))
    return Model(langs, tuple(tables), tuple(p[f"b{w}"] for w in WIDTHS), p["v"], p["c"])


def window_logprob(model: Model, x: np.ndarray) -> np.ndarray:
    """Log-probabilities (n, languages) of windows."""
    out = []
    for at in range(0, len(x), 2048):
        b = x[at : at + 2048].T.astype(np.int32)  # bytes by position, so that windows lie side by side
        pairs = np.ascontiguousarray(b[:-1] * 256 + b[1:])
        n, pooled = b.shape[1], []
        for table, bias, w in zip(model.tables, model.biases, WIDTHS):
            best = np.full((n, FILTERS), -np.inf, dtype=np.float32)
            z, more = np.empty((n, FILTERS), dtype=np.float32), np.empty((n, FILTERS), dtype=np.float32)
            for t in range(len(b) - w + 1):
                np.take(table[0], pairs[t], axis=0, out=z, mode="clip")
                for k in range(1, w // 2):
                    np.take(table[k], pairs[t + 2 * k], axis=0, out=more, mode="clip")
                    z += more
                np.maximum(best, z, out=best)
            pooled.append(np.maximum(best + bias, 0))
        logits = (np.concatenate(pooled, axis=1) @ model.out_w + model.out_b).astype(np.float64)
        logits -= logits.max(axis=1, keepdims=True)
        out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
    return np.concatenate(out) if out else np.zeros((0, len(model.langs)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: Model, texts: list[str | None], max_bytes: int = 4 << 20) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
    if len(model.langs) == 1:
        for i in own:
            langs[i], scores[i] = model.langs[0], 1.0
        return langs, scores
    at = 0
    while at < len(own):
        group, held = [], 0
        while at < len(own) and (not group or held < max_bytes):
            group.append(texts[own[at]].encode("utf-8", "replace"))
            held += len(group[-1])
            at += 1
        x, doc = windows_of(group)
        lp = np.concatenate([window_logprob(model, x[k : k + 65536]) for k in range(0, len(x), 65536)])
        mean = np.stack([np.bincount(doc, weights=lp[:, c], minlength=len(group)) for c in range(len(model.langs))], axis=1) / np.bincount(doc, minlength=len(group))[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for k, (c, q) in enumerate(zip(prob.argmax(axis=1), prob.max(axis=1))):
            i = own[at - len(group) + k]
            langs[i], scores[i] = model.langs[c], float(q)
    return langs, scores


def fit(docs: DataFrame, *, sample_windows: int = SAMPLE_WINDOWS) -> Model:
    """Fit on windows of rows outside the held-out third. The sample is bounded by counting each language's windows first."""
    bound_batches(docs)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW)).cast("long")
    labelled = docs.select("doc_id", "text", "lang", n.alias("n")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return Model(())
    langs = tuple(sorted(counts))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1 << 30, int(sample_windows / counts[k] * (1 << 30))))])
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 30)) < share[F.col("lang")])
    chosen = labelled.withColumn("at", drawn).where(F.size("at") > 0)

    @F.pandas_udf("array<binary>")
    def taken(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            out = []
            for t, at in zip(texts, places):
                x, _ = windows_of([t.encode("utf-8", "replace")])
                out.append([x[i].tobytes() for i in at] if has_letter(t) else [])
            yield pd.Series(out)

    rows = chosen.select("doc_id", "lang", taken("text", "at").alias("w")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["w"]))
    x = [np.frombuffer(bytes(w), dtype=np.uint8) for r in rows for w in r["w"]]
    y = [langs.index(r["lang"]) for r in rows for _ in r["w"]]
    return train(np.stack(x), np.array(y), langs) if x else Model(langs)


def predictor(docs: DataFrame, model: Model):
    """A column function of text: struct of lang and score."""
    bound_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = predict(shared.value, list(texts))
            yield pd.DataFrame({"lang": lang, "score": score})

    return predicted


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = model or fit(docs)
    p = predictor(docs, model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p(F.col("text")).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, model: Model | None = None, *, min_score: float = 0.3) -> DataFrame:
    """docs without those whose language is unknown or scores under min_score; columns as they were."""
    (found,) = fresh(docs, "found")
    p = predictor(docs, model or fit(docs))
    return docs.withColumn(found, p(F.col("text"))).where((F.col(found)["lang"] != UNKNOWN) & (F.col(found)["score"] >= min_score)).drop(found)
