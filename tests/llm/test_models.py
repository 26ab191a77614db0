"""Classifiers: defined cases, and accuracy on held-out rows."""

import random

import numpy as np
from helpers import ODD, frame, unchanged
from pyspark.sql import functions as F

from parallax.llm import language, toxicity
from parallax.llm.common import table


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.95


def test_language_odd_cases(spark):
    r = random.Random(0)
    say = lambda words: " ".join(r.choice(words) for _ in range(30))
    known = [say(["the", "and", "ing"]) if i % 2 else say(["der", "und", "ung"]) for i in range(60)]
    docs = frame(spark, [*known, *ODD, "123 !!"], ["en" if i % 2 else "de" for i in range(60)] + [None] * (len(ODD) + 1))
    model = language.fit(docs)
    got = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= x.score <= 1 for x in got.values())
    for i, t in enumerate([*ODD, "123 !!"], 60):
        assert (got[i].lang_pred == "und") == (not language.has_letter(t))
    assert got[63].score == got[64].score  # repeated text
    kept = language.keep_identified(docs, model)
    assert unchanged(docs, kept) and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.lang_pred != "und" and x.score >= 0.3}


def test_language_without_labels(spark):
    docs = frame(spark, ["some text", None])
    assert {x.lang_pred for x in language.identify(docs).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0
    one = frame(spark, ["some text"] * 6, ["en"] * 6)
    assert {(x.lang_pred, x.score) for x in language.identify(one).collect()} == {("en", 1.0)}


def test_tables_equal_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, language.WINDOW), dtype=np.uint8)
    y = (x[:, 0] % 2).astype(int)
    model = language.train(x, y, ("a", "b"), epochs=1)
    lp = language.window_logprob(model, x)
    pooled = []
    for table_, bias, w in zip(model.tables, model.biases, language.WIDTHS):
        pairs = x[:, :-1].astype(int) * 256 + x[:, 1:]
        n = language.WINDOW - w + 1
        z = sum(table_[k][pairs[:, 2 * k : 2 * k + n]] for k in range(w // 2))
        pooled.append(np.maximum(z.max(axis=1) + bias, 0))
    logits = np.concatenate(pooled, axis=1) @ model.out_w + model.out_b
    assert np.allclose(lp, logits - np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1, keepdims=True)) - logits.max(1, keepdims=True), atol=1e-4)


def toxic_tables(spark):
    r = random.Random(1)
    words = ["stone", "river", "light", "green", "house", "paper", "music"]
    texts, labels = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.randint(5, 40))]
        bad = i % 3 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["idiotic", "moronic"]))
        texts.append(" ".join(w))
        labels.append((i, None, int(bad)))
    docs = frame(spark, texts + ODD)
    return docs, spark.createDataFrame([*labels, (10**6, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.classify(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out")
    wrong = held.where("predicted <> toxic").count()
    assert held.count() > 60 and wrong == 0
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    odd = got.where("doc_id >= 300")
    assert odd.where("predicted = 1").count() == 0
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == got.where("predicted = 0").count()


def test_toxicity_without_classes(spark):
    docs, labels = toxic_tables(spark)
    assert {x.score for x in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_neighbours():
    places = np.zeros(1 << toxicity.BITS, dtype=np.int32)
    h = toxicity.hashes(toxicity._prepared(["some text"])[0], 4)
    places[h[:5]] = np.arange(1, 6)
    m = toxicity.Model(places, np.array([0, 1.0, 2, 3, 4, 5]), -1.0)
    alone = [toxicity.score(m, [t])[0] for t in ("some text", "", "text")]
    assert np.allclose(toxicity.score(m, ["some text", "", "text"]), alone)


def test_scores_against_brute_force():
    """Whole texts through plain Python: each character n-gram once, code points hashed as the module says."""
    r = random.Random(3)
    texts = [*ODD, *["".join(r.choice("aAbß é😀\n") for _ in range(r.randint(0, 60))) for _ in range(40)]]
    rng = np.random.default_rng(1)
    places = np.zeros(1 << toxicity.BITS, dtype=np.int32)
    places[rng.permutation(1 << toxicity.BITS)[: 1 << 18]] = np.arange(1, (1 << 18) + 1)
    model = toxicity.Model(places, np.append(0.0, rng.normal(0, 0.1, 1 << 18)), -0.3)

    def hashed(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
        return ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - toxicity.BITS

    for t, got in zip(texts, toxicity.score(model, texts)):
        own = (t or "").lower() + "\0" * max(toxicity.SIZES) * 2
        grams = {hashed(own[i : i + k]) for k in toxicity.SIZES for i in range(len((t or "").lower()))}
        z = model.bias + sum(model.weights[places[g]] for g in grams)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_language_against_brute_force():
    """Documents through plain loops: mean log-probability over the windows of the whole text."""
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (60, language.WINDOW), dtype=np.uint8)
    model = language.train(x, (x[:, 0] % 3).astype(int), ("a", "b", "c"), epochs=1)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (1, 50, 192, 193, 400, 900)]
    langs, scores = language.predict(model, texts)
    for t, lang, score in zip(texts, langs, scores):
        raw, n = t.encode(), language.WINDOW
        parts = [raw[i : i + n] for i in range(0, len(raw) - n + 1, n)]
        if len(raw) % n or not raw:
            parts.append(raw[-n:].ljust(n, b"\0"))
        total = np.zeros(3)
        for w in parts:
            pooled = []
            for tab, bias, width in zip(model.tables, model.biases, language.WIDTHS):
                z = np.array([sum(tab[k][w[i + 2 * k] * 256 + w[i + 2 * k + 1]] for k in range(width // 2)) for i in range(n - width + 1)])
                pooled.append(np.maximum(z.max(axis=0) + bias, 0))
            logits = (np.concatenate(pooled) @ model.out_w + model.out_b).astype(float)
            total += logits - np.log(np.exp(logits).sum())
        p = np.exp(total / len(parts) - (total / len(parts)).max())
        p /= p.sum()
        assert lang == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-4
