import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import EXTRA, ODD, frame

from parallax.llm import ranked


def terms(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """docs, items: (id, text)."""
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for i, text in items:
        found = []
        for d, c in own:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text))
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **more):
    own = spark.createDataFrame([(d, t, *EXTRA[:5]) for d, t in docs], "doc_id long, text string, score string, rank string, q string, part string, id_ string")
    asked = spark.createDataFrame([(i, t, *EXTRA[:2]) for i, t in items], "item_id long, text string, t string, doc_id string")
    return sorted((tuple(r) for r in ranked.search(own, asked, **more).collect()), key=repr)


def test_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ß9", "日本"]
    text = lambda n: " ,".join(rng.choice(words[: rng.choice([5, 63])]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(150)] + [(None, "w1 w2"), (None, "w1 w2"), (7, "W1-W2"), (7, "w1 w2")]
    items = [(i, text(rng.randrange(1, 50))) for i in range(20)] + [(90, "w1 w1 w1 w1 w1 w2"), (91, "unheard of"), (92, None), (93, " .,"), (94, "w1 w2")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, max_block_bytes=100) == want  # several blocks
    assert got(spark, docs, items, top=3) == brute(docs, items, 3)


def test_odd_texts_ties_and_empty_tables(spark):
    docs = list(enumerate(ODD)) + [(100 + i, "same copy of a text") for i in range(60)]
    items = list(enumerate(ODD)) + [(50, "same copy of a text")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want and [r[2] for r in sorted(want, key=lambda r: (r[0], r[1])) if r[0] == 50] == list(range(100, 120))
    assert got(spark, docs, []) == [] and got(spark, [], items) == [] and got(spark, [(1, None), (2, "..")], items) == []
    assert frame(spark, []).count() == 0


def test_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked, "CHUNK", 5)
    text = "Ab cd,ef " * 50 + "x" * 40 + " ab"
    assert ranked.counted(text) == Counter(t.encode() for t in terms(text)) and len(list(ranked.pieces(text))) > 20


@pytest.mark.parametrize("piece", [512, 4])
def test_graph_shares_parts_and_adds_up(monkeypatch, piece):
    monkeypatch.setattr(ranked, "PIECE", piece)
    rng = random.Random(6)
    queries = [{t: rng.choice([1, 1, 2, 5]) for t in range(30) if rng.random() < 0.6} for _ in range(25)] + [{}, {3: 1}, {3: 1}]
    graph = ranked.Graph(queries, 30)
    cells = np.random.default_rng(0).integers(0, 1 << 40, (30, 17))
    want = np.array([sum((n * cells[t] for t, n in q.items()), np.zeros(17, dtype=np.int64)) for q in queries])
    assert np.array_equal(graph.accumulate(cells), want)
    assert all(max(parts) < 30 + k for k, parts in enumerate(graph.sums))
    phrases = [range(k * 8, k * 8 + 8) for k in range(6)]
    queries = [{t: 1 for p in rng.sample(phrases, 3) for t in p} | {50 + q: 1} for q in range(40)]
    graph = ranked.Graph(queries, 90)
    edges = sum(map(len, graph.sums)) + sum(map(len, graph.queries))
    assert edges < (0.3 if piece == 512 else 0.6) * sum(map(len, queries))
