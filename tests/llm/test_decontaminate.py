import random
import re

import pytest
from helpers import ODD, frame, unchanged

from parallax.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    low = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for i, t in items:
        v = low(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if n else []:
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(i)
    return len(w), len(hit), sorted(found)


ITEMS = [(3, "One two, THREE four five six seven eight nine ten eleven twelve thirteen fourteen!"), (20, "short Item é"), (100, None), (4, "..."), (5, "one two three four five six seven eight nine ten eleven twelve thirteen")]


def texts():
    r = random.Random(0)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen short item é".split()
    out = [" ".join(r.choice(words) for _ in range(40)) for _ in range(10)]
    return [*ODD, ITEMS[0][1], "x " + ITEMS[0][1].upper() + " y", "SHORT item É short-item_é", "short item éé", *out, " ".join(words) * 3]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_against_brute_force(spark, limit):
    docs = frame(spark, texts())
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in D.find_hits(docs, bench, max_item_bytes=limit, column="own").collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        h = got[i].own
        assert (h.n_words, h.n_hit, list(h["items"])) == brute(t, ITEMS)
        for run, span in zip(h.runs, h.spans):
            assert D.words(t[span.start : span.end]) == D.words(t)[run.first : run.last + 1]


def test_stage_keeps_columns_and_rows(spark):
    docs = frame(spark, texts())
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert unchanged(docs, kept) and unchanged(docs, D.decontaminate(docs, bench, max_item_bytes=40))
    want = [i for i, t in enumerate(texts()) if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute(t, ITEMS))]
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.report(frame(spark, []), bench).count() == 0
    assert D.report(frame(spark, ["a b"]), bench.limit(0)).first().contaminated is False
