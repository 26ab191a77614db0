"""Operators in DataFrame functions only, against plain Python or DuckDB."""

import hashlib
import json
import random
import re

import duckdb
import pytest
from helpers import ODD, frame, unchanged

from parallax.llm import licences, pii, toolcalls

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if ok(k, m[0])]


def pii_texts():
    r = random.Random(0)
    parts = ["a@b.c", "@", "x_y@d-e.f.g", ".", "..", "+", "+1 (234) 567-8901", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "256.1.1.1", "0012.1.1.1.5", " ", "-", "é", "😀", "word", "12", "%"]
    return [*ODD, *["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(150)], "a" * 20000 + "@", "1 " * 3000]


def test_base_spans(spark):
    texts = pii_texts()
    docs = frame(spark, texts)
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]


def test_redaction(spark):
    docs = frame(spark, ["mail a@b.cd now", None, "clean", "1.2.3.4a@b.c"])
    out = pii.redact(docs, pii.Model())
    assert out.columns == docs.columns
    got = {x.doc_id: x for x in out.collect()}
    assert got[0].text == "mail <email> now" and got[0].n_chars == len("mail <email> now")
    assert got[1].text is None and got[2].text == "clean" and got[3].text == "<ip>" or got[3].text == "<email>"


def test_trees_learn_form(spark):
    cells = [({f: 0 for f in pii.FEATURES} | {"gen": 1, "digits": d}, 50, 48 if d == 16 else 1) for d in range(7, 20)]
    trees, bias = pii.boost(cells)
    limit = pii.calibrated(trees, bias, cells, 0.9)
    score = lambda d: bias + sum(pii.value(t, cells[0][0] | {"digits": d}) for t in trees)
    assert score(16) >= limit[1] > score(12)
    assert pii.fit(frame(spark, [])).thresholds == {}


def test_added_spans(spark):
    """Forms that no strict pattern takes, beside plain numbers and words: the trees learn the ones and leave the others."""
    r = random.Random(2)
    n = lambda k: "".join(r.choice("123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(3, 9)))
    forms = [lambda: f"phone 555-{n(3)}-{n(4)}", lambda: f"josé@{word()}.org", lambda: f"{r.randint(1, 9)}{n(1)}[.]{r.randint(1, 9)}[.]1[.]{r.randint(1, 9)}", lambda: f'token = "{n(9)}ab{n(9)}cdef"', lambda: f"4{n(3)} {n(4)} {n(4)} {n(4)}"]
    plain = [lambda: f"in {n(8)} steps", lambda: "x" * 25, lambda: f"on 20{n(2)}-11-1{n(1)}", lambda: f"{word()}@{word()}"]
    texts = []
    for i in range(600):
        parts = [word() for _ in range(6)] + [r.choice(plain)()] + [word()] + ([forms[i % 5]()] if i % 2 else []) + [word()]
        texts.append(" ".join(parts))
    docs = frame(spark, texts + ODD)
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    extra = {i: set(filter(None, got[i].spans.split(","))) - set(base(t)) for i, t in enumerate(texts)}
    assert sum(bool(extra[i]) for i in range(1, 600, 2)) > 250 and not any(extra[i] for i in range(0, 600, 2))
    assert {s.split(":")[0] for e in extra.values() for s in e} >= {"email", "ip", "phone", "secret"}
    out = pii.redact(docs)
    assert unchanged(docs, out)
    clean = {x.doc_id: x.text for x in out.collect()}
    assert "<phone>" in "".join(clean[i] for i in range(5, 600, 10)) and "<secret>" in "".join(clean[i] for i in range(3, 600, 10))


def test_many_matches(spark):
    text = "a@b.cd " * 700
    row = pii.report(frame(spark, [text]), pii.Model()).first()
    assert row.n_email == 700 and row.spans == ",".join(base(text))


def test_licences(spark):
    mit = dict(licences.LICENCES)["MIT"]
    texts = [*ODD, mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper(), mit.replace(",", " ;"), "x " + mit, mit.replace("sublicense", "sub"), "Released under the MIT license!\nmore", "Whilst the licence\n(c) me", "code\n\nLicensed under CC BY-NC 4.0.\n \nReleased under the MIT License\nx", "a\n\nThis program is free software: you can redistribute it and/or modify it under the\nterms of the GNU General Public Licence as published by the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nb", "Licensed under the Apache License, Version 2.0."]
    docs = frame(spark, texts)
    got = {x.doc_id: x for x in licences.scan(docs).collect()}
    n = len(ODD)
    assert [got[n + i].license_id for i in range(5)] == ["MIT", "MIT", "MIT", None, None]
    assert [(got[n + i].license_id, got[n + i].unit, got[n + i].notices) for i in (5, 7, 8, 9)] == [("MIT", "line", "MIT"), ("CC-BY-NC-4.0", "paragraph", "CC-BY-NC-4.0,MIT"), ("GPL-3.0-or-later", "paragraph", "GPL-3.0-or-later"), ("Apache-2.0", "text", "Apache-2.0")]
    assert got[0].license_id is None and got[0].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(con.sql(licences.ORACLE_SQL).select("doc_id", "canonical_sha256", "license_id", "unit", "notices").fetchall(), key=repr)
    assert sorted(((x.doc_id, x.canonical_sha256, x.license_id, x.unit, x.notices) for x in got.values()), key=repr) == want
    assert licences.scan(frame(spark, [])).count() == 0


CALLS = "conv_id long, call_id string, order long, name string, arguments string, after string, extra int"
RESULTS = "conv_id long, call_id string, order long, content string, name string"
SCHEMAS = "name string, field string, type string, required boolean"


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "sum", '{"y": 2, "x": 1}', None, 0),
        (1, "b", 2, "sum", '{"x": "no"}', "a", 0),
        (1, "c", 3, "sum", "not json", "b", 0),
        (1, "d", 4, "none", "{}", "gone", 0),
        (1, "e", 5, "sum", '{"x": 1, "z": [2,  {"b":1,"a":2}]}', "f", 0),
        (1, "f", 6, "sum", None, "e", 0),
        (1, "a", 9, "sum", "{}", "c", 0),
        (None, "a", 1, "sum", "{}", None, 0),
    ]
    results = [(1, "a", 2, "three", "n"), (1, "a", 3, "later", "n"), (1, "zz", 1, "orphan", "n"), (2, "a", 1, "other", "n")]
    schemas = [("sum", "x", "BIGINT", True), ("sum", "y", "BIGINT", False)]
    got = {x.call_id: x for x in toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, SCHEMAS)).collect()}
    assert {k: x.level for k, x in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None}
    assert {k: x.valid for k, x in got.items()} == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False}
    assert got["a"].canonical == '{"arguments":{"x":1,"y":2},"id":"a","name":"sum","result":"three"}' and got["a"].result_order == 2
    assert got["c"].canonical is None and json.loads(got["e"].canonical)["arguments"]["z"] == [2, {"a": 2, "b": 1}]
    assert '"z":[2,{"a":2,"b":1}]' in got["e"].canonical


def test_tool_calls_in_order(spark):
    """Several predecessors, nested fields, and ties settled by content."""
    kind = "conv_id long, call_id string, order long, name string, arguments string, after array<string>"
    calls = [
        (1, "a", 1, "t", '{"o": {"x": 1}, "l": [{"y": "s"}]}', []),
        (1, "b", 2, "t", '{"o": {"x": "no"}, "l": [{"y": "s"}]}', ["a"]),
        (1, "c", 3, "t", '{"o": {}, "l": [{"y": "s"}]}', ["b", "a", "gone"]),
        (1, "d", 4, "t", '{"l": []}', ["c"]),
        (1, "e", 5, "t", "{}", ["d", "b", None]),
        (1, "p", 6, "t", "[1]", ["q"]),
        (1, "q", 7, "t", "1", ["p", "a"]),
        (1, "r", 8, "t", "1", ["q", "a"]),
        (1, "a", 1, "t", '{"z": 0}', ["e"]),
        (2, "a", 1, "t", "{}", None),
    ]
    schemas = [("t", "o.x", "BIGINT", False), ("t", "l[0].y", "STRING", True)]
    results = [(1, "a", 2, "z", "n"), (1, "a", 2, "y", "n")]
    link = lambda rows: {(x.conv_id, x.call_id): x for x in toolcalls.link(spark.createDataFrame(rows, kind), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, SCHEMAS)).collect()}
    got = link(calls)
    assert {k: x.level for k, x in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (1, "e"): 4, (1, "p"): None, (1, "q"): None, (1, "r"): None, (2, "a"): 0}
    assert {k[1]: x.valid for k, x in got.items() if k[0] == 1} == {"a": True, "b": False, "c": True, "d": False, "e": False, "p": False, "q": False, "r": False}
    assert '"result":"y"' in got[1, "a"].canonical
    assert link(calls[::-1]) == got


def test_long_chain_and_empty(spark):
    n = 200
    calls = spark.createDataFrame([(1, str(i), i, "t", "{}", str(i - 1) if i else None, 0) for i in range(n)], CALLS)
    assert {int(x.call_id): x.level for x in toolcalls.levels(calls).collect()} == {i: i for i in range(n)}
    none = toolcalls.link(calls.limit(0), spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCHEMAS))
    assert none.count() == 0


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_toolcalls", "op6_licences"])
def test_same_rows_as_sql(spark, sf_dir, name):
    from parallax.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = con.sql(registry.oracle_sql()[name])
    at = [found.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
