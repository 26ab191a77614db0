import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parallax.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, node string, d string, parent string, n string, rep string, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], SCHEMA)


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    return {c: [x[-1] for x in sorted(v)] for c, v in own.items()}


def rebuild(own):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(own):
    members = defaultdict(set)
    for c, seq in own.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = sum(below[k][0] for k in kids[p]) or 1, (len(members[p]) - 1) * words(p) + sum(below[k][1] for k in kids[p])
        below[p] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(own[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n):
    """Random conversations that share beginnings, some of them equal, with null and repeated turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 3, 4, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "a b", "c\td e", "é", None, ""])))
    return [*rows, *rows[:5], (None, 1, "user", "lost"), *[(1000 + i, 0, "user", "hot start") for i in range(40)], *[(1000 + i, 1, "user", f"then {i % 15}") for i in range(40)]]


@pytest.mark.parametrize("limits", [{}, {"crowd": 4, "shard_turns": 10}, {"crowd": 1, "shard_turns": 50}])
def test_brute_force(spark, limits):
    rows = conversations(3, 60)
    df = table(spark, rows)
    assert got(prefixes.trie(df, **limits)) == brute(sequences(rows))
    assert got(prefixes.report(df, **limits)) == brute(rebuild(sequences(rows)))


def test_empty_table_turnless_and_single(spark):
    assert got(prefixes.report(table(spark, []))) == [] and got(prefixes.trie(table(spark, [(None, 1, "a", "b")]))) == []
    turnless = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20][:5]  # their only turn would come from an absent donor
    rows = [(c, 0, "user", "one turn") for c in turnless]
    found = got(prefixes.report(table(spark, rows)))
    assert found == brute(rebuild(sequences(rows))) and len(found) == 1 and found[0][3] == 5
    one = [(20, t, "user", "w " * t) for t in range(30)]
    assert got(prefixes.trie(table(spark, one))) == brute(sequences(one))


def test_very_long_conversations_that_part_late(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (5, 6, 7) for t in range(300)] + [(6, 300, "user", "x"), (7, 300, "user", "y")]
    for limits in ({}, {"crowd": 1, "shard_turns": 100}):
        assert got(prefixes.trie(table(spark, rows), **limits)) == brute(sequences(rows))


def test_double_array():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 9, 300)
    words = [tuple(rng.integers(1, 40, n)) for n in lengths] + [tuple(range(1, 3000, 7))[:1]]
    seq = np.array([i for i, w in enumerate(words) for _ in w])
    depth = np.array([d for w in words for d in range(1, len(w) + 1)])
    symbol = np.array([s for w in words for s in w])
    order = np.lexsort((seq, depth))
    trie, state = prefixes.walked(seq[order], depth[order], symbol[order])
    assert (state > 0).all()
    prefix = {}
    for i, d, s in zip(seq[order], depth[order], state):
        assert prefix.setdefault(words[i][:d], s) == s  # equal prefixes share a state
    assert len(set(prefix.values())) == len(prefix)  # and others don't
    assert trie.step(np.array([0]), np.array([10**6]))[0] == -1 and trie.step(np.array([state[-1]]), np.array([39]))[0] in (-1, *prefix.values())
