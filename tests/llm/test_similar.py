import random

import numpy as np
import pytest
from helpers import ODD, frame

from parallax.llm import similar, simhash


def near_texts():
    r = random.Random(0)
    out = [*ODD]
    for _ in range(6):
        base = [f"w{r.randint(0, 500)}" for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 500)}"
            out.append(" ".join(own))
    return out


def brute(texts):
    sets = [similar.shingle_hashes(t) for t in texts]
    n = len(texts)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if label[i] != label[j] and similar.jaccard(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_components(spark):
    texts = near_texts()
    docs = frame(spark, texts)
    got = {x.doc_id: x.component_id for x in similar.components(docs).collect()}
    assert got == dict(enumerate(brute(texts)))
    kept = similar.keep_one(docs.unionByName(docs.limit(4)))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values()))


def test_empty(spark):
    assert similar.components(frame(spark, [])).count() == 0 and similar.keep_one(frame(spark, [])).count() == 0


def test_bins_lose_no_pair():
    texts = near_texts() + [" ".join(f"w{i % k}" for i in range(4000)) for k in (3, 700, 900)]
    sets = [similar.shingle_hashes(t) for t in texts]
    rows = np.frombuffer(b"".join(map(similar.binned, sets)), dtype=np.uint8).reshape(-1, similar.BINS)
    for i in range(len(texts)):
        may = similar.may_be_alike(np.repeat(rows[i : i + 1], len(rows), axis=0), rows, 0.8)
        alike = np.array([similar.jaccard(sets[i], t) >= 0.8 for t in sets])
        assert may[alike].all() and may.sum() < len(texts) / 2


def family(n, seed=1, changed=(2, 3), words=200):
    """Copies of one text, a few words of each changed: many pairs are alike, many are not, and all share shingles."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for at in r.sample(range(words), r.randint(*changed)):
            own[at] = f"c{i}_{at}"
        out.append(" ".join(own))
    return out


def all_pairs(texts):
    """The smallest place that each text reaches, from the counts of shared shingles of all pairs."""
    sets = [similar.shingle_hashes(t) for t in texts]
    names = np.unique(np.concatenate(sets))
    has = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, x in enumerate(sets):
        has[i, np.searchsorted(names, x)] = 1
    common, size = has @ has.T, has.sum(axis=1)
    alike = common / (size[:, None] + size[None, :] - common) >= 0.8
    label = np.arange(len(sets))
    while True:
        new = np.where(alike, label[None, :], len(sets)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("at_once, span", [(None, None), (0, 1)])
def test_families_are_whole(spark, monkeypatch, at_once, span):
    if at_once is not None:  # by rounds of neighbours
        monkeypatch.setattr(similar, "AT_ONCE", at_once)
        monkeypatch.setattr(similar, "SPAN", span)
    r = random.Random(3)
    base = " ".join(f"w{r.randint(0, 5000)}" for _ in range(300))
    repeats = [base, base + " a b c" * 400]  # alike by shingles, however often a line is repeated, with fingerprints far apart
    assert similar.jaccard(*map(similar.shingle_hashes, repeats)) >= 0.8
    assert (simhash.fingerprint(repeats[0], 5) ^ simhash.fingerprint(repeats[1], 5)).bit_count() > 10
    texts = repeats + family(40) + family(150, seed=2) + family(500, seed=4) + family(60, seed=5, changed=(4, 9))
    got = {x.doc_id: x.component_id for x in similar.components(frame(spark, texts)).collect()}
    assert got == dict(enumerate(all_pairs(texts)))


def test_parities_lose_no_pair_and_tell_chance_pairs_apart():
    texts = near_texts() + family(30) + [f"{a} {b}" for a, b in zip(family(30, seed=8), family(30, seed=9, changed=(190, 200)))]
    sets = [similar.shingle_hashes(t) for t in texts]
    bits = np.array([similar.parities(s) for s in sets]).view(np.uint64)
    size = np.array([len(s) for s in sets])
    for i in range(len(texts)):
        may = np.bitwise_count(bits[i] ^ bits).sum(axis=1) <= 0.2 / 1.8 * (size + size[i]) + 1e-6
        score = np.array([similar.jaccard(sets[i], t) for t in sets])
        assert may[score >= 0.8].all() and not may[score < 0.6].any()
