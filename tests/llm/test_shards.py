import hashlib
import random
import zlib

import pytest
from helpers import ODD, frame, unchanged

from parallax.llm import shards


def sizes(texts):
    """Ordered atomic groups: digest, bytes."""
    found = {}
    for t in texts:
        raw = (t or "").encode()
        found[hashlib.md5(raw).digest()] = found.get(hashlib.md5(raw).digest(), 0) + len(raw) + 1
    return sorted(found.items())


def least_capacity(own, n):
    """By trying every sum of neighbours."""
    def fits(c):
        used, load = 1, 0
        for s in own:
            if s > c:
                return False
            used, load = (used + 1, s) if load + s > c else (used, load + s)
        return used <= n

    return min(c for i in range(len(own)) for j in range(i + 1, len(own) + 1) if fits(c := sum(own[i:j])))


def check(spark, texts, n=8):
    rows = shards.report(frame(spark, texts), shards=n).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (by[i].size, by[i].text_crc32, by[i].law, by[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    where = {}
    for i, t in enumerate(texts):
        where.setdefault(hashlib.md5((t or "").encode()).digest(), set()).add(by[i].shard)
    assert all(len(x) == 1 for x in where.values())  # groups stay whole
    order = [min(where[d]) for d, _ in sizes(texts)]
    assert order == sorted(order) and 0 <= order[0] and order[-1] < n  # runs of the order of digests
    load = {}
    for r in rows:
        load.setdefault(r.shard, []).append(r)
    assert max(sum(r.size for r in x) for x in load.values()) <= least_capacity([s for _, s in sizes(texts)], n)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in load.values())
    return load


def test_odd_texts(spark):
    check(spark, ODD)
    assert shards.report(frame(spark, [])).count() == 0
    assert shards.report(frame(spark, ["a"])).collect()[0].slot == 0


def test_even_and_lumpy(spark):
    rng = random.Random(1)
    check(spark, ["w" * rng.randrange(1, 300) + str(i) for i in range(120)])
    load = check(spark, ["hot text " * 9] * 100 + ["w" * rng.randrange(1, 300) + str(i) for i in range(100)])
    assert len(load) == 8
    check(spark, ["one text"] * 50, 3)


@pytest.mark.parametrize("limits", [{"at_once": 2, "hold": 0}, {"at_once": 7, "hold": 3}, {"at_once": 512, "hold": 20}])
def test_narrowing_by_spark_gives_the_same(spark, tmp_path, limits):
    rng = random.Random(2)
    texts = ["hot"] * 90 + ["w" * rng.randrange(1, 60) + str(i) for i in range(60)]
    groups = spark.createDataFrame([(bytearray(d), s) for d, s in sizes(texts)], "digest binary, size long")
    own = shards.Sums(groups, str(tmp_path / "sums"), bits=4)
    places = {p: d for p, d in zip(__import__("itertools").accumulate(s for _, s in sizes(texts)), (d for d, _ in sizes(texts)))}
    for t in (0, 1, 17, 300, own.total - 1, own.total):
        assert own.below([t])[0].upto == max([p for p in places if p <= t], default=0)
    assert shards.capacity(own, 4, **limits) == least_capacity([s for _, s in sizes(texts)], 4)
    ends = shards.cuts(own, 4, **limits)
    assert [sum(s for d, s in sizes(texts) if d <= e.digest) for e in ends] == [e.upto for e in ends]


def test_repeated_rows_null_ids_and_clashing_names(spark, tmp_path):
    docs = frame(spark, ["a b", None, "c"] * 20).selectExpr("case when doc_id > 3 then doc_id % 4 end as doc_id", "text", "text as shard", "lang as slot", "source as part")
    rows = shards.report(docs).collect()
    assert len(rows) == 60 and sum(r.doc_id is None for r in rows) == 4
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    placed = shards.place(docs, shards.plan(docs))
    assert placed.columns == [*docs.columns, "shard_"] and placed.count() == 60
    shards.write(docs, str(tmp_path / "out"), shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    again = frame(spark, ODD)
    assert unchanged(again, shards.place(again, shards.plan(again)).drop("shard"))
    with pytest.raises(ValueError):
        shards.plan(docs, shards=0)
