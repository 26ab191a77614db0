from pyspark.sql import functions as F

from parallax.operators import codefront, patterns, trees
from test_patterns import JAVA, PYTHON


def test_equal_contents_are_parsed_once(spark, monkeypatch):
    """Sets as of each file by itself; a content goes to the parser once for each language that it is parsed by."""
    rows = [(f"{i}.java", JAVA) for i in range(20)] + [("a.py", PYTHON), ("b.py", PYTHON), ("c.py", JAVA), ("null.txt", None), ("none.txt", ""), ("other.txt", None)]
    files = spark.createDataFrame(rows, "path string, content string").repartition(4)
    want = patterns.function_patterns(codefront.source_nodes(files))
    asked, parse = [], trees.parse
    monkeypatch.setattr(trees, "parse", lambda d, *a, **k: asked.append(d) or parse(d, *a, **k))
    got = patterns.of_files(files)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert asked[-1].count() == len({("Java", JAVA), ("Python", PYTHON), ("Python", JAVA), ("Unknown", None), ("Unknown", "")})


def test_scores_of_many_pairs_of_few_sets(spark):
    """A row for each pair, as the scores of its own sets, where many functions have the same ones."""
    sets = lambda t, a: (t, a, [], [], ["iteration"], [f"id:{x}" for x in a])
    kinds = [sets([], []), sets(["int"], []), sets([], ["int"]), sets(["int"], ["get", "set"])]
    own = spark.createDataFrame([(i, *kinds[i % 4]) for i in range(80)], "k long, types array<string>, apis array<string>, errors array<string>, resources array<string>, algorithms array<string>, content array<string>")
    pairs = spark.range(79).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(4)).alias("b"))
    got = {(r.a, r.b): (r.content, round(r.semantic, 6)) for r in patterns.scores(pairs, own, "k").collect()}
    assert len(got) == len([1 for i in range(79) if i % 2 == 0 or i + 4 < 80])
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    for (a, b), (content, semantic) in got.items():
        x, y = kinds[a % 4], kinds[b % 4]
        assert content == j(x[5], y[5]) and abs(semantic - sum(j(x[i], y[i]) for i in range(5)) / 5) < 1e-6
