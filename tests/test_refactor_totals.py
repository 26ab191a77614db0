import random

from pyspark.sql import functions as F

from parallax.operators import refactor

SIDE = "struct<name:string,file_path:string,start_line:int,element_type:string,signature:string>"


def test_totals_are_those_of_all_pairs(spark):
    """Counted as those of the rows of patterns, ids that occur twice and missing parts included."""
    r = random.Random(3)
    names = ["readFile", "readFiles", "fileReader", "checkAll", "processRow", "sum", "writeFile", None]
    side = lambda: (r.choice(names), r.choice(["a", "b", None]) if r.random() < 0.2 else r.choice("ab"), r.choice([None, *range(0, 300, 7)]), r.choice(["function", "function", "class"]), r.choice("xy"))
    rows = []
    for i in range(240):
        kind = r.choice(["modify", "modify", "add", "delete", "rename", "move"])
        rows.append((i // 2 if i < 60 else i, kind, None if kind == "add" else side(), None if kind == "delete" else side(), r.choice([None, 0.4, 0.6, 0.9])))
    changes = spark.createDataFrame(rows, f"change_id long, change_type string, source {SIDE}, target {SIDE}, similarity double")
    for least in (0.0, 0.7, 0.8):
        every = refactor.patterns(changes, least).groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("c"))
        got = refactor.totals(changes, least).select("pattern", "n", F.round("mean_confidence", 9).alias("c"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) != []


def test_totals_make_no_pairs(spark):
    """3,000 modified and 3,000 deleted functions of one name: nine million pairs as one number."""
    side = lambda i: (f"same", f"f{i % 3}", i * 100, "function", "x")
    rows = [(i, "modify" if i % 2 else "delete", side(i), side(i) if i % 2 else None, 0.9) for i in range(6000)]
    changes = spark.createDataFrame(rows, f"change_id long, change_type string, source {SIDE}, target {SIDE}, similarity double")
    own = changes.withColumn("cluster", F.lit(0))
    numbers = refactor._numbers(own, "delete", "source", 0.5, names=False).collect()
    assert {(x.same_file, x.near): x.n for x in numbers} == {(False, False): 6_000_000, (True, False): 3_000_000} and len(numbers) == 2
