"""Matching of named things: exact, then fuzzy one-to-one, then what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.functions.similarity import edit_similarity
from parallax.operators.matching import greedy_in_order

MAX_EDITS = 3


def exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, name, score 1): equal names; of equal names in b the last by id stands for them all. a, b: id, name."""
    last = b.groupBy("name").agg(F.max("id").alias("b"))
    return a.select(F.col("id").alias("a"), "name").join(last, "name").select("a", "b", "name", F.lit(1.0).alias("score"))


def near_pairs(a: DataFrame, b: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """(x, y, distance) of distinct names within k edits, without comparing all.

    A name cut into k + 1 pieces keeps one of them whole under k edits, in a place shifted by at most k: pieces of one
    side are equi-joined with substrings of the other.
    """
    x = a.select(F.col("name").alias("x")).where("x is not null").distinct()
    y = b.select(F.col("name").alias("y")).where("y is not null").distinct()
    p = k + 1
    begin = lambda n, i: F.floor(n * i / p).cast("int")
    n = F.length("x")
    left = x.select("x", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    left = left.select("x", "n", "i", F.substring("x", begin(F.col("n"), F.col("i")) + 1, begin(F.col("n"), F.col("i") + 1) - begin(F.col("n"), F.col("i"))).alias("piece"))
    right = y.select("y", F.explode(F.sequence(F.greatest(F.lit(0), F.length("y") - k), F.length("y") + k)).alias("n"))
    right = right.select("y", "n", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    right = right.withColumn("s", begin(F.col("n"), F.col("i"))).withColumn("len", begin(F.col("n"), F.col("i") + 1) - F.col("s"))
    right = right.select("y", "n", "i", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda d: F.when((F.col("s") + d >= 0) & (F.col("s") + d + F.col("len") <= F.length("y")), F.substring("y", F.col("s") + d + 1, F.col("len")))))).alias("piece")).where("piece is not null")
    pairs = left.join(right, ["n", "i", "piece"]).select("x", "y").distinct()
    return pairs.withColumn("distance", F.levenshtein("x", "y", k)).where("distance >= 0")


def alike_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(x, y) of distinct names, x of a and y of b, with edit similarity over ``least``, without comparing all. a, b: name.

    Such names differ by fewer than (1 - least) x the longer length edits, k at most: one of k + 1 pieces of the longer name is whole
    in the shorter, shifted by at most k.
    """
    def names(d: DataFrame) -> DataFrame:
        return d.select("name").where("name is not null").distinct().withColumn("n", F.length("name"))

    def met(longer: DataFrame, shorter: DataFrame) -> DataFrame:
        k = F.greatest(F.lit(0), F.ceil((1 - least) * F.col("n")).cast("int") - 1)
        begin = lambda i: F.floor(F.col("n") * i / (F.col("k") + 1)).cast("int")
        x = names(longer).withColumn("k", k).select("name", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
        x = x.select(F.col("name").alias("x"), "n", "k", begin(F.col("i")).alias("at"), F.substring("name", begin(F.col("i")) + 1, begin(F.col("i") + 1) - begin(F.col("i"))).alias("piece"))
        x = x.withColumn("m", F.explode(F.sequence(F.col("n") - F.col("k"), F.col("n"))))
        size = F.explode(F.sequence(F.lit(1), F.ceil(1 / (1 - F.lit(least))).cast("int")))
        y = names(shorter).select(F.col("name").alias("y"), F.col("n").alias("m"), size.alias("size")).where("size <= m")
        y = y.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size")))).select("y", "m", "to", F.substring("y", F.col("to") + 1, F.col("size")).alias("piece"))
        return x.join(y, ["m", "piece"]).where(F.abs(F.col("at") - F.col("to")) <= F.col("k")).select("x", "y")

    both = met(a, b).unionByName(met(b, a).select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    return both.where(edit_similarity(F.col("x"), F.col("y")) > least)


def fuzzy_candidates(a: DataFrame, b: DataFrame, threshold: float = 0.7, k: int = MAX_EDITS) -> DataFrame:
    """(a, b, score): different rows of names within k edits whose edit similarity reaches the threshold."""
    near = near_pairs(a, b, k).withColumn("score", 1 - F.col("distance") / F.greatest(F.lit(1), F.length("x"), F.length("y"))).where(F.col("score") >= threshold)
    left = near.join(a.select(F.col("id").alias("a"), F.col("name").alias("x")), "x")
    return left.join(b.select(F.col("id").alias("b"), F.col("name").alias("y")), "y").select("a", "b", "score")


def match_names(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, added, deleted). matches: a, b, score, confidence, phase; each exact name, then fuzzy names of what is left."""
    sure = exact(a, b)
    rest_a = a.join(sure.select(F.col("a").alias("id")), "id", "left_anti")
    rest_b = b.join(sure.select(F.col("b").alias("id")), "id", "left_anti")
    fuzzy = greedy_in_order(fuzzy_candidates(rest_a, rest_b, threshold))
    matches = sure.select("a", "b", "score", F.lit(1.0).alias("confidence"), F.lit("exact").alias("phase")).unionByName(fuzzy.select("a", "b", "score", (0.8 * F.col("score")).alias("confidence"), F.lit("fuzzy").alias("phase")))
    added = b.join(matches.select(F.col("b").alias("id")), "id", "left_anti")
    deleted = a.join(matches.select(F.col("a").alias("id")), "id", "left_anti")
    return matches, added, deleted


def suggestions(names: DataFrame, query: str, n: int = 5) -> DataFrame:
    """The names most like a query."""
    from parallax.functions.similarity import search_similarity

    return names.select("name", search_similarity(F.lit(query), F.col("name")).alias("score")).orderBy(F.desc("score"), "name").limit(n)
