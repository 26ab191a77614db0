"""Versions joined by key: what was added, deleted, renamed or modified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions import classify


def keyed_diff(a: DataFrame, b: DataFrame, key: list[str], name: str, values: list[str], similarity: Column | None = None) -> DataFrame:
    """One full outer join on the key; a pair is renamed if its name differs, else modified if a value does.

    Output: the key, change_type, source and target (structs of name and values), similarity.
    """
    side = lambda d, s: d.select(*key, F.struct(name, *values).alias(s))
    both = side(a, "source").join(side(b, "target"), key, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"source.{v}").eqNullSafe(F.col(f"target.{v}"))
    kind = (
        F.when(F.col("source").isNull(), "added")
        .when(F.col("target").isNull(), "deleted")
        .when(~F.col(f"source.{name}").eqNullSafe(F.col(f"target.{name}")), "renamed")
        .when(differs, "modified")
        .otherwise("same")
    )
    same = F.lit(0.0)
    for v in values:
        same = same + F.col(f"source.{v}").eqNullSafe(F.col(f"target.{v}")).cast("double")
    score = similarity if similarity is not None else same / max(1, len(values))
    paired = F.col("source").isNotNull() & F.col("target").isNotNull()
    return both.withColumn("change_type", kind).withColumn("similarity", F.when(paired, score))


def with_magnitude(changes: DataFrame) -> DataFrame:
    return changes.withColumn("magnitude", classify.magnitude(F.col("change_type"), F.col("similarity")))


def ranked(changes: DataFrame, name: str, *, limit: int | None = 100, types: tuple[str, ...] = (), min_magnitude: float = 0.0) -> DataFrame:
    """Changes by priority of type, then magnitude, then name; a limit turns the sort into a top-k."""
    own = changes.where(F.col("change_type") != "same").where(F.col("magnitude") >= min_magnitude)
    own = own.where(F.col("change_type").isin(*types)) if types else own
    own = own.orderBy(classify.priority(F.col("change_type")), F.col("magnitude").desc(), name)
    return own.limit(limit) if limit else own


def file_diff(a: DataFrame, b: DataFrame, score: Column) -> DataFrame:
    """Files by relative path: unchanged if similarity is .99 or more. a, b: rel_path and what score needs, as source and target."""
    both = a.select("rel_path", F.struct("*").alias("source")).join(b.select("rel_path", F.struct("*").alias("target")), "rel_path", "full_outer")
    s = F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), score)
    kind = F.when(F.col("source").isNull(), "added").when(F.col("target").isNull(), "deleted").when(s >= 0.99, "unchanged").otherwise("modified")
    return both.select("rel_path", kind.alias("status"), s.alias("similarity"), "source", "target")


def line_overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Per key: lines of a that b has, over the longer number of lines. a, b: key and line, a row each."""
    known = b.select(*key, "line").distinct().withColumn("__known", F.lit(True))
    hits = a.join(known, [*key, "line"], "left").groupBy(*key).agg(F.count("*").alias("n_a"), F.count("__known").alias("n_hit"))
    size = b.groupBy(*key).agg(F.count("*").alias("n_b"))
    out = hits.join(size, key, "full_outer").fillna(0, ["n_a", "n_hit", "n_b"])
    return out.withColumn("similarity", F.when(F.greatest("n_a", "n_b") == 0, 1.0).otherwise(F.col("n_hit") / F.greatest("n_a", "n_b")))
