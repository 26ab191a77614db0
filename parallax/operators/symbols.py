"""Symbols, scopes and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.operators.checkpoints import cut
from parallax.operators.graph import ancestors

NEAR_LINES = 10


def migrations(a: DataFrame, b: DataFrame, near: int = NEAR_LINES) -> DataFrame:
    """(name, kind, from_file, to_file, by): symbols no longer in their file.

    By equal name and kind in another file (the first by path); of what is left, another name of the kind at most ``near`` lines away,
    the nearest, then the first by path and name. Of the names on one line of a kind only the first can be chosen, and the nearest of
    them is found for each line of a kind, once for all symbols on it. a, b: name, kind, file_path, line.
    """
    gone = cut(a.join(b.select("name", "kind", "file_path"), ["name", "kind", "file_path"], "left_anti"))
    new = cut(b.join(a.select("name", "kind", "file_path"), ["name", "kind", "file_path"], "left_anti"))
    exact = cut(gone.join(new.groupBy("name", "kind").agg(F.min("file_path").alias("to_file")), ["name", "kind"]).select("name", "kind", F.col("file_path").alias("from_file"), "to_file", F.lit("name").alias("by")))
    rest = cut(gone.join(exact.select("name", "kind", F.col("from_file").alias("file_path")), ["name", "kind", "file_path"], "left_anti"))
    free = new.join(exact.select("name", "kind", F.col("to_file").alias("file_path")), ["name", "kind", "file_path"], "left_anti")
    offers = free.groupBy("kind", "line").agg(F.min(F.struct("file_path", "name")).alias("t"))
    asked = rest.select("kind", F.col("line").alias("own")).distinct().select("kind", "own", F.explode(F.sequence(F.col("own") - near, F.col("own") + near)).alias("line"))
    offered = asked.join(offers, ["kind", "line"]).groupBy("kind", F.col("own").alias("line")).agg(F.min(F.struct(F.abs(F.col("own") - F.col("line")).alias("far"), "t")).alias("nearest"))
    close = rest.join(offered, ["kind", "line"]).groupBy("name", "kind", F.col("file_path").alias("from_file")).agg(F.min("nearest").alias("nearest"))
    return exact.unionByName(close.select("name", "kind", "from_file", F.col("nearest.t.file_path").alias("to_file"), F.lit("line").alias("by")))


def by_file_pair(moved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Migrations of each pair of files, with their share of the source file's symbols."""
    size = symbols.groupBy(F.col("file_path").alias("from_file")).agg(F.count("*").alias("n_symbols"))
    own = moved.groupBy("from_file", "to_file").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
    return own.join(size, "from_file").withColumn("share", F.col("n") / F.col("n_symbols"))


def dependency_changes(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, dependency, change): +1 for what only the target depends on, -1 for the reverse. a, b: id, deps (array)."""
    both = matches.select("a", "b").join(a.select(F.col("id").alias("a"), F.col("deps").alias("old")), "a").join(b.select(F.col("id").alias("b"), F.col("deps").alias("new")), "b")
    added = both.select("a", "b", F.explode(F.array_except("new", "old")).alias("dependency"), F.lit(1).alias("change"))
    return added.unionByName(both.select("a", "b", F.explode(F.array_except("old", "new")).alias("dependency"), F.lit(-1).alias("change")))


def resolve(refs: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """The symbol of the nearest scope for each reference, and whether a further scope defines the name too.

    refs: ref_id, name, scope_id; symbols: name, scope_id and more; scopes: scope_id, parent_id.
    """
    up = ancestors(scopes.where("parent_id is not null").select(F.col("scope_id").alias("child"), F.col("parent_id").alias("parent")))
    own = scopes.select(F.col("scope_id").alias("node"), F.col("scope_id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(up)
    seen = refs.join(own, refs["scope_id"] == own["node"]).select("ref_id", "name", F.col("ancestor").alias("scope_id"), "depth").join(symbols, ["name", "scope_id"])
    rest = [c for c in symbols.columns if c != "name"]
    return seen.groupBy("ref_id", "name").agg(F.min_by(F.struct(*rest), "depth").alias("symbol"), (F.count_distinct("depth") > 1).alias("is_shadowed")).select("ref_id", "name", "symbol.*", "is_shadowed")


def shadowed(symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """(name, scope_id, outer_scope_id) of symbols that hide one of an enclosing scope."""
    up = ancestors(scopes.where("parent_id is not null").select(F.col("scope_id").alias("child"), F.col("parent_id").alias("parent")))
    outer = symbols.select("name", F.col("scope_id").alias("ancestor"))
    return symbols.join(up, symbols["scope_id"] == up["node"]).select("name", "scope_id", "ancestor").join(outer, ["name", "ancestor"]).select("name", "scope_id", F.col("ancestor").alias("outer_scope_id")).distinct()


def scope_statistics(scopes: DataFrame) -> DataFrame:
    """scope_type, n, max_depth, avg_depth."""
    from parallax.operators.graph import depths

    deep = depths(scopes.where("parent_id is not null").select(F.col("scope_id").alias("child"), F.col("parent_id").alias("parent")), cap=64)
    own = scopes.join(deep, scopes["scope_id"] == deep["node"], "left")
    return own.groupBy("scope_type").agg(F.count("*").alias("n"), F.max(F.coalesce("depth", F.lit(0))).alias("max_depth"), F.avg(F.coalesce("depth", F.lit(0))).alias("avg_depth"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two symbol tables as one: b's entry wins for the same name and scope."""
    both = a.withColumn("__from", F.lit(0)).unionByName(b.withColumn("__from", F.lit(1)))
    rest = [c for c in a.columns if c not in ("name", "scope_id")]
    return both.groupBy("name", "scope_id").agg(F.max_by(F.struct(*rest), "__from").alias("x")).select("name", "scope_id", "x.*")


def references(refs: DataFrame) -> DataFrame:
    """Distinct references of each symbol."""
    return refs.distinct().groupBy("symbol").agg(F.count("*").alias("n_refs"), F.count_distinct("file_path").alias("n_files"))
