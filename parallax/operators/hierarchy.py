"""Class hierarchies: moves, method migrations, changed parents, interfaces. Tables: classes (name, parent, file_path, methods, fields, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions import similarity
from parallax.operators.graph import ancestors, siblings
from parallax.operators.matching import best


def preserved(a: Column, b: Column) -> Column:
    """Share of a's members that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def class_moves(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Equally named classes in another file: .3 name + .3 methods + .2 fields + .1 parent + .1 interfaces kept."""
    x = a.select("name", F.struct("*").alias("s")).join(b.select("name", F.struct("*").alias("t")), "name").where("s.file_path <> t.file_path")
    s, t = F.col("s"), F.col("t")
    names = lambda c: F.transform(c, lambda m: m["name"])
    score = 0.3 + 0.3 * preserved(names(s["methods"]), names(t["methods"])) + 0.2 * preserved(names(s["fields"]), names(t["fields"])) + 0.1 * s["parent"].eqNullSafe(t["parent"]).cast("double") + 0.1 * (F.array_sort(s["interfaces"]) == F.array_sort(t["interfaces"])).cast("double")
    return x.select("name", s["file_path"].alias("from_file"), t["file_path"].alias("to_file"), score.alias("confidence")).where(F.col("confidence") >= threshold)


def normalised_signature(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"\s", ""))


def method_migrations(a: DataFrame, b: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Methods missing from the class of the same name, with the best class that has one of the same normalised signature.

    a, b: class_name, name, signature, visibility, is_static, is_abstract (a row for each method).
    """
    key = lambda d: d.withColumn("sig", normalised_signature(F.col("signature")))
    x, y = key(a), key(b)
    gone = x.join(y.select("class_name", "sig"), ["class_name", "sig"], "left_anti").join(b.select("class_name").distinct(), "class_name", "left_semi")
    pairs = gone.select("sig", F.struct("*").alias("s")).join(y.select("sig", F.struct("*").alias("t")), "sig").where("s.class_name <> t.class_name")
    scored = pairs.select(F.concat_ws(".", "s.class_name", "s.name").alias("a"), F.col("t.class_name").alias("b"), F.col("s.class_name").alias("from_class"), F.col("s.name").alias("method"), similarity.method_similarity(F.col("s"), F.col("t")).alias("score"))
    return best(scored.where(F.col("score") >= threshold)).select("from_class", F.col("b").alias("to_class"), "method", "score")


def migration_kinds(migrations: DataFrame, parents: DataFrame, old_classes: DataFrame) -> DataFrame:
    """Pull up (the target is an ancestor), push down (a descendant), to a sibling, to a new class, or unrelated."""
    up = ancestors(parents).select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
    side = siblings(parents)
    side = side.union(side.select("b", "a")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    mark = lambda d, name: d.select("x", "y", F.lit(True).alias(name)).distinct()
    own = migrations.withColumns({"x": F.col("from_class"), "y": F.col("to_class")})
    own = own.join(mark(up, "__up"), ["x", "y"], "left").join(mark(up.select(F.col("y").alias("x"), F.col("x").alias("y")), "__down"), ["x", "y"], "left").join(mark(side, "__side"), ["x", "y"], "left")
    own = own.join(old_classes.select(F.col("name").alias("y"), F.lit(True).alias("__old")).distinct(), "y", "left")
    kind = F.when(F.col("__old").isNull(), "new_class").when(F.col("__up"), "pull_up").when(F.col("__down"), "push_down").when(F.col("__side"), "sibling").otherwise("unrelated")
    return own.withColumn("kind", kind).drop("x", "y", "__up", "__down", "__side", "__old")


def hierarchy_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes of both versions whose parent changed (name, old_parent, new_parent, kind)."""
    both = a.select("name", F.col("parent").alias("old_parent")).join(b.select("name", F.col("parent").alias("new_parent")), "name")
    kind = F.when(F.col("old_parent").isNull(), "parent_added").when(F.col("new_parent").isNull(), "parent_removed").otherwise("parent_changed")
    return both.where(~F.col("old_parent").eqNullSafe(F.col("new_parent"))).withColumn("kind", kind)


def flattened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parents that vanished whose methods their children now have: (name, parent, inlined)."""
    gone = a.select(F.col("name").alias("parent"), F.transform("methods", lambda m: m["name"]).alias("lost")).join(b.select(F.col("name").alias("parent")), "parent", "left_anti")
    child = a.select("name", "parent").join(b.select("name", F.transform("methods", lambda m: m["name"]).alias("has")), "name")
    return child.join(gone, "parent").select("name", "parent", F.size(F.array_intersect("lost", "has")).alias("inlined")).where("inlined > 0")


def member_changes(a: DataFrame, b: DataFrame, member: str) -> DataFrame:
    """What was added to and removed from an array column of equally named classes: (name, change, value)."""
    both = a.select("name", F.col(member).alias("old")).join(b.select("name", F.col(member).alias("new")), "name")
    added = both.select("name", F.lit("added").alias("change"), F.explode(F.array_except("new", "old")).alias("value"))
    return added.unionByName(both.select("name", F.lit("removed").alias("change"), F.explode(F.array_except("old", "new")).alias("value")))


def chains(parents: DataFrame) -> DataFrame:
    """(node, chain): ancestors from the nearest on."""
    return ancestors(parents).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("chain"))


def implementations(implements: DataFrame) -> DataFrame:
    """(interface, implementers) from (child, interface)."""
    return implements.groupBy("interface").agg(F.array_sort(F.collect_set("child")).alias("implementers"))


def statistics(moves: DataFrame, migrations: DataFrame, changes: DataFrame) -> DataFrame:
    count = lambda d, name: d.agg(F.count("*").alias(name))
    return count(moves, "n_moves").crossJoin(count(migrations, "n_migrations")).crossJoin(count(changes, "n_changes"))
