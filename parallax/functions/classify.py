"""Classes of changes, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smart_change_type(same_file: Column, same_name: Column, similarity: Column) -> Column:
    return F.when(~same_file & same_name, "cross_file_move").when(~same_name & (similarity > 0.9), "rename").when(~same_file, "move").otherwise("modify")


def change_type(source: Column, target: Column) -> Column:
    """Structs of name, file_path, start_line; a null side means added or deleted."""
    return (
        F.when(source.isNull(), "add")
        .when(target.isNull(), "delete")
        .when((source["file_path"] != target["file_path"]) & (source["name"] == target["name"]), "cross_file_move")
        .when(source["name"] != target["name"], "rename")
        .when(source["start_line"] != target["start_line"], "move")
        .otherwise("modify")
    )


def report_type(same_file: Column, same_name: Column) -> Column:
    return F.when(~same_file, "moved").when(~same_name, "renamed").otherwise("modified")


def is_unchanged_move(same_file: Column, same_name: Column, similarity: Column) -> Column:
    return ~same_file & same_name & (similarity >= 0.95)


def web_change_type(same_file_name: Column, same_name: Column, similarity: Column) -> Column:
    return F.when(similarity >= 0.99, "identical").when(~same_file_name, "moved").when(~same_name & (similarity >= 0.85), "renamed").otherwise("modified")


def magnitude(kind: Column, similarity: Column) -> Column:
    return F.when(kind.isin("added", "deleted"), 1.0).when(kind == "modified", 1 - similarity).when(kind == "renamed", 0.3).when(kind == "moved", 0.2).otherwise(0.0)


#: Order of change types in reports (fixed values).
PRIORITY = {"modified": 0, "added": 1, "deleted": 2, "renamed": 3, "moved": 4}


def priority(kind: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for name, n in PRIORITY.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


#: What each kind of change takes off the overall similarity (fixed values).
PENALTY = {"added": 0.3, "deleted": 0.3, "moved": 0.1, "renamed": 0.1, "modified": 0.2, "cross_file_move": 0.4, "split": 0.5, "merged": 0.5}


def penalty(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, p in PENALTY.items():
        out = F.when(kind == name, p).otherwise(out)
    return out


def line_tags(a: Column, b: Column) -> Column:
    """Which of conditions, returns and assignments appear on one side only."""
    flips = [F.when(a.contains(p) != b.contains(p), t) for p, t in (("if", "Control flow change"), ("return", "Return statement change"), ("=", "Assignment change"))]
    return F.array_compact(F.array(*flips))


def move_ladder(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "simple_move").when(similarity >= 0.85, "move_with_modification").when(similarity >= 0.75, "refactoring_move").otherwise("complex_move")


def is_significant(kind: Column, score: Column) -> Column:
    """Modifications matter if unscored or under .8, all others always."""
    return F.when(kind == "modified", F.coalesce(score < 0.8, F.lit(True))).otherwise(True)


def complexity_score(similarity: Column, same_name: Column, same_file: Column, same_line: Column, cyclomatic_delta: Column) -> Column:
    where = F.when(~same_file, 1.0).when(~same_line, 0.3).otherwise(0.0)
    return 2 * (1 - similarity) + 0.5 * (~same_name).cast("double") + where + 0.1 * F.abs(cyclomatic_delta)


def risk_level(score: Column) -> Column:
    return F.when(score >= 3, "critical").when(score >= 2, "high").when(score >= 1, "medium").otherwise("low")


def similarity_bucket(s: Column) -> Column:
    return F.when(s > 0.95, "high").when(s >= 0.7, "medium").otherwise("low")


def complexity_bucket(n: Column) -> Column:
    return F.when(n <= 5, "simple").when(n <= 15, "moderate").otherwise("complex")


def all_contain(name: Column, others: Column) -> Column:
    return F.forall(others, lambda x: F.lower(x).contains(F.lower(name)))


def contained_in_all(name: Column, others: Column) -> Column:
    return F.forall(others, lambda x: F.lower(name).contains(F.lower(x)))


def detailed(source: Column, target: Column, similarity: Column) -> Column:
    """Primary type, the other types that fit, and evidence of a matched pair."""
    renamed = (source["name"] != target["name"]) & (similarity > 0.8)
    moved = (source["file_path"] != target["file_path"]) & (similarity > 0.9)
    resigned = ~source["signature"].eqNullSafe(target["signature"])
    kinds = F.array_compact(F.array(F.when(moved, "move"), F.when(renamed, "rename"), F.when(resigned, "signature"), F.when(similarity < 1, "modify")))
    evidence = F.array_compact(F.array(F.when(source["name"] != target["name"], F.format_string("name: %s -> %s", source["name"], target["name"])), F.when(source["file_path"] != target["file_path"], F.format_string("file: %s -> %s", source["file_path"], target["file_path"])), F.when(resigned, F.lit("signature differs"))))
    return F.struct(F.coalesce(F.get(kinds, 0), F.lit("unchanged")).alias("primary"), F.slice(kinds, 2, 8).alias("secondary"), evidence.alias("evidence"), risk_level(4 * (1 - similarity)).alias("risk"))
