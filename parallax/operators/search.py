"""Searches in texts and names, and set differences of what code mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions import similarity, text


def grep(files: DataFrame, query: str, *, max_results: int | None = None) -> DataFrame:
    """(path, score, n_lines, first_line, first_column): 1 for a file name that has the query, .5 for each line that has it."""
    q = query.lower()
    lines = F.transform(F.split(F.lower("content"), "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.instr(x, q).alias("col")))
    own = files.select("path", F.lower(text.file_name(F.col("path"))).contains(q).alias("named"), F.filter(lines, lambda x: x["col"] > 0).alias("hits"))
    scored = own.select("path", (F.col("named").cast("double") + 0.5 * F.size("hits")).alias("score"), F.size("hits").alias("n_lines"), F.get("hits", F.lit(0))["line"].alias("first_line"), F.get("hits", F.lit(0))["col"].alias("first_column")).where("score > 0")
    return scored.orderBy(F.desc("score"), "path").limit(max_results) if max_results else scored


def search_names(names: DataFrame, query: str, mode: str = "partial", *, limit: int | None = 50) -> DataFrame:
    """Rows whose name fits: exact, partial, word, regex or fuzzy (contained, or at most two edits)."""
    n, q = F.col("name"), F.lit(query)
    fit = {
        "exact": n == q,
        "partial": F.lower(n).contains(query.lower()),
        "word": n.rlike(r"(?i)\b" + "".join("\\" + c if not c.isalnum() else c for c in query) + r"\b"),
        "regex": n.rlike(query) if mode == "regex" else F.lit(False),
        "fuzzy": F.lower(n).contains(query.lower()) | (F.levenshtein(F.lower(n), F.lit(query.lower()), 2) >= 0),
    }[mode]
    found = names.where(fit).withColumn("relevance", similarity.search_similarity(q, n))
    return found.orderBy(F.desc("relevance"), "name").limit(limit) if limit else found


def listed(matched: DataFrame, added: DataFrame, deleted: DataFrame, *, query: str | None = None, sort_by: str = "name", limit: int = 1000) -> DataFrame:
    """Three categories (name, address, similarity) as one list with one limit, in order of category, then of the sort key."""
    rows = None
    for rank, (name, d) in enumerate((("matched", matched), ("added", added), ("deleted", deleted))):
        one = d.select(F.lit(name).alias("category"), F.lit(rank).alias("__rank"), "name", "address", "similarity")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where(F.lower("name").contains(query.lower())) if query else rows
    key = F.col("similarity").desc_nulls_last() if sort_by == "similarity" else F.col(sort_by).asc()
    return rows.orderBy("__rank", key, "name").limit(limit).drop("__rank")


CONSTANTS = r"\b(?:0[xX][0-9A-Fa-f]+|[0-9]+)\b"
CALLS = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("


def constants(code: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(CONSTANTS), F.lit(0))))


def calls(code: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(CALLS), F.lit(1))))


def set_differences(pairs: DataFrame, of) -> DataFrame:
    """Per pair (pair_id, source, target): what only one side or both sides have, by an extractor of a text."""
    a, b = of(F.col("source")), of(F.col("target"))
    own = pairs.select("pair_id", a.alias("a"), b.alias("b"))
    return own.select("pair_id", F.array_sort(F.array_except("a", "b")).alias("removed"), F.array_sort(F.array_except("b", "a")).alias("added"), F.array_sort(F.array_intersect("a", "b")).alias("common"))


def argument_drift(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Calls of both sides whose mean number of arguments differs by more than the least. pairs: pair_id, source, target."""

    def counted(side: str) -> DataFrame:
        found = F.regexp_extract_all(side, F.lit(r"\b([A-Za-z_]\w*)\s*\([^()]*\)"), F.lit(0))
        one = pairs.select("pair_id", F.explode(found).alias("c"))
        inner = F.trim(F.regexp_extract("c", r"\(([^()]*)\)", 1))
        n = F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))
        return one.select("pair_id", F.regexp_extract("c", CALLS, 1).alias("call"), n.alias("n")).groupBy("pair_id", "call").agg(F.avg("n").alias(f"n_{side}"))

    both = counted("source").join(counted("target"), ["pair_id", "call"])
    return both.where(F.abs(F.col("n_source") - F.col("n_target")) > least)


#: Characters of words, the same in all engines, whatever they take for a word's border.
WORD = r"[\p{L}\p{M}\p{N}_]"


def control_flow(code: Column) -> Column:
    """Numbers of conditions, loops, switches and returns, and the deepest nesting of braces."""
    count = lambda w: F.size(F.regexp_extract_all(code, F.lit(f"(?<!{WORD}){w}(?!{WORD})"), F.lit(0)))
    braces = F.split(F.regexp_replace(code, r"[^{}]", ""), "")
    walk = F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(x == "{", 1).otherwise(0)).alias("most")), lambda s: s["most"])
    return F.struct(count("if").alias("n_if"), (count("for") + count("while")).alias("n_loop"), count("switch").alias("n_switch"), count("return").alias("n_return"), walk.alias("max_nesting"))
