"""What the nodes of a function show: features of content, and sets of types, calls, checks of errors, resources and algorithms.

Nodes say by themselves what they show, as column expressions. Which functions hold them is found by one sweep over a file's
functions, loops and telling nodes in pre-order; what an inner function shows counts for those around it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.similarity import pattern_similarity, set_jaccard
from parallax.operators.checkpoints import cut, dealt

GROUPS = ("types", "apis", "errors", "resources", "algorithms", "content")

# What a called function's name must contain to show a pattern, and node types that show one.
CALL_PATTERNS = {
    "apis": {"accessor_pattern": ("get", "set"), "factory_pattern": ("create", "new"), "validation_pattern": ("validate", "check"), "processing_pattern": ("process", "transform")},
    "resources": {"resource_cleanup": ("close", "dispose"), "resource_acquisition": ("open", "connect")},
    "algorithms": {"sorting_algorithm": ("sort",), "search_algorithm": ("search", "find"), "recursion": ("recursive",)},
}
NODE_PATTERNS = {
    "errors": {"TryStatement": "try_catch", "ThrowStatement": "throw_exception"},
    "resources": {"TryStatement": "try_with_resources"},
    "algorithms": {"ForLoop": "iteration", "WhileLoop": "while_iteration", "IfStatement": "conditional_logic", "SwitchStatement": "multi_branch"},
}
ERROR_WORDS = ("null", "error", "exception")
CONTENT = {"Identifier": "id", "Literal": "lit", "BinaryExpression": "op"}
LOOPS = ("ForLoop", "WhileLoop")
_SCOPES = ("Function", "Method")

#: Words before a declared type.
_LEADING = r"^(?:(?:public|private|protected|internal|fileprivate|open|static|final|abstract|virtual|inline|const|override|async|export|default|readonly|volatile|transient|mutating|extern|let|var|auto)\b\s*)+"


def declared_type(declaration: Column) -> Column:
    """The type in a declaration such as ``private int a``, ``Map<K,V> a`` or ``let a: Int``; null if it names none."""
    bare = F.regexp_replace(F.trim(declaration), _LEADING, "")
    after = F.regexp_extract(bare, r"^[\w$ ]+\??:\s*(.+)$", 1)
    before = F.regexp_extract(bare, r"^(.*[\w>\]*&?])[\s*&]+[\w$]+$", 1)
    return F.nullif(F.trim(F.when(after != "", after).otherwise(before)), F.lit(""))


def marks(nodes: DataFrame) -> DataFrame:
    """Node rows with ``marks``: what each shows by itself, as (group, value)."""
    kind, get = F.col("node_type"), lambda k: F.col("attributes")[k]
    mark = lambda group, value: F.struct(F.lit(group).alias("group"), value.alias("value"))
    called = F.when(kind == "CallExpression", F.coalesce(get("function_name"), "text"))
    has = lambda c, words: F.coalesce(c.rlike("|".join(words)), F.lit(False))
    # Attributes of a declaration hold all of it; those of annotated names hold the type alone.
    declares = kind.isin("VariableDeclaration", "FieldDeclaration")
    type_ = F.when(declares, declared_type(get("type"))).otherwise(get("type"))
    shown = [F.when(type_.isNotNull(), mark("types", type_)), F.when(type_.isNotNull(), mark("content", F.concat(F.lit("type:"), type_)))]
    shown += [F.when(has(called, words), mark(group, F.lit(value))) for group, own in CALL_PATTERNS.items() for value, words in own.items()]
    shown += [F.when(kind == t, mark(group, F.lit(value))) for group, own in NODE_PATTERNS.items() for t, value in own.items()]
    shown.append(F.when((kind == "IfStatement") & has(get("condition"), ERROR_WORDS), mark("errors", F.lit("error_check"))))
    shown += [F.when((kind == t) & (F.col("text") != ""), mark("content", F.concat(F.lit(f"{p}:"), F.col("text")))) for t, p in CONTENT.items()]
    return nodes.withColumn("marks", F.array_compact(F.array(*shown)))


def function_patterns(nodes: DataFrame) -> DataFrame:
    """(file_id, pre, name, types, apis, errors, resources, algorithms, content): sorted sets of each function, and of each file as its root.

    A loop within a loop of the same function nests, a call of the name of the function around it is recursion. Files without nodes have
    no row, functions that show nothing have empty sets, nodes out of any function count for the root alone.
    """
    kind = F.col("node_type")
    telling = marks(nodes).where((F.size("marks") > 0) | kind.isin(*_SCOPES, *LOOPS, "CallExpression") | F.col("parent_pre").isNull())
    calls = F.when(kind == "CallExpression", F.regexp_extract(F.coalesce(F.col("attributes")["function_name"], "text"), r"(\w+)$", 1))
    packed = telling.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pre", "subtree_end_pre", "node_type", F.when(kind.isin(*_SCOPES), F.col("text")).alias("name"), calls.alias("callee"), F.col("parent_pre").isNull().alias("root"), "marks"))).alias("x"))

    def swept(file_id: str, xs) -> list[tuple]:
        rows, scopes, loops = [], [], []  # scopes: end, loops around, pre, name, sets

        def close() -> None:
            _, _, pre, name, sets = scopes.pop()
            rows.append((file_id, pre, name, *(sorted(sets[g]) for g in GROUPS)))
            if scopes:
                for g in GROUPS:
                    scopes[-1][4][g] |= sets[g]

        for x in xs:
            while scopes and scopes[-1][0] < x["pre"]:
                close()
            while loops and loops[-1] < x["pre"]:
                loops.pop()
            if x["root"] or x["name"] is not None:
                scopes.append((x["subtree_end_pre"], len(loops), x["pre"], x["name"] or "", {g: set() for g in GROUPS}))
            sets = scopes[-1][4]
            for m in x["marks"]:
                sets[m["group"]].add(m["value"])
            if x["callee"] and x["callee"] == scopes[-1][3]:
                sets["algorithms"].add("recursion")
            if x["node_type"] in LOOPS:
                if x["node_type"] == "ForLoop":
                    # The innermost of the functions in which there is a loop around this one; those around it get it from there.
                    around = next((s for s in reversed(scopes) if s[1] < len(loops)), None)
                    if around:
                        around[4]["algorithms"].add("nested_iteration")
                loops.append(x["subtree_end_pre"])
        while scopes:
            close()
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), *[pa.list_(pa.string())] * len(GROUPS)]
        for batch in batches:
            rows = [r for f, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in swept(f, xs)]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_id", "pre", "name", *GROUPS])

    return packed.mapInArrow(run, "file_id string, pre int, name string, " + ", ".join(f"{g} array<string>" for g in GROUPS))


def of_files(files: DataFrame) -> DataFrame:
    """``function_patterns`` of files (path, content): equal contents of one language are parsed once, however many files have them."""
    from parallax.operators import codefront, trees

    # What only the content tells of the language is asked of different contents.
    same = F.md5(F.concat(F.coalesce("lang", F.lit("")), F.coalesce(F.concat(F.lit("\n"), "content"), F.lit(""))).cast("binary")).alias("same")
    own = files.select(F.col("path").cast("string").alias("file_id"), "content", codefront.node_language_of_path(F.col("path")).alias("lang"))
    once = own.select("lang", "content").distinct().select(same.alias("file_id"), "content", F.coalesce("lang", codefront.language_of_content(F.col("content"))).alias("lang"))
    parsed = function_patterns(trees.parse(dealt(once, "file_id"), F.col("lang")))
    return own.select("file_id", same).join(cut(parsed).withColumnRenamed("file_id", "same"), "same").drop("same")


def scores(pairs: DataFrame, patterns: DataFrame, *key: str) -> DataFrame:
    """(a, b, content, semantic): shared share of content, and mean share of the five sets. pairs: a, b (structs or values of the key of patterns).

    Sets travel once for each different pair of them; pairs of functions carry digests.
    """
    sets = F.struct(*GROUPS)
    own = patterns.select((F.struct(*key) if len(key) > 1 else F.col(key[0])).alias("k"), sets.alias("p"), F.md5(F.to_json(sets).cast("binary")).alias("d"))
    side = lambda s: own.select(F.col("k").alias(s), F.col("d").alias(f"d_{s}"))
    both = cut(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"))
    known = own.select("d", "p").distinct()
    x, y = F.col("x"), F.col("y")
    of = lambda s, p: known.select(F.col("d").alias(f"d_{s}"), F.col("p").alias(p))
    scored = both.select("d_a", "d_b").distinct().join(of("a", "x"), "d_a").join(of("b", "y"), "d_b").select("d_a", "d_b", set_jaccard(x["content"], y["content"]).alias("content"), pattern_similarity(x, y).alias("semantic"))
    return both.join(scored, ["d_a", "d_b"]).select("a", "b", "content", "semantic")
