"""Pair scores between 0 and 1, as column expressions.

All are null if an argument is null, unless said otherwise. Lengths and distances count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))


def set_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared share of two arrays taken as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the distinct characters: 1 if equal, 0 if one is empty."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(set_jaccard(_chars(a), _chars(b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def normalised_name(a: Column) -> Column:
    return F.regexp_replace(F.lower(a), "_", "")


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, .95 if equal but for case and underscores, else the edit similarity of what is left."""
    x, y = normalised_name(a), normalised_name(b)
    return F.when(a == b, 1.0).when(x == y, 0.95).otherwise(edit_similarity(x, y))


def count_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger count; 1 if both are 0."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def signature_similarity(a: Column, b: Column) -> Column:
    """.4 name + .3 number of parameters + .2 return type (both absent match) + .1 shared modifiers.

    Structs of name, params (array), return_type, modifiers (array).
    """
    most = F.greatest(F.size(a["modifiers"]), F.size(b["modifiers"]))
    common = F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a["modifiers"], b["modifiers"])) / most)
    same_return = a["return_type"].eqNullSafe(b["return_type"]).cast("double")
    return 0.4 * edit_similarity(a["name"], b["name"]) + 0.3 * count_similarity(F.size(a["params"]), F.size(b["params"])) + 0.2 * same_return + 0.1 * common


# Names that different languages use for one type, and families of related types.
TYPE_NAMES = {
    "int": ("int", "Int32", "i32", "integer", "Integer"),
    "long": ("long", "Int64", "i64", "Long"),
    "float": ("float", "Float32", "f32", "Float"),
    "double": ("double", "Float64", "f64", "Double"),
    "string": ("str", "String", "string", "std::string"),
    "bool": ("bool", "Boolean", "boolean"),
    "char": ("char", "Character"),
    "byte": ("byte", "Byte", "u8", "i8"),
    "short": ("short", "Short", "i16", "u16"),
    "void": ("void", "None", "null", "undefined"),
}
FAMILIES = (("int", "long", "float", "double", "byte", "short"), ("string", "String", "str", "char*"), ("List", "ArrayList", "Vector", "Array"))


def normalised_type(t: Column) -> Column:
    bare = F.trim(t)
    out = bare
    for name, same in TYPE_NAMES.items():
        out = F.when(bare.isin(*same), F.lit(name)).otherwise(out)
    return out


def _base(t: Column) -> Column:
    return F.trim(F.regexp_extract(t, r"^([^<\[]*)", 1))


def _generics(t: Column) -> Column:
    inner = F.regexp_extract(t, r"<(.*)>", 1)
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(inner, ","), F.trim))


def _dims(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, r"\[\]", "["))


def type_base_similarity(a: Column, b: Column) -> Column:
    related = F.lit(False)
    for family in FAMILIES:
        related = related | (a.isin(*family) & b.isin(*family))
    return F.when(normalised_type(a) == normalised_type(b), 1.0).when(related, 0.7).otherwise(0.0)


def type_similarity(a: Column, b: Column) -> Column:
    """.6 base + .3 type arguments (a flat comparison of each; .3 of it if their numbers differ) + .1 array dimensions (half if both are arrays)."""
    g, h = _generics(a), _generics(b)
    inner = F.aggregate(F.zip_with(g, h, lambda x, y: 0.6 * type_base_similarity(_base(x), _base(y)) + 0.4), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.lit(1), F.size(g))
    args = F.when(F.size(g) != F.size(h), 0.3).when(F.size(g) == 0, 1.0).otherwise(inner)
    dims = F.when(_dims(a) == _dims(b), 1.0).when((_dims(a) > 0) & (_dims(b) > 0), 0.5).otherwise(0.0)
    return 0.6 * type_base_similarity(_base(a), _base(b)) + 0.3 * args + 0.1 * dims


def parameter_similarity(a: Column, b: Column) -> Column:
    """Mean over positions of types (.7) and names (.3), over the longer list; arrays of struct(name, type)."""
    each = F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), 0.0).otherwise(0.7 * F.coalesce(type_similarity(x["type"], y["type"]), x["type"].eqNullSafe(y["type"]).cast("double")) + 0.3 * (x["name"] == y["name"]).cast("double")))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / longest)


def enhanced_signature_similarity(a: Column, b: Column) -> Column:
    """.4 name + .3 parameters + .2 return type + .1 modifiers; structs as in signature_similarity with typed params."""
    both_none = a["return_type"].isNull() & b["return_type"].isNull()
    returns = F.when(both_none, 1.0).otherwise(F.coalesce(type_similarity(a["return_type"], b["return_type"]), F.lit(0.0)))
    return 0.4 * name_similarity(a["name"], b["name"]) + 0.3 * parameter_similarity(a["params"], b["params"]) + 0.2 * returns + 0.1 * set_jaccard(a["modifiers"], b["modifiers"])


def element_similarity(a: Column, b: Column) -> Column:
    """0 for different element types, else .4 name + .4 signature + .2 equal hash."""
    score = 0.4 * edit_similarity(a["name"], b["name"]) + 0.4 * edit_similarity(F.coalesce(a["signature"], F.lit("")), F.coalesce(b["signature"], F.lit(""))) + 0.2 * (a["hash"] == b["hash"]).cast("double")
    return F.when(a["element_type"] != b["element_type"], 0.0).otherwise(score)


def shallow_body_similarity(a: Column, b: Column) -> Column:
    """.15 node counts + .15 depths + .7 distinct characters of the text; structs of node_count, depth, body."""
    return 0.15 * count_similarity(a["node_count"], b["node_count"]) + 0.15 * count_similarity(a["depth"], b["depth"]) + 0.7 * char_jaccard(a["body"], b["body"])


def call_overlap(a: Column, b: Column) -> Column:
    """Calls of a that b has, over the longer list; 1 if both are empty. Not symmetric: repeats of a count."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x))) / longest)


def line_similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal places over the longer, times shorter over longer length, of trimmed lines."""
    x, y = F.trim(a), F.trim(b)
    most, least = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    same = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p == q) & (p != "")), lambda e: F.coalesce(e, F.lit(False))))
    return F.when(x == y, 1.0).when(least == 0, 0.0).otherwise(same / most * (least / most))


def search_similarity(query: Column, name: Column) -> Column:
    """1 equal, .95 but for case, .7 to .9 contained, else .6 of the shared characters' share."""
    q, n = F.lower(query), F.lower(name)
    longest, shortest = F.greatest(F.length(q), F.length(n)), F.least(F.length(q), F.length(n))
    contained = n.contains(q) | q.contains(n)
    common = F.size(F.filter(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.array_contains(F.split(n, ""), c)))
    return F.when(query == name, 1.0).when(q == n, 0.95).when(contained, 0.7 + 0.2 * shortest / longest).otherwise(0.6 * common / longest)


def content_similarity(a: Column, b: Column) -> Column:
    """Fingerprints: 1 equal hash, .95 equal normalised hash, else .7 identifiers + .3 lines."""
    return F.when(a["content_hash"] == b["content_hash"], 1.0).when(a["norm_hash"] == b["norm_hash"], 0.95).otherwise(0.7 * set_jaccard(a["idents"], b["idents"], 0.0) + 0.3 * count_similarity(a["line_count"], b["line_count"]))


def path_similarity(a: Column, b: Column) -> Column:
    """.5 for the same folder + .5 of the edit similarity of the stems."""
    from parallax.functions.text import folder, stem

    return 0.5 * (folder(a) == folder(b)).cast("double") + 0.5 * edit_similarity(stem(a), stem(b))


def contained_share(a: Column, b: Column) -> Column:
    """Share of a's members that b has; 0 if a has none."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def method_similarity(a: Column, b: Column) -> Column:
    """.4 name + .4 signature + .1 visibility + .05 static + .05 abstract."""
    same = lambda f: a[f].eqNullSafe(b[f]).cast("double")
    return 0.4 * edit_similarity(a["name"], b["name"]) + 0.4 * edit_similarity(a["signature"], b["signature"]) + 0.1 * same("visibility") + 0.05 * same("is_static") + 0.05 * same("is_abstract")


def classifier_signature_similarity(a: Column, b: Column) -> Column:
    """.3 name + .2 parameter count + .2 return type + .1 visibility (half if different) + .2 cyclomatic complexity."""
    visible = F.when(a["visibility"].eqNullSafe(b["visibility"]), 1.0).otherwise(0.5)
    return 0.3 * edit_similarity(a["name"], b["name"]) + 0.2 * count_similarity(F.size(a["params"]), F.size(b["params"])) + 0.2 * a["return_type"].eqNullSafe(b["return_type"]).cast("double") + 0.1 * visible + 0.2 * count_similarity(a["cyclomatic"], b["cyclomatic"])


def control_flow_similarity(a: Column, b: Column) -> Column:
    """Mean over a's paths of their best overlap with one of b's; 1 if a has none. Paths are arrays of steps."""
    overlap = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x), F.size(y))
    best = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: overlap(x, y))), F.lit(0.0)))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def prefix_share(a: Column, b: Column, sep: str) -> Column:
    """Shared leading parts of two separated strings over the longer number of parts."""
    x, y = F.split(a, sep), F.split(b, sep)
    run = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + (s["on"] & e).cast("int")).alias("n")), lambda s: s["n"])
    return run / F.greatest(F.size(x), F.size(y))


def context_similarity(a: Column, b: Column) -> Column:
    """.3 calls + .2 variables + .2 dependencies + .15 surroundings (.7 path, .3 line) + .15 namespace."""
    near = 0.7 * prefix_share(a["file_path"], b["file_path"], "/") + 0.3 * F.greatest(F.lit(0.0), 1 - F.abs(a["start_line"] - b["start_line"]) / 1000)
    return 0.3 * set_jaccard(a["calls"], b["calls"]) + 0.2 * set_jaccard(a["vars"], b["vars"]) + 0.2 * set_jaccard(a["deps"], b["deps"]) + 0.15 * near + 0.15 * prefix_share(a["namespace"], b["namespace"], r"\.")


def pattern_similarity(a: Column, b: Column, sets: tuple[str, ...] = ("types", "apis", "errors", "resources", "algorithms")) -> Column:
    """Mean of the shared shares of several pattern sets."""
    total = F.lit(0.0)
    for s in sets:
        total = total + set_jaccard(a[s], b[s])
    return total / len(sets)


def ast_score(structure: Column, content: Column, control: Column, edit: Column, depth_a: Column, depth_b: Column, n_a: Column, n_b: Column) -> Column:
    """.3 structure + .25 content + .2 control flow + .15 tree edits + .05 depth + .05 node counts."""
    deep = F.greatest(F.lit(0.0), 1 - F.abs(depth_a - depth_b) / 20)
    return 0.3 * structure + 0.25 * content + 0.2 * control + 0.15 * edit + 0.05 * deep + 0.05 * count_similarity(n_a, n_b)


def comprehensive_score(signature: Column, ast: Column, context: Column) -> Column:
    return 0.4 * signature + 0.4 * ast + 0.2 * context


def match_ladder(score: Column, names: tuple[str, ...] = ("exact", "high", "medium", "low"), steps: tuple[float, ...] = (0.95, 0.85, 0.7, 0.5)) -> Column:
    out = None
    for n, s in zip(names, steps):
        out = F.when(score >= s, n) if out is None else out.when(score >= s, n)
    return out.otherwise("none")


def match_confidence(score: Column, same_name: Column, same_types: Column, structure: Column) -> Column:
    """The score, raised for equal names and parameter types, lowered for little shared structure, within 0..1."""
    raised = score + 0.1 * same_name.cast("double") + 0.05 * same_types.cast("double") - 0.1 * (structure < 0.3).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raised))


def graph_score(signature: Column, comprehensive: Column, same_context: Column, dependency: Column) -> Column:
    """.4 signature + .4 comprehensive + .2 dependency context (1 if the context hashes are equal)."""
    return 0.4 * signature + 0.4 * comprehensive + 0.2 * F.when(same_context, 1.0).otherwise(dependency)
