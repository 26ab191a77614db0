"""Functions, symbols and languages of source files.

Functions and types of languages with braces come from their trees; those of Python and Ruby by lines and indentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions import text
from parallax.operators import braces, trees

#: Languages by file extension (fixed values).
EXTENSIONS = {"java": "Java", "py": "Python", "pyw": "Python", "js": "JavaScript", "mjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp", "c": "C", "h": "C", "go": "Go", "rs": "Rust", "rb": "Ruby", "php": "PHP", "swift": "Swift"}
#: Signs of each language in a text, with weights; the language with the highest sum of at least LEAST_SCORE is taken, the first in this order on ties.
SIGNS = {
    "Java": ((r"\bpublic\s+(static\s+)?(class|interface|enum)\b", 0.4), (r"\bimport\s+java[x.]", 0.4), (r"\bSystem\.out\b", 0.3), (r"@Override\b", 0.3)),
    "Python": ((r"(?m)^\s*def\s+\w+\s*\(.*\)\s*(->.*)?:", 0.4), (r"(?m)^\s*(from\s+\S+\s+)?import\s+\w+\s*$", 0.2), (r"\bself\b", 0.2), (r"(?m)^\s*class\s+\w+.*:\s*$", 0.2), (r"__name__", 0.3)),
    "JavaScript": ((r"\bfunction\s+\w+\s*\(", 0.3), (r"\b(const|let|var)\s+\w+\s*=", 0.2), (r"=>", 0.2), (r"\bconsole\.log\b", 0.3), (r"\brequire\(", 0.2)),
    "Cpp": ((r"#include\s*<(iostream|vector|string|map)>", 0.4), (r"\bstd::", 0.4), (r"\btemplate\s*<", 0.3), (r"\bnamespace\s+\w+", 0.2)),
    "C": ((r"#include\s*<\w+\.h>", 0.4), (r"\bprintf\s*\(", 0.2), (r"\bint\s+main\s*\(", 0.2), (r"\bstruct\s+\w+\s*\{", 0.2)),
    "Go": ((r"(?m)^package\s+\w+", 0.4), (r"\bfunc\s+(\(\w+\s+\*?\w+\)\s*)?\w+\(", 0.3), (r":=", 0.2), (r"\bfmt\.", 0.2)),
    "Ruby": ((r"(?m)^\s*def\s+\w+[?!]?\s*(\(.*\))?\s*$", 0.3), (r"(?m)^\s*end\s*$", 0.3), (r"\bputs\b", 0.2), (r"\brequire\s+'", 0.2)),
    "PHP": ((r"<\?php", 0.7), (r"\$\w+\s*=", 0.2), (r"\becho\b", 0.1)),
    "Swift": ((r"\bimport\s+(Foundation|UIKit|SwiftUI)\b", 0.4), (r"\bfunc\s+\w+\(.*\)\s*(->\s*\w+)?\s*\{", 0.3), (r"\b(let|var)\s+\w+\s*:\s*\w+", 0.2), (r"\bguard\s+let\b", 0.3)),
}
LEAST_SCORE = 0.3
UNKNOWN = "Unknown"


def language_of_path(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[text.extension(path)]


def language_scores(content: Column) -> Column:
    """A struct of one score for each language."""
    out = []
    for name, signs in SIGNS.items():
        total = F.lit(0.0)
        for pattern, weight in signs:
            total = total + F.when(content.rlike(pattern), weight).otherwise(0.0)
        out.append(F.round(total, 6).alias(name))
    return F.struct(*out)


def language_of_content(content: Column) -> Column:
    scores = language_scores(content)
    best = F.greatest(*[scores[n] for n in SIGNS])
    out = F.lit(UNKNOWN)
    for name in reversed(SIGNS):
        out = F.when(scores[name] == best, F.lit(name)).otherwise(out)
    return F.when(best >= LEAST_SCORE, out).otherwise(UNKNOWN)


def language(path: Column, content: Column) -> Column:
    return F.coalesce(language_of_path(path), language_of_content(content))


_KEYWORDS = frozenset(("if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof", "synchronized", "using", "lock"))
_HEADS = {
    "Python": re.compile(r"^(?P<indent>\s*)(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:->\s*(?P<ret>[^:]+))?:"),
    "Ruby": re.compile(r"^(?P<indent>\s*)def\s+(?:self\.)?(?P<name>\w+[?!]?)\s*(?:\((?P<params>[^)]*)\))?(?P<ret>)"),
}
#: Lines that a signature may take.
LOOK_AHEAD = 10
FUNCTIONS = "file_path string, name string, params array<string>, return_type string, modifiers array<string>, start_line int, end_line int, body string, calls array<string>, generics string, visibility string, annotations array<string>"
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")


def _end(lines: list[str], start: int, lang: str, indent: int) -> int:
    """The last line of a body: by indentation, or by the closing word."""
    if lang == "Ruby":
        return next((k for k in range(start + 1, len(lines)) if lines[k].strip() == "end" and len(lines[k]) - len(lines[k].lstrip()) <= indent), len(lines) - 1)
    last = start
    for k in range(start + 1, len(lines)):
        if lines[k].strip():
            if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                break
            last = k
    return last


def _from_tree(content: str, lang: str) -> list[tuple]:
    """Named functions of a language with braces, inner ones too."""
    lines, out = content.split("\n"), []
    for node, _ in braces.walk(braces.tree(content, lang)):
        if node[0] in ("Function", "Method") and node[2]:
            own = node[6]
            calls = [re.split(r"\.|::|->", n[2])[-1] for n, _ in braces.walk(node) if n[0] == "CallExpression"]
            out.append((node[2], [p for p in own.get("params", "").split("\n") if p], own.get("return_type"), own.get("modifiers", "").split(), node[3], node[5], "\n".join(lines[node[3] - 1 : node[5]]), [c for c in calls if c not in _KEYWORDS], own.get("generics"), own.get("visibility"), own.get("annotations", "").split()))
    return out


def functions_of(content: str, lang: str) -> list[tuple]:
    """Rows of a file's functions but for its path: from the tree of a language with braces, else by lines."""
    if lang in braces.LANGUAGES:
        return _from_tree(content or "", lang)
    if lang not in _HEADS:
        return []
    lines, head, out = (content or "").split("\n"), _HEADS[lang], []
    for k in range(len(lines)):
        joined = lines[k]
        if "(" in joined and ")" not in joined:  # a signature over several lines
            joined = " ".join([joined, *[x.strip() for x in lines[k + 1 : k + LOOK_AHEAD]]])
        m = head.match(joined)
        if m:
            end = _end(lines, k, lang, len(lines[k]) - len(lines[k].lstrip()))
            body = "\n".join(lines[k : end + 1])
            params = [p.strip() for p in (m["params"] or "").split(",") if p.strip()]
            calls = [c for c in _CALL.findall(body.split("\n", 1)[1] if "\n" in body else body[m.end() :]) if c not in _KEYWORDS]
            marks = [x.strip() for x in lines[k - 1 : k] if x.strip().startswith("@")] if lang == "Python" and k else []
            out.append((m["name"], params, (m["ret"] or "").strip() or None, [], k + 1, end + 1, body, calls, None, "private" if m["name"].startswith("_") else "public", marks))
    return out


def functions(files: DataFrame) -> DataFrame:
    """Function rows of files (path, content), by the language of path or content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *f) for p, c, lang in zip(pdf["path"], pdf["content"], pdf["lang"]) for f in functions_of(c, lang)]
            yield pd.DataFrame(rows, columns=["file_path", "name", "params", "return_type", "modifiers", "start_line", "end_line", "body", "calls", "generics", "visibility", "annotations"])

    return files.select("path", "content", language(F.col("path"), F.col("content")).alias("lang")).mapInPandas(run, FUNCTIONS)


def with_measures(fns: DataFrame) -> DataFrame:
    """Cyclomatic complexity, branches, loops, calls, lines, and hashes of the signature."""
    count = lambda words: F.size(F.regexp_extract_all("body", F.lit(r"\b(?:" + words + r")\b"), F.lit(0)))
    branches, loops = count("if|elif|case|catch|except"), count("for|while|until")
    own = fns.withColumns({"branches": branches, "loops": loops, "n_calls": F.size("calls"), "n_params": F.size("params"), "loc": F.col("end_line") - F.col("start_line") + 1})
    signature = F.concat_ws("|", "name", F.array_join("params", ","), F.coalesce("return_type", F.lit("")))
    plain = F.concat_ws("|", F.size("params"), F.coalesce("return_type", F.lit("")), F.regexp_replace("body", r"\s|\b" + "name" + r"\b", ""))
    return own.withColumns({"cyclomatic": 1 + F.col("branches") + F.col("loops"), "signature": signature, "signature_hash": F.xxhash64(signature), "normalized_hash": F.xxhash64(plain)})


def overloads(fns: DataFrame) -> DataFrame:
    return fns.groupBy("file_path", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("start_line")).alias("lines")).where("n > 1")


#: Import statements by language; the module is what one of the groups holds.
IMPORTS = {"Java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", "Python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "JavaScript": r"""(?:from|require\()\s*['"]([^'"]+)['"]""", "C": r"""(?m)^\s*#include\s*[<"]([^>"]+)[>"]""", "Go": r'(?m)^\s*(?:import\s+)?"([\w./]+)"'}


def imports(files: DataFrame) -> DataFrame:
    """(file_path, module) of each file's imports."""
    own = files.withColumn("__lang", language(F.col("path"), F.col("content")))
    rows = None
    for lang, pattern in IMPORTS.items():
        names = (lang, "TypeScript") if lang == "JavaScript" else (lang, "Cpp") if lang == "C" else (lang,)
        found = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        if lang == "Python":
            found = F.filter(F.concat(found, F.regexp_extract_all("content", F.lit(pattern), F.lit(2))), lambda x: x != "")
        one = own.where(F.col("__lang").isin(*names)).select(F.col("path").alias("file_path"), F.explode(F.array_distinct(found)).alias("module"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


CLASS = r"\b(?:class|interface|struct)\s+(\w+)(?:\s*(?:extends|:|\()\s*(\w+))?(?:.*?\bimplements\s+([\w, ]+))?"


def classes(files: DataFrame) -> DataFrame:
    """(file_path, name, parent, interfaces) of class-like definitions."""
    lines = files.select(F.col("path").alias("file_path"), F.explode(text.lines(F.col("content"))).alias("line")).where(F.col("line").rlike(CLASS))
    get = lambda i: F.nullif(F.regexp_extract("line", CLASS, i), F.lit(""))
    return lines.select("file_path", get(1).alias("name"), get(2).alias("parent"), F.coalesce(F.transform(F.split(get(3), ","), F.trim), F.expr("cast(array() as array<string>)")).alias("interfaces"))


def node_language_of_path(path: Column) -> Column:
    """The language by which a file is parsed, as far as its path tells."""
    return F.when(text.extension(path).isin("html", "htm", "xhtml"), "HTML").otherwise(language_of_path(path))


def source_nodes(files: DataFrame, *, optimise: bool = False) -> DataFrame:
    """Node rows of files (path, content), each by its own language."""
    return trees.parse(files.select(F.col("path").alias("file_id"), "content", F.coalesce(node_language_of_path(F.col("path")), language_of_content(F.col("content"))).alias("lang")), F.col("lang"), optimise=optimise)


def declared_types(nodes: DataFrame) -> DataFrame:
    """``types`` without their methods and fields; narrow."""
    get = lambda k: F.col("attributes")[k]
    words = lambda k, by: F.coalesce(F.split(get(k), by), F.expr("cast(array() as array<string>)"))
    return nodes.where(F.col("node_type").isin("Class", "Interface") & (F.col("text") != "")).select("file_id", "pre", F.col("text").alias("name"), "kind", get("superclass").alias("parent"), words("interfaces", ",").alias("interfaces"), words("modifiers", " ").alias("modifiers"), get("visibility").alias("visibility"), get("generics").alias("generics"), words("annotations", " ").alias("annotations"), "line", "end_line")


def types(nodes: DataFrame) -> DataFrame:
    """Types of languages with braces, from node rows: their parents, parameters of type, methods and fields.

    (file_id, pre, name, kind, parent, interfaces, modifiers, visibility, generics, annotations, methods, fields, line, end_line)
    """
    own = declared_types(nodes)
    member = nodes.where(F.col("node_type").isin("Method", "FieldDeclaration") & (F.col("text") != ""))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("node_type") == kind, F.struct("pre", "text")))), lambda x: x["text"])
    held = member.groupBy("file_id", F.col("parent_pre").alias("p")).agg(of("Method").alias("methods"), of("FieldDeclaration").alias("fields")).withColumnRenamed("p", "pre")
    none = F.expr("cast(array() as array<string>)")
    return own.join(held, ["file_id", "pre"], "left").withColumns({"methods": F.coalesce("methods", none), "fields": F.coalesce("fields", none)})


def symbol_table(files: DataFrame) -> DataFrame:
    """(name, kind, file_path, line) of functions and classes."""
    fns = functions(files).select("name", F.lit("function").alias("kind"), "file_path", F.col("start_line").alias("line"))
    numbered = files.select(F.col("path").alias("file_path"), F.posexplode(text.lines(F.col("content"))).alias("i", "l")).where(F.col("l").rlike(CLASS))
    return fns.unionByName(numbered.select(F.regexp_extract("l", CLASS, 1).alias("name"), F.lit("class").alias("kind"), "file_path", (F.col("i") + 1).alias("line")))


def call_edges(fns: DataFrame) -> DataFrame:
    """(src, dst, edge_type) between functions by name."""
    calls = fns.select(F.concat_ws("::", "file_path", "name").alias("src"), F.explode("calls").alias("callee"))
    there = fns.select(F.col("name").alias("callee"), F.concat_ws("::", "file_path", "name").alias("dst"))
    return calls.join(there, "callee").select("src", "dst", F.lit("direct_call").alias("edge_type"))
