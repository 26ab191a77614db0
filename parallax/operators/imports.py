"""Names through imports: which file defines a name that another one uses, through aliases, wildcards and re-exports.

Imports become links between scopes (files, and packages where a language has them). Only names that are asked for are looked up:
goals (scope, name) spread along links until each has a definition or nowhere to go, then definitions flow back. A goal is visited once,
so that cycles of imports end, and no wildcard is ever spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions import text
from parallax.operators import codefront
from parallax.operators.checkpoints import cut, dealt
from parallax.operators.patterns import declared_type

#: Endings under which a module is looked for, first come first.
ENDINGS = {"Python": (".py", "/__init__.py"), "JavaScript": (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ""), "Java": (".java",)}
_JS = ("JavaScript", "TypeScript")

# Types that nothing depends on, and strengths of dependencies by kind.
PRIMITIVE = ("int", "long", "float", "double", "bool", "char", "byte", "short", "string", "String", "void", "boolean", "Boolean", "i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "f32", "f64", "str", "None", "null", "undefined", "Object")
TYPE_STRENGTH = {"inherits": 1.0, "implements": 0.9, "field": 0.7, "return": 0.5, "parameter": 0.4}


def joined_path(base: Column, relative: Column) -> Column:
    """A path below a folder, with . and .. resolved; what leaves the root stays there."""
    parts = F.split(F.concat_ws("/", base, relative), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")


def statements(files: DataFrame) -> DataFrame:
    """(file_path, lang, module, name, local, reexports) of the imports of files (path, content) in Python, JavaScript, TypeScript and Java.

    name ``*`` with no local name is a wildcard, null the module itself; a module's path is relative to the root, ``package/*`` a package.
    """
    # Written once: the language's expression is large, and each kind of statement reads the texts again.
    own = cut(files.select(F.col("path").alias("file_path"), "content", codefront.language(F.col("path"), F.col("content")).alias("lang")))
    folder = F.nullif(text.folder(F.col("file_path")), F.lit(""))
    word = r"[\w$]+"

    def found(lang: Column, pattern: str, groups: int) -> DataFrame:
        one = own.where(lang).withColumn("__all", F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))
        each = one.select("file_path", "lang", F.explode(F.array_distinct("__all")).alias("s"))
        return each.select("file_path", "lang", *[F.regexp_extract("s", pattern, i + 1).alias(f"g{i + 1}") for i in range(groups)])

    def parts(d: DataFrame, names: Column, separator: str) -> DataFrame:
        d = d.withColumn("part", F.explode(F.split(F.regexp_replace(names, r"[()\n]|#[^\n]*", " "), ","))).withColumn("part", F.regexp_replace(F.trim("part"), r"^type\s+", "")).where("part <> ''")
        name = F.regexp_extract("part", rf"^({word}|\*)", 1)
        alias = F.regexp_extract("part", rf"\s{separator}\s+({word})$", 1)
        return d.withColumns({"name": name, "local": F.when(alias != "", alias).when(name != "*", name)})

    python, script, java = F.col("lang") == "Python", F.col("lang").isin(*_JS), F.col("lang") == "Java"

    def python_path(module: Column) -> Column:
        dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
        rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
        return F.when(dots == 0, rest).otherwise(joined_path(folder, F.concat(F.repeat(F.lit("../"), dots - 1), rest)))

    def script_path(module: Column) -> Column:
        return F.when(module.startswith("."), joined_path(folder, module)).otherwise(module)

    def rows(d: DataFrame, module: Column, name: Column, local: Column, reexports: bool) -> DataFrame:
        return d.select("file_path", "lang", module.alias("module"), name.alias("name"), local.alias("local"), F.lit(reexports).alias("reexports"))

    none, col = F.lit(None).cast("string"), F.col
    out = rows(parts(found(python, r"(?m)^\s*from\s+([.\w]+)\s+import\s+(\([^)]*\)|[^\n]+)", 2), col("g2"), "as"), python_path(col("g1")), col("name"), col("local"), True)
    plain = found(python, r"(?m)^\s*import\s+([^\n;#]+)", 1).withColumn("part", F.explode(F.split("g1", ","))).withColumn("module", F.regexp_extract(F.trim("part"), r"^([\w.]+)", 1)).where("module <> ''")
    alias = F.regexp_extract(F.trim("part"), rf"\sas\s+({word})$", 1)
    out = out.unionByName(rows(plain, python_path(col("module")), none, F.when(alias != "", alias).otherwise(col("module")), True))
    quoted = r"""from\s*['"]([^'"]+)['"]"""
    for verb, reexports in (("import", False), ("export", True)):
        named = found(script, rf"\b{verb}\s+(?:type\s+)?(?:{word}\s*,\s*)?\{{([^}}]*)\}}\s*{quoted}", 2)
        out = out.unionByName(rows(parts(named, col("g1"), "as"), script_path(col("g2")), col("name"), col("local"), reexports))
    out = out.unionByName(rows(found(script, rf"\bexport\s+\*\s*{quoted}", 1), script_path(col("g1")), F.lit("*"), none, True))
    out = out.unionByName(rows(found(script, rf"\bimport\s+\*\s*as\s+({word})\s*{quoted}", 2), script_path(col("g2")), none, col("g1"), False))
    out = out.unionByName(rows(found(script, rf"\bimport\s+(?:type\s+)?({word})\s*(?:,\s*\{{[^}}]*\}}\s*)?{quoted}", 2).where("g1 <> 'type'"), script_path(col("g2")), F.lit("default"), col("g1"), False))
    j = found(java, r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", 1)
    last = F.regexp_extract("g1", r"([\w*]+)$", 1)
    path = F.replace("g1", F.lit("."), F.lit("/"))
    return out.unionByName(rows(j, path, last, F.when(last != "*", last), False)).distinct()


def links(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, local, target, name, reexports): imports whose module is one of the files (path, content), the first by the order of ENDINGS.

    A null local name is a wildcard, a null name the module as a whole. Files of a package (a folder) see it as ``package:folder``.
    """
    imports, there = cut(imports), files.select(F.col("path").alias("target")).distinct()
    language = F.when(F.col("lang").isin(*_JS), "JavaScript").otherwise(F.col("lang"))
    endings = F.create_map(*[x for k, v in ENDINGS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    # Very many files may import one module: each module is looked for once.
    imports = imports.withColumn("__l", language)
    tried = imports.select("__l", "module").distinct().select("*", F.posexplode(endings[F.col("__l")]).alias("i", "ending")).withColumn("target", F.concat("module", "ending"))
    modules = tried.join(there, "target").groupBy("__l", "module").agg(F.min_by("target", "i").alias("target"))
    hit = imports.join(modules, ["__l", "module"])
    own = hit.select(F.col("file_path").alias("scope"), "local", "target", F.when(F.col("name") != "*", F.col("name")).alias("name"), "reexports", F.coalesce(F.col("name") == "*", F.lit(False)).alias("__w"))
    # A submodule taken by name from its package: the file itself is meant.
    sub = imports.where("lang = 'Python' and name is not null and name <> '*'").withColumn("target", F.concat("module", F.lit("/"), "name", F.lit(".py"))).join(there, "target")
    own = own.unionByName(sub.select(F.col("file_path").alias("scope"), "local", "target", F.lit(None).cast("string").alias("name"), "reexports", F.lit(False).alias("__w")))
    package = lambda folder: F.concat(F.lit("package:"), folder)
    none = F.lit(None).cast("string")
    star = imports.where("lang = 'Java' and name = '*'").select(F.col("file_path").alias("scope"), none.alias("local"), package(F.regexp_replace("module", r"/\*$", "")).alias("target"), none.alias("name"), "reexports", F.lit(True).alias("__w"))
    beside = files.where(F.col("path").endswith(".java")).select(F.col("path").alias("scope"), none.alias("local"), package(text.folder(F.col("path"))).alias("target"), none.alias("name"), F.lit(False).alias("reexports"), F.lit(True).alias("__w"))
    return own.unionByName(star).unionByName(beside).where("scope <> target").distinct().select("scope", "local", "target", "name", "reexports", F.col("__w").alias("wildcard"))


def definitions(symbols: DataFrame) -> DataFrame:
    """(scope, name, file_path): what files define (symbols: file_path, name), seen from themselves and, for Java, from their package."""
    own = symbols.select(F.col("file_path").alias("scope"), "name", "file_path").distinct()
    java = own.where(F.col("file_path").endswith(".java"))
    return own.unionByName(java.withColumn("scope", F.concat(F.lit("package:"), text.folder(F.col("file_path")))))


def resolve(uses: DataFrame, links: DataFrame, defined: DataFrame) -> DataFrame:
    """(file_path, name, def_file, def_name) of the used names (file_path, name) that have a definition.

    A file's own definition goes first, then an import by name, then wildcards. Of several wildcards the shortest way counts, then the
    first file. From outside, a scope shows what it defines and re-exports. ``a.b`` is b of the module that a stands for.
    """
    key = ["scope", "name", "outer"]
    front = cut(uses.where("file_path is not null and name is not null").select(F.col("file_path").alias("scope"), "name", F.lit(False).alias("outer")).distinct())
    d = cut(defined.groupBy("scope", "name").agg(F.min("file_path").alias("def_file")))
    # From inside all links are seen, from outside those that re-export.
    seen = cut(links.where("reexports").withColumn("outer", F.lit(True)).unionByName(links.withColumn("outer", F.lit(False))))
    named = seen.where("not wildcard").select("scope", "outer", F.col("local").alias("head"), F.col("name").isNull().alias("whole"), F.col("target").alias("to_scope"), F.col("name").alias("original"))
    wild = seen.where("wildcard").select("scope", "outer", F.col("target").alias("to_scope"))
    head, tail = F.regexp_extract("name", r"^(.*)\.[^.]+$", 1), F.regexp_extract("name", r"([^.]+)$", 1)
    goals, edges = front, None
    while not front.isEmpty():
        rest = front.join(d, ["scope", "name"], "left_anti")
        # A name goes by itself to what is imported under it, a dotted one to the module before its last part.
        asked = rest.select(*key, F.explode(F.array(F.struct(F.col("name").alias("head"), F.lit(False).alias("whole")), F.struct(head.alias("head"), F.lit(True).alias("whole")))).alias("x")).select(*key, "x.*").where("head <> ''")
        sure = asked.join(named, ["scope", "outer", "head", "whole"]).select(*key, "to_scope", F.when(F.col("whole"), tail).otherwise(F.col("original")).alias("to_name"))
        sure = cut(sure.distinct())
        more = cut(sure.unionByName(rest.join(sure, key, "left_anti").join(wild, ["scope", "outer"]).select(*key, "to_scope", F.col("name").alias("to_name"))))
        edges = more if edges is None else edges.unionByName(more)
        front = cut(more.select(F.col("to_scope").alias("scope"), F.col("to_name").alias("name"), F.lit(True).alias("outer")).distinct().join(goals, key, "left_anti"))
        goals = goals.unionByName(front)
    answers = fresh = cut(goals.join(d, ["scope", "name"]).select(*key, "def_file", F.col("name").alias("def_name")))
    if edges is None:
        return answers.select(F.col("scope").alias("file_path"), "name", "def_file", "def_name")
    edges = cut(edges)
    while not fresh.isEmpty():
        back = edges.join(fresh.where("outer").select(F.col("scope").alias("to_scope"), F.col("name").alias("to_name"), "def_file", "def_name"), ["to_scope", "to_name"])
        back = back.groupBy(*key).agg(F.min(F.struct("def_file", "def_name")).alias("d")).select(*key, "d.def_file", "d.def_name")
        fresh = cut(back.join(answers, key, "left_anti"))
        answers = answers.unionByName(fresh)
    return answers.where("not outer").select(F.col("scope").alias("file_path"), "name", "def_file", "def_name")


def bare_type(type_: Column) -> Column:
    """A type without parameters of type, arrays and marks of null, pointer or reference."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(type_, r"<.*$", ""), r"\[[^\]]*\]|[?*&!]|\b(?:const|final)\b", "")), F.lit(""))


def type_uses(nodes: DataFrame) -> DataFrame:
    """(file_path, name, used, edge_type): what types of node rows derive from, hold, return and take; primitive types left out."""
    types = codefront.declared_types(nodes).select("file_id", "pre", "name", "parent", "interfaces")
    get = lambda k: F.col("attributes")[k]
    use = lambda used, kind: F.struct(used.alias("used"), F.lit(kind).alias("edge_type"))
    each = lambda c, kind: F.coalesce(F.transform(c, lambda x: use(x, kind)), F.expr("cast(array() as array<struct<used:string,edge_type:string>>)"))
    field = F.when(F.col("node_type") == "FieldDeclaration", declared_type(get("type")))
    params = F.transform(F.split(get("params"), "\n"), declared_type)
    member = nodes.where(F.col("node_type").isin("Method", "FieldDeclaration")).select("file_id", F.col("parent_pre").alias("pre"), F.explode(F.concat(F.array(use(field, "field"), use(get("return_type"), "return")), each(params, "parameter"))).alias("x")).where("x.used is not null")
    held = member.join(types.select("file_id", "pre", "name"), ["file_id", "pre"])
    rows = types.select("file_id", "name", F.explode(F.concat(F.array(use(F.col("parent"), "inherits")), each(F.col("interfaces"), "implements"))).alias("x")).unionByName(held.select("file_id", "name", "x")).select("file_id", "name", "x.*")
    return rows.withColumn("used", bare_type(F.col("used"))).where(F.col("used").isNotNull() & ~F.col("used").isin(*PRIMITIVE)).select(F.col("file_id").alias("file_path"), "name", "used", "edge_type").distinct()


def type_graph(files: DataFrame) -> DataFrame:
    """(src_file, src, dst_file, dst, edge_type, strength): dependencies between the types of files (path, content), through their imports.

    Edges to types that no file defines, and of a type to itself, are left out; types of languages with braces only.
    """
    files = cut(dealt(files, "path"))
    # Of the nodes only types and their members are written.
    nodes = cut(codefront.source_nodes(files).where(F.col("node_type").isin("Class", "Interface", "Method", "FieldDeclaration")))
    uses = cut(type_uses(nodes))
    own = resolve(uses.select("file_path", F.col("used").alias("name")).distinct(), links(statements(files), files), definitions(codefront.declared_types(nodes).select(F.col("file_id").alias("file_path"), "name")))
    strength = F.create_map(*[F.lit(x) for pair in TYPE_STRENGTH.items() for x in pair])
    edges = uses.join(own.withColumnRenamed("name", "used"), ["file_path", "used"]).where("file_path <> def_file or name <> def_name")
    return edges.select(F.col("file_path").alias("src_file"), F.col("name").alias("src"), F.col("def_file").alias("dst_file"), F.col("def_name").alias("dst"), "edge_type", strength[F.col("edge_type")].alias("strength")).distinct()
