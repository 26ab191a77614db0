import random

from pyspark.sql import functions as F

from parallax.operators import codefront, imports

FILES = {
    "app/main.py": "from lib import Shape as S, area\nfrom .near import (Far,\n   Near as N)\nimport lib.deep as deep\nimport lib.deep\nfrom lib import deep\n",
    "app/near.py": "from ..lib.deep import *\nclass Near: pass\n",
    "lib/__init__.py": "from .deep import Deep as Shape\nfrom lib.ring import area\n",
    "lib/deep.py": "from lib.ring import *\nclass Deep: pass\nclass Far: pass\n",
    "lib/ring.py": "from lib.deep import *\nclass area: pass\n",
    "web/view.ts": "import Def, { A as B, type C } from './parts'\nimport * as P from './parts/one'\nimport { hidden } from './parts'\nclass View extends B { x: P.One; m(a: C): Local { return a } }\nclass Local { n: number; self: Local }\n",
    "web/parts/index.ts": "import { hidden } from './one'\nexport * from './one'\nexport { C as C } from '../other'\n",
    "web/parts/one.ts": "export class A { }\nexport class One { }\nclass hidden { }\nexport * from './index'\n",
    "web/other.ts": "export class C { }\n",
    "a/b/Base.java": "package a.b; public class Base { Side<String> side; }\n",
    "a/b/Side.java": "package a.b; public class Side<T> { }\n",
    "a/c/Child.java": "package a.c; import a.b.*; import a.d.Api; public class Child extends Base implements Api { private Map<K, V> m; private Side[] s; int n; Base up(Child c, Api d) { return null; } }\n",
    "a/d/Api.java": "package a.d; import a.c.Child; public interface Api { Child make(int k); }\n",
    "bad.py": None,
}


def table(spark, files=FILES):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_names_through_aliases_wildcards_and_reexports(spark):
    files = table(spark)
    symbols = spark.createDataFrame([("app/near.py", "Near"), ("lib/deep.py", "Deep"), ("lib/deep.py", "Far"), ("lib/ring.py", "area"), ("web/parts/one.ts", "A"), ("web/parts/one.ts", "One"), ("web/other.ts", "C")], "file_path string, name string")
    uses = [("app/main.py", n) for n in ("S", "area", "Far", "N", "deep.Far", "lib.deep.Deep", "deep.area", "nothing")] + [("web/view.ts", n) for n in ("B", "C", "P.One", "hidden", "nowhere")] + [("lib/ring.py", "Deep"), ("lib/ring.py", "absent"), (None, "x")]
    got = {(r.file_path, r.name): (r.def_file, r.def_name) for r in imports.resolve(spark.createDataFrame(uses, "file_path string, name string"), imports.links(imports.statements(files), files), imports.definitions(symbols)).collect()}
    main = {"S": ("lib/deep.py", "Deep"), "area": ("lib/ring.py", "area"), "Far": ("lib/deep.py", "Far"), "N": ("app/near.py", "Near"), "deep.Far": ("lib/deep.py", "Far"), "lib.deep.Deep": ("lib/deep.py", "Deep"), "deep.area": ("lib/ring.py", "area")}
    want = {("app/main.py", k): v for k, v in main.items()}
    want |= {("web/view.ts", "B"): ("web/parts/one.ts", "A"), ("web/view.ts", "C"): ("web/other.ts", "C"), ("web/view.ts", "P.One"): ("web/parts/one.ts", "One"), ("lib/ring.py", "Deep"): ("lib/deep.py", "Deep")}
    assert got == want


def test_type_graph(spark):
    got = {(r.src_file, r.src, r.dst_file, r.dst, r.edge_type, r.strength) for r in imports.type_graph(table(spark).where(F.col("path").rlike("java$|ts$"))).collect()}
    child, view = ("a/c/Child.java", "Child"), ("web/view.ts", "View")
    assert got == {
        ("a/b/Base.java", "Base", "a/b/Side.java", "Side", "field", 0.7),
        (*child, "a/b/Base.java", "Base", "inherits", 1.0), (*child, "a/d/Api.java", "Api", "implements", 0.9), (*child, "a/b/Side.java", "Side", "field", 0.7),
        (*child, "a/b/Base.java", "Base", "return", 0.5), (*child, "a/d/Api.java", "Api", "parameter", 0.4), ("a/d/Api.java", "Api", "a/c/Child.java", "Child", "return", 0.5),
        (*view, "web/parts/one.ts", "A", "inherits", 1.0), (*view, "web/parts/one.ts", "One", "field", 0.7), (*view, "web/other.ts", "C", "parameter", 0.4), (*view, "web/view.ts", "Local", "return", 0.5),
    }


def test_random_imports_as_a_search_from_each_use(spark):
    r = random.Random(6)
    scopes, names = [f"s{i}" for i in range(10)], list("abcd")
    defined = {(s, n) for s in scopes for n in names if r.random() < 0.4}
    named = {(s, n): (r.choice(scopes), r.choice(names), r.random() < 0.7) for s in scopes for n in names if r.random() < 0.25}
    named = {k: v for k, v in named.items() if v[0] != k[0]}
    wild = {(s, t): r.random() < 0.7 for s in scopes for t in scopes if s != t and r.random() < 0.12}

    def found(use):
        level, seen = [(*use, False)], set()
        while level:
            seen |= set(level)
            hits = [g for g in level if g[:2] in defined]
            if hits:
                return min(hits)[:2]
            following = set()
            for s, n, outer in level:
                if (s, n) in named and (named[s, n][2] or not outer):
                    following.add((*named[s, n][:2], True))
                else:
                    following |= {(t, n, True) for (x, t), re in wild.items() if x == s and (re or not outer)}
            level = sorted(following - seen)
        return None

    uses = [(s, n) for s in scopes for n in names]
    links = [(s, n, t, m, re, False) for (s, n), (t, m, re) in named.items()] + [(s, None, t, None, re, True) for (s, t), re in wild.items()]
    got = imports.resolve(spark.createDataFrame(uses, "file_path string, name string"), spark.createDataFrame(links, "scope string, local string, target string, name string, reexports boolean, wildcard boolean"), spark.createDataFrame([(s, n, s) for s, n in defined], "scope string, name string, file_path string"))
    want = {u: d for u in uses if (d := found(u))}
    assert {(x.file_path, x.name): (x.def_file, x.def_name) for x in got.collect()} == want and len(want) > 10


def test_no_files(spark):
    assert imports.type_graph(table(spark).limit(0)).count() == 0


def test_a_module_of_many_files_is_looked_for_once(spark):
    """200 files import one module: the lookup by paths meets a row for each ending, not for each file and ending."""
    rows = [(f"a/F{i}.ts", f"import {{ X as Y }} from '../lib'\nexport class F{i} extends Y {{ }}\n") for i in range(200)]
    files = spark.createDataFrame([*rows, ("lib/index.ts", "export class X { }\n"), ("lib.js", "export class X { }\n")], "path string, content string")
    own = imports.links(imports.statements(files), files)
    assert {(r.scope, r.local, r.target, r.name) for r in own.collect()} == {(p, "Y", "lib.js", "X") for p, _ in rows}
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate posexplode"):]
    assert "Aggregate [__l" in below.split("LogicalRDD")[0]


def test_files_of_one_partition_are_parsed_by_several_tasks(spark, monkeypatch):
    seen, parse = [], codefront.source_nodes
    monkeypatch.setattr(codefront, "source_nodes", lambda d, **k: seen.append(d.rdd.getNumPartitions()) or parse(d, **k))
    files = spark.createDataFrame([(f"F{i}.java", f"class F{i} {{ private F{i + 1} next; }}\n") for i in range(30)], "path string, content string").coalesce(1)
    got = {(r.src, r.dst, r.edge_type) for r in imports.type_graph(files).collect()}
    assert got == {(f"F{i}", f"F{i + 1}", "field") for i in range(29)} and seen == [4]
