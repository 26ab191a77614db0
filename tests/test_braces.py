import random

import pytest
from pyspark.sql import functions as F

from parallax.operators import braces, codefront, trees

GO = "package main\n\nfunc add(a int, b int) int {\n    return a + b\n}\n"
PHP = "<?php\nfunction add($a, $b) {\n    return $a + $b;\n}\n"
SWIFT = "func add(_ a: Int, _ b: Int) -> Int {\n    return a + b\n}\n"
JAVA = '''import java.util.List;
@Service
public class Store<T> extends Base implements A, B<String> {
    private int size = 0;
    public Store(int size) { this.size = size; }
    @Override
    public static <K, V> Map<K, V> pair(int a, Map<K, List<V>> b) throws IOException {
        if (a > 0 && s.equals("}{")) { return of(a, more(b)); } else if (a < 3) { a++; }
        for (int i = 0; i < 3; i++) { while (a > i) { list.forEach(y -> { go(y); }); } }
        /* } */ // }
        return helper(a);
    }
    abstract int open(int a);
}
'''
CPP = '#include <vector>\n#define BAD {\nnamespace n {\nclass A : public B { int f(int a) const override { return a; } ~A() {} };\ntemplate <typename T> T A::g(std::vector<T> v) { return R"x(})x"; }\n}\nint main(void)\n{\n  return 0;\n}\n'
JS = "const f = (a, b) => {\n  return a.map(x => x + 1).filter(function (y) { return /[}\"/]/.test(y) })\n}\nasync function g(x) { if (x) { h(`t } ${x}`) } }\nclass K extends L { m(a) { this.z = {a: 1}; } static n() {} }\n"


def found(source, language):
    return {n[2]: n for n, _ in braces.walk(braces.tree(source, language)) if n[0] in ("Function", "Method") and n[2]}


@pytest.mark.parametrize("source, language, params, returns", [(GO, "Go", ["a int", "b int"], "int"), (PHP, "PHP", ["$a", "$b"], None), (SWIFT, "Swift", ["_ a:Int", "_ b:Int"], "Int"), (GO.replace("func", "func (s *S)"), "Go", ["a int", "b int"], "int")])
def test_a_function_in_each_language(source, language, params, returns):
    root = braces.tree(source, language)
    add = found(source, language)["add"]
    assert root[0] == "Program" and root[4]
    assert add[6]["params"].split("\n") == params and add[6].get("return_type") == returns and add[5] - add[3] == 2
    assert [n[0] for n in add[4]] == ["ReturnStatement"] and [n[0] for n in add[4][0][4]] == ["Identifier", "BinaryExpression", "Identifier"]


def test_signatures_types_and_nesting():
    fns = found(JAVA, "Java")
    assert set(fns) == {"Store", "pair", "open"}
    assert fns["pair"][6] == {"params": "int a\nMap<K,List<V>> b", "param_count": "2", "return_type": "Map<K,V>", "modifiers": "public static", "generics": "<K,V>", "visibility": "public", "annotations": "@Override"}
    assert (fns["pair"][3], fns["pair"][5]) == (6, 12)
    cls = braces.tree(JAVA, "Java")[4][1]
    assert cls[:3] == ["Class", "class", "Store"] and cls[6]["superclass"] == "Base" and cls[6]["interfaces"] == "A,B<String>" and cls[6]["generics"] == "<T>"
    calls = {n[2]: [a[2] for a in around if a[0] == "CallExpression"] for n, around in braces.walk(cls) if n[0] == "CallExpression"}
    assert calls == {"s.equals": [], "of": [], "more": ["of"], "go": [], "list.forEach": [], "helper": []}
    cpp = found(CPP, "Cpp")
    assert set(cpp) == {"f", "~A", "g", "main"} and cpp["g"][6]["return_type"] == "T" and cpp["g"][6]["generics"] == "<typename T>" and "params" not in cpp["main"][6]
    js = found(JS, "JavaScript")
    assert {k: v[0] for k, v in js.items()} == {"f": "Function", "g": "Function", "m": "Method", "n": "Method"} and js["f"][5] == 3


def test_any_text_has_a_tree():
    r = random.Random(4)
    for language in braces.LANGUAGES:
        assert braces.tree("", language)[4] == []
        for _ in range(60):
            text = "".join(r.choice(["{", "}", "(", ")", "[", ";", "\n", "if ", "class ", "f", "x = ", '"', "'", "`", "/", "=>", "<", ">", ",", "func ", "return ", "case ", ":", "~", "new ", "@a ", "template"]) for _ in range(40))
            rows = trees.flat("f", braces.tree(text, language))
            assert sorted(x[2] for x in rows) == list(range(len(rows))) and all(x[1] <= x[6] < len(rows) for x in rows)
    deep = braces.tree("{" * 20_000 + "}" * 20_000, "C")
    assert len(trees.flat("f", deep)) == 20_001


def test_functions_and_types_of_files(spark):
    body = "".join(f"    x{k} = call{k}(1);\n" for k in range(300))
    long = "int wide(int a) {\n" + body + "}\n"
    files = spark.createDataFrame([("S.java", JAVA), ("a.go", GO), ("w.c", long), ("m.php", PHP), ("none.txt", "words only")], "path string, content string")
    fns = {(r["file_path"], r["name"]): r for r in codefront.with_measures(codefront.functions(files)).collect()}
    assert set(fns) == {("S.java", "Store"), ("S.java", "pair"), ("S.java", "open"), ("a.go", "add"), ("w.c", "wide"), ("m.php", "add")}
    wide = fns["w.c", "wide"]
    assert wide.end_line == 302 and wide.n_calls == 300 and wide.calls[299] == "call299"  # no cut after some lines
    assert fns["S.java", "pair"].visibility == "public" and fns["S.java", "pair"].annotations == ["@Override"] and fns["S.java", "pair"].calls == ["equals", "of", "more", "go", "forEach", "helper"]
    nodes = codefront.source_nodes(files)
    (store,) = codefront.types(nodes).collect()
    assert (store.name, store.parent, store.interfaces, store.generics) == ("Store", "Base", ["A", "B<String>"], "<T>") and store.methods == ["Store", "pair", "open"] and store.fields == ["size"]
    paths = {r["name"]: r for r in trees.function_paths(nodes).where("file_id = 'S.java'").collect()}
    assert paths["pair"].paths == ["ForLoop", "ForLoop>WhileLoop", "IfStatement", "IfStatement>ReturnStatement", "ReturnStatement"] and paths["pair"].nesting == 2 and paths["open"].paths == []


def test_enclosing_is_the_range_join(spark):
    nodes = codefront.source_nodes(spark.createDataFrame([("S.java", JAVA * 3), ("a.js", JS)], "path string, content string")).cache()
    kinds = ("Function", "Method", "IfStatement", "ForLoop", "Class")
    outer = nodes.where(F.col("node_type").isin(*kinds)).select("file_id", F.col("pre").alias("p"), F.col("subtree_end_pre").alias("e"))
    want = nodes.join(outer, "file_id").where("p < pre and pre <= e").groupBy("file_id", "pre").agg(F.count("*").alias("n"))
    got = {tuple(r) for r in trees.enclosing(nodes, kinds).collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100
    # Paths by walking up from each node.
    rows = {(r.file_id, r.pre): r for r in nodes.collect()}
    for r in trees.control_paths(nodes).collect():
        up, path = rows[r.file_id, r.pre], []
        while up is not None and up.node_type not in ("Function", "Method"):
            path += [up.node_type] if up.node_type in trees.STEERING else []
            up = rows.get((r.file_id, up.parent_pre))
        assert r.path == path[::-1] and r.function_pre == (up.pre if up else None)
