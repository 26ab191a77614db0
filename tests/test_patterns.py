import random

from parallax.operators import codefront, patterns

JAVA = """class T {
  private Map<K,V> size;
  void run(int a) {
    if (a == null || isError(b)) { throw new Bad(); }
    for (int i = 0; i < n; i++) { while (q) { for (P p : b) { sortAll(p); } } }
    try (R r = openFile(a)) { this.run(a); } catch (E e) { }
    switch (a) { case 1: closeIt(); }
    String s = getName();
  }
  void quiet() { }
  void loops() { for (int i = 0; i < 3; i++) { go(); } while (x) { findIt(); } }
}
"""
PYTHON = """def outer(a):
    n: int = 3
    for x in a:
        def inner(b):
            for y in b:
                validate(y)
            if b.error:
                return inner(b)
"""


def test_sets_of_functions(spark):
    files = spark.createDataFrame([("T.java", JAVA), ("m.py", PYTHON), ("none.txt", "words"), ("null.txt", None)], "path string, content string")
    got = {(r.file_id, r.name): r for r in patterns.function_patterns(codefront.source_nodes(files)).collect()}
    assert set(got) == {("T.java", ""), ("T.java", "run"), ("T.java", "quiet"), ("T.java", "loops"), ("m.py", ""), ("m.py", "outer"), ("m.py", "inner"), ("none.txt", ""), ("null.txt", "")}
    run = got["T.java", "run"]
    assert run.types == ["String"] and run.apis == ["accessor_pattern"]
    assert run.errors == ["error_check", "throw_exception", "try_catch"]
    assert run.resources == ["resource_acquisition", "resource_cleanup", "try_with_resources"]
    assert run.algorithms == ["conditional_logic", "iteration", "multi_branch", "nested_iteration", "recursion", "sorting_algorithm", "while_iteration"]
    assert {"id:a", "id:null", "lit:0", "op:||", "type:String"} <= set(run.content)
    assert got["T.java", "loops"].algorithms == ["iteration", "search_algorithm", "while_iteration"]  # one after the other: not nested
    assert got["T.java", "quiet"].algorithms == [] and got["T.java", "quiet"].content == []
    assert got["T.java", ""].types == ["Map<K,V>", "String"] and set(run.algorithms) <= set(got["T.java", ""].algorithms)
    inner, outer = got["m.py", "inner"], got["m.py", "outer"]
    assert inner.algorithms == ["conditional_logic", "iteration", "recursion"] and inner.errors == ["error_check"] and inner.apis == ["validation_pattern"]
    assert outer.algorithms == ["conditional_logic", "iteration", "nested_iteration", "recursion"] and outer.types == ["int"]


def test_as_a_walk_through_each_subtree(spark):
    """Random trees: each function's sets are those of a plain walk from it."""
    r = random.Random(8)
    rows, children = [], {}
    for pre in range(400):
        # Pre-order: a parent must be open, that is on the path of the node before.
        path, p = [], pre - 1
        while pre and p is not None:
            path.append(p)
            p = rows[p][1]
        parent = None if pre == 0 else r.choice(path[:3])
        kind = "Program" if pre == 0 else r.choice(["Function", "ForLoop", "WhileLoop", "IfStatement", "CallExpression", "Identifier", "Block"])
        text = r.choice(["f", "g", "sort", "getIt"]) if kind in ("Function", "CallExpression", "Identifier") else ""
        rows.append([pre, parent, kind, text])
        children.setdefault(parent, []).append(pre)

    def end(n):
        return max([n, *(end(c) for c in children.get(n, []))])

    def walk(n, depth, name, out):
        _, _, kind, text = rows[n]
        out |= {"ForLoop": {"iteration"} | ({"nested_iteration"} if depth else set()), "WhileLoop": {"while_iteration"}, "IfStatement": {"conditional_logic"}}.get(kind, set())
        if kind == "CallExpression":
            out |= ({"sorting_algorithm"} if "sort" in text else set()) | ({"recursion"} if text == name else set())
        for c in children.get(n, []):
            walk(c, depth + (kind in patterns.LOOPS), rows[c][3] if rows[c][2] == "Function" else name, out)
        return out

    nodes = spark.createDataFrame([("f", p, q, end(p), k, t, {}) for p, q, k, t in rows], "file_id string, pre int, parent_pre int, subtree_end_pre int, node_type string, text string, attributes map<string,string>")
    got = {x.pre: set(x.algorithms) for x in patterns.function_patterns(nodes).collect()}
    assert got == {p: walk(p, 0, t, set()) for p, _, k, t in rows if k in ("Function", "Program")} and len(got) > 20


def test_scores_and_empty(spark):
    files = spark.createDataFrame([("a.py", PYTHON), ("b.py", PYTHON.replace("validate", "sort"))], "path string, content string")
    own = patterns.function_patterns(codefront.source_nodes(files)).where("name = ''")
    pair = spark.createDataFrame([("a.py", "b.py"), ("a.py", "a.py")], "a string, b string")
    got = {r.b: r for r in patterns.scores(pair, own, "file_id").collect()}
    assert got["a.py"].semantic == 1.0 and got["a.py"].content == 1.0
    assert abs(got["b.py"].semantic - (1 + 0 + 1 + 1 + 4 / 5) / 5) < 1e-9
    assert patterns.function_patterns(codefront.source_nodes(files.limit(0))).count() == 0
