import difflib
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallax.operators import align, candidates, codefront, graph, hierarchy, matching, names, refactor, search, symbols, trees


@given(st.integers(1, 5), st.integers(0, 2), st.randoms())
@settings(max_examples=40, deadline=None)
def test_assignment_is_cheapest(n, more, r):
    cost = np.array([[r.randint(0, 9) for _ in range(n + more)] for _ in range(n)], dtype=float)
    found = matching.assign(cost)
    assert sorted(i for i, _ in found) == list(range(n)) and len({j for _, j in found}) == n
    assert sum(cost[i, j] for i, j in found) == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n + more), n))


def random_pairs(seed):
    r = random.Random(seed)
    return sorted({(r.randint(0, 9), r.randint(0, 9)): r.randint(1, 6) / 6 for _ in range(40)}.items())


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matchings(spark, seed):
    rows = [(a, b, s) for (a, b), s in random_pairs(seed)]
    df = spark.createDataFrame(rows, "a int, b int, score double")
    taken, want = set(), set()
    for a in sorted({r[0] for r in rows}):
        free = [(-s, b) for x, b, s in rows if x == a and b not in taken]
        if free:
            taken.add(min(free)[1])
            want.add((a, min(free)[1]))
    assert {(r.a, r.b) for r in matching.greedy_in_order(df).collect()} == want
    used_a, used_b, want = set(), set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in rows):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    assert {(r.a, r.b) for r in matching.greedy_best_first(df).collect()} == want


def test_optimal(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.8), (3, 3, 0.6)], "a int, b int, score double")
    found = {(r.a, r.b) for r in matching.optimal(df, 0.7).collect()}
    assert found == {(1, 2), (2, 1)}  # two pairs rather than the best one


def test_names(spark):
    a = spark.createDataFrame([(1, "main"), (2, "process_data"), (3, "ab")], "id int, name string")
    b = spark.createDataFrame([(1, "main"), (2, "main"), (3, "process_dat"), (4, "abcd")], "id int, name string")
    m, added, deleted = names.match_names(a, b)
    got = {(r.a, r.b, r.phase): r for r in m.collect()}
    assert set(got) == {(1, 2, "exact"), (2, 3, "fuzzy")}
    assert got[2, 3, "fuzzy"].confidence == pytest.approx(0.8 * 11 / 12)
    assert {r.id for r in added.collect()} == {1, 4} and {r.id for r in deleted.collect()} == {3}


def test_near_pairs_are_complete(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "name string")

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    want = {(x, y) for x in words for y in words if distance(x, y) <= 2}
    assert {(p.x, p.y) for p in names.near_pairs(df, df, 2).collect()} == want


def test_jaccard_pairs_are_complete(spark):
    r = random.Random(2)
    sets = {i: {r.choice("abcdefgh") for _ in range(r.randint(1, 6))} for i in range(25)}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id int, token string")
    want = {(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert {(p.a, p.b) for p in candidates.jaccard_pairs(df, df, 0.5).collect()} == want


def test_file_moves(spark):
    a = spark.createDataFrame([("src/Calculator.java", "class Calculator { }"), ("src/Keep.java", "class Keep { }")], "path string, content string")
    b = spark.createDataFrame([("lib/Calculator.java", "class Calculator { }"), ("src/Keep.java", "class Keep { }")], "path string, content string")
    (row,) = candidates.file_moves(a, b).collect()
    assert (row.a, row.b, row.kind) == ("src/Calculator.java", "lib/Calculator.java", "move") and row.score == pytest.approx(0.9)


def test_file_splits_and_merges(spark):
    one = spark.createDataFrame([("Utils.java", "class StringUtils {}\nclass MathUtils {}")], "path string, content string")
    two = spark.createDataFrame([("A.java", "class StringUtils {}"), ("B.java", "class MathUtils {}")], "path string, content string")
    assert [r.parts for r in candidates.file_splits(one, two).collect()] == [["A.java", "B.java"]]
    assert [r.parts for r in candidates.file_merges(two, one).collect()] == [["A.java", "B.java"]]


def test_relatedness(spark):
    rows = [("src/main/Calculator.java", "src/main/MathUtils.java", True), ("Calculator.java", "CalculatorUtils.java", True), ("src/main/Calculator.java", "test/unit/DatabaseTest.java", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", candidates.related_files(F.col("a"), F.col("b"))).collect())
    rows = [("processData", "processDataPart1", True), ("calculateTotal", "calculateTotalHelper", True), ("processData", "formatOutput", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", candidates.split_name(F.col("a"), F.col("b"))).collect())
    rows = [("validateInput", "combinedValidation", True), ("processData", "calculateTotal", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", candidates.merge_name(F.col("a"), F.col("b"))).collect())


lines = st.lists(st.sampled_from("abcd"), max_size=12)


@given(lines, lines, st.booleans())
@settings(max_examples=150, deadline=None)
def test_alignment(a, b, replace):
    steps = align.align(a, b, replace=replace)
    assert [i for _, i, _ in steps if i is not None] == list(range(len(a)))
    assert [j for _, _, j in steps if j is not None] == list(range(len(b)))
    assert all(a[i] == b[j] for k, i, j in steps if k == "unchanged")
    if not replace:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(k == "unchanged" for k, _, _ in steps) == table[-1][-1] >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())


@given(lines, lines)
@settings(max_examples=100, deadline=None)
def test_look_ahead_keeps_all_lines(a, b):
    steps = align.align_ahead(a, b)
    assert [i for _, i, _ in steps if i is not None] == list(range(len(a))) and [j for _, _, j in steps if j is not None] == list(range(len(b)))


def test_hunks(spark):
    a, b = [f"line {i}" for i in range(30)], [f"line {i}" for i in range(30)]
    b[3], b[25] = "other", "more"
    df = spark.createDataFrame([("p", "\n".join(a), "\n".join(b))], "pair_id string, source string, target string")
    rows = align.unified(align.line_map(df, mode="plain")).orderBy("hunk").collect()
    assert [r.header for r in rows] == ["@@ -1,7 +1,7 @@", "@@ -23,7 +23,7 @@"]
    assert "-line 3" in rows[0].body and "+other" in rows[0].body


def brute_distance(a, b):
    """Edit distance of nested (label, children) forests, straight from its recursion."""
    if not a and not b:
        return 0.0
    size = lambda f: sum(1 + size(c) for _, c in f)
    if not a or not b:
        return float(size(a) + size(b))
    (x, cx), (y, cy) = a[-1], b[-1]
    change = 0.0 if x == y else trees.CHEAP.get((x, y), 1.0)
    return min(brute_distance(a[:-1] + cx, b) + 1, brute_distance(a, b[:-1] + cy) + 1, brute_distance(cx, cy) + brute_distance(a[:-1], b[:-1]) + change)


tree = st.recursive(st.tuples(st.sampled_from(["If", "While", "B"]), st.just(())), lambda c: st.tuples(st.sampled_from(["If", "While", "B"]), st.lists(c, max_size=2).map(tuple)), max_leaves=4)


def arrays(t):
    labels, left = [], []

    def walk(node):
        first = len(labels)
        for c in node[1]:
            walk(c)
        labels.append(node[0])
        left.append(first)

    walk(t)
    return labels, left


@given(tree, tree)
@settings(max_examples=80, deadline=None)
def test_tree_edit_distance(a, b):
    nested = lambda t: (t[0], tuple(nested(c) for c in t[1]))
    assert trees.edit_distance(*arrays(a), *arrays(b)) == pytest.approx(brute_distance((nested(a),), (nested(b),)))


def test_tree_tables(spark):
    html = spark.createDataFrame([("x", "<div><p>a</p><br><p>b</p></div>"), ("y", ""), ("z", None)], "file_id string, content string")
    nodes = trees.parse(html)
    assert [(r.kind, r.pre, r.post, r.subtree_end_pre) for r in nodes.where("file_id = 'x'").orderBy("pre").collect()] == [("document", 0, 6, 6), ("div", 1, 5, 6), ("p", 2, 1, 3), ("text", 3, 0, 3), ("br", 4, 2, 4), ("p", 5, 4, 6), ("text", 6, 3, 6)]
    m = {r.file_id: r.n_nodes for r in trees.metrics(nodes).collect()}
    assert m == {"x": 7, "y": 1, "z": 1}
    python = trees.parse(spark.createDataFrame([("f", "def f(x):\n  if x:\n    return g(x)\n"), ("bad", "def (")], "file_id string, content string"), "python")
    got = {r.file_id: r for r in trees.metrics(python).collect()}
    assert got["f"].cyclomatic == 2 and got["f"].n_functions == 1 and got["bad"].n_nodes == 1


def test_optimised_trees():
    leaf = lambda kind, text="", line=1: [kind, kind, text, line, []]
    tree = ["Program", "p", "", 1, [leaf("Unknown"), ["Block", "b", "", 1, [leaf("Identifier", "x")]], leaf("Literal", "1"), leaf("Literal", "2", 2), leaf("Literal", "3", 9), ["Block", "b", "", 3, [leaf("Unknown"), leaf("Unknown", "y")]]]]
    got = trees.optimised(tree)
    assert [(c[0], c[2]) for c in got[4]] == [("Identifier", "x"), ("Literal", "1 2"), ("Literal", "3"), ("Unknown", "y")]
    assert trees.optimised(leaf("Unknown")) is None


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    assert {(r.node, r.scc) for r in graph.cycles(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert {(r.node, r.component) for r in graph.connected_components(e).collect()} == {(x, "a") for x in "abcd"} | {("e", "e")}
    dag = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {(r.node, r.layer) for r in graph.layers(nodes, dag).collect()} == {("c", 0), ("d", 0), ("b", 1), ("a", 2)}
    assert {(r.node, r.layer) for r in graph.layers(nodes, e).collect() if r.node != "d"} == {("a", 1), ("b", 1), ("c", 1)}
    c = {r.node: (r.ca, r.ce) for r in graph.coupling(e.withColumn("edge_type", F.lit("x"))).collect()}
    assert c["c"] == (1, 2)
    imports = spark.createDataFrame([("m.py", "a.b"), ("m.py", "zz")], "file_path string, module string")
    files = spark.createDataFrame([("a/b.py",), ("a/b/__init__.py",)], "path string")
    assert [(r.src, r.dst) for r in graph.import_edges(imports, files).collect()] == [("m.py", "a/b.py")]


def test_long_chain(spark):
    n = 300
    p = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "child int, parent int")
    assert graph.ancestors(p).where(f"node = {n - 1}").agg(F.max("depth")).first()[0] == n - 1


def test_hierarchy(spark):
    p = spark.createDataFrame([("Child", "Parent"), ("Parent", "GrandParent"), ("Other", "Parent")], "child string, parent string")
    up = {(r.node, r.ancestor) for r in graph.ancestors(p).collect()}
    assert ("Child", "GrandParent") in up and ("Parent", "Child") not in up
    assert [(r.a, r.b) for r in graph.siblings(p).collect()] == [("Child", "Other")]
    method = "array<struct<name:string>>"
    schema = f"name string, file_path string, parent string, methods {method}, fields {method}, interfaces array<string>"
    row = lambda path: [("MyClass", path, None, [("foo",), ("bar",)], [], [])]
    (move,) = hierarchy.class_moves(spark.createDataFrame(row("old/MyClass.java"), schema), spark.createDataFrame(row("new/MyClass.java"), schema)).collect()
    assert move.confidence == pytest.approx(1.0)
    m = "class_name string, name string, signature string, visibility string, is_static boolean, is_abstract boolean"
    f = lambda c, n: (c, n, f"void {n}()", "public", False, False)
    a = spark.createDataFrame([f("Child", "run"), f("Child", "stay"), f("Parent", "x")], m)
    b = spark.createDataFrame([f("Parent", "run"), f("Child", "stay"), f("Parent", "x")], m)
    found = hierarchy.migration_kinds(hierarchy.method_migrations(a, b), p, spark.createDataFrame([("Child",), ("Parent",)], "name string"))
    assert [(r.method, r.kind) for r in found.collect()] == [("run", "pull_up")]


def test_symbols(spark):
    s = "name string, kind string, file_path string, line int"
    a = spark.createDataFrame([("f", "fn", "x", 1), ("g", "fn", "x", 20), ("h", "fn", "x", 3)], s)
    b = spark.createDataFrame([("f", "fn", "y", 1), ("g2", "fn", "z", 25), ("h", "fn", "x", 3)], s)
    assert {(r["name"], r.to_file, r.by) for r in symbols.migrations(a, b).collect()} == {("f", "y", "name"), ("g", "z", "line")}


def test_code_front_end(spark):
    java = "public class A {\n  public int add(int a, int b) {\n    if (a > 0) { return a + b; }\n    return helper(a);\n  }\n}\n"
    python = "def f(x, y):\n    for i in x:\n        g(i)\n\nclass B(A):\n    def m(self):\n        return 1\n"
    df = spark.createDataFrame([("A.java", java), ("b.py", python)], "path string, content string")
    fns = {r["name"]: r for r in codefront.with_measures(codefront.functions(df)).collect()}
    assert set(fns) == {"add", "f", "m"}
    assert fns["add"].params == ["int a", "int b"] and (fns["add"].start_line, fns["add"].end_line) == (2, 5) and fns["add"].calls == ["helper"]
    assert fns["f"].end_line == 3 and fns["f"].cyclomatic == 2
    assert {(r["name"], r.parent) for r in codefront.classes(df).collect()} == {("A", None), ("B", "A")}
    lang = df.select(codefront.language_of_content(F.col("content")).alias("l")).collect()
    assert [r.l for r in lang] == ["Java", "Python"]


def test_search(spark):
    files = spark.createDataFrame([("a/hello.txt", "x\nHello there\nhello"), ("b.txt", "none")], "path string, content string")
    (r,) = search.grep(files, "hello").collect()
    assert (r.path, r.score, r.first_line, r.first_column) == ("a/hello.txt", 2.0, 2, 1)
    pairs = spark.createDataFrame([("p", "f(1, 2); g(0x10)", "f(1); h(3)")], "pair_id string, source string, target string")
    c = search.set_differences(pairs, search.calls).first()
    assert (c.removed, c.added, c.common) == (["g"], ["h"], ["f"])
    assert [r.call for r in search.argument_drift(pairs).collect()] == ["f"]
    assert pairs.select(search.control_flow(F.lit("if (x) { while (y) { } }"))["max_nesting"]).first()[0] == 2


def test_refactorings(spark):
    e = "struct<name:string,file_path:string,start_line:int,element_type:string,signature:string>"
    f = lambda n, line, kind="function": (n, "Service.java", line, kind, f"fn {n}()")
    rows = [(1, "modify", f("processData", 10), f("processData", 10), 0.8), (2, "add", None, f("validateInput", 50), None), (3, "rename", f("a", 900), f("b", 900), 0.95)]
    df = spark.createDataFrame(rows, f"change_id int, change_type string, source {e}, target {e}, similarity double")
    got = {r.pattern: r for r in refactor.patterns(df).collect()}
    assert got["extract_method"].confidence == pytest.approx(1.0) and got["extract_method"].change_ids == [1, 2]
    assert got["rename"].change_ids == [3]


def test_tree_edit_distance_of_whole_pages(spark, tmp_path):
    """Pages that differ only below the third level, against brute force."""
    from parallax.plans import catalogue

    inner = ["<p>x</p>", "<b>x</b>", "<b><i>x</i></b>", "<p>x</p><p>y</p>"]
    spark.createDataFrame([(i, "u", f"<html><body><div>{x}</div></body></html>") for i, x in enumerate(inner)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    text = ("text", ())
    trees_of = [(("p", (text,)),), (("b", (text,)),), (("b", (("i", (text,)),)),), (("p", (text,)), ("p", (text,)))]
    nested = [(("document", (("html", (("body", (("div", x),)),)),)),) for x in trees_of]
    got = {int(r.a): r for r in catalogue.tree_edit_distance(spark, str(tmp_path)).collect()}
    assert {k: r.distance for k, r in got.items()} == {k: brute_distance(nested[k], nested[k + 1]) for k in range(3)}
    assert got[0].positional == 0 and got[2].positional == 0.5


def test_tree_comparison_of_deep_trees():
    labels, left = ["x"] * 3000, [0] * 3000
    assert trees.positional_similarity(labels, left, labels, left) == 1 and trees.positional_similarity(labels, left, labels, left, partial=True) == 0.5


def test_migrations_by_line(spark):
    """The nearest other name of the kind, then the first by path and name, as comparing all with all gives; one kind holds nearly all."""
    import random

    r = random.Random(5)
    table = lambda p: [(f"{p}{i}", "k" if i % 9 else "m", f"f{r.randrange(4)}", r.randrange(60)) for i in range(120)]
    a, b = table("a") + [("both", "k", "f1", 3)], table("b") + [("both", "k", "f2", 3)]
    want = {("both", "k", "f1", "f2", "name")}
    for name, kind, path, line in a[:-1]:
        near = [(abs(line - y[3]), y[2], y[0]) for y in b[:-1] if y[1] == kind and abs(line - y[3]) <= symbols.NEAR_LINES]
        if near:
            want.add((name, kind, path, min(near)[1], "line"))
    schema = "name string, kind string, file_path string, line int"
    got = symbols.migrations(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select("name", "kind", "from_file", "to_file", "by")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_words_of_any_script_bound_control_flow(spark):
    from parallax.operators import search

    df = spark.createDataFrame([("if if(x) \u00e9if if\u00e9 _if while for_ for",), ("",), (None,)], "t string")
    c = search.control_flow(F.col("t"))
    assert [tuple(x) for x in df.select(c["n_if"], c["n_loop"]).collect()] == [(2, 2), (0, 0), (None, None)]


def test_token_classes(spark):
    rows = [(i, "w1 w2 w3" if i % 2 else "w3 w2 w1 w1") for i in range(40)] + [(40, "w1 w2 w4 w3"), (41, ""), (42, None)]
    sets = candidates.token_sets(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), r"\w+")
    assert {r.id: r.class_id for r in candidates.members(sets).collect()} == {**{i: 0 for i in range(40)}, 40: 40}
    own = candidates.representatives(sets)
    assert [tuple(r) for r in candidates.jaccard_pairs(own, own, 0.5).where("a < b").collect()] == [(0, 40, 0.75)]


def edit_share(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_change_clusters(spark):
    """Against taking changes one after another, over all pairs: alike names of any files, and of additions and deletions."""
    r = random.Random(5)
    stems = ["getUserName", "setUserName", "loadAll", "loadOne", "x", "xy", "parseHeader", "parserHeaders", "close", ""]
    rows = []
    for i in range(90):
        name = list(r.choice(stems))
        for _ in range(r.randint(0, 4)):
            name.insert(r.randint(0, len(name)), r.choice("abcXYZ"))
        rows.append((i, r.choice(["add", "delete", "modify"]), "".join(name), f"f{r.randint(0, 12)}", r.randint(1, 2000)))

    def related(p, q):
        if p[3] == q[3] and abs(p[4] - q[4]) <= 50:
            return True
        return edit_share(p[2], q[2]) > (0.5 if {p[1], q[1]} == {"add", "delete"} else 0.7)

    want = {}
    for p in rows:
        if p[0] not in want:
            want |= {q[0]: p[0] for q in rows if q[0] >= p[0] and q[0] not in want and (q is p or related(p, q))}
    df = spark.createDataFrame(rows, "change_id int, change_type string, name string, file_path string, start_line int")
    side = F.struct("name", "file_path", "start_line")
    none = F.lit(None).cast("struct<name string, file_path string, start_line int>")
    df = df.select("change_id", "change_type", F.when(F.col("change_type") == "add", none).otherwise(side).alias("source"), F.when(F.col("change_type") == "add", side).alias("target"))
    assert dict(refactor.clusters(df).collect()) == want
    assert refactor.clusters(df.limit(0)).count() == 0
