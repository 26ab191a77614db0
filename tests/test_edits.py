import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parallax.operators import align, trees

KINDS = ["IfStatement", "WhileLoop", "B"]
tree = st.recursive(st.tuples(st.sampled_from(KINDS), st.just(())), lambda c: st.tuples(st.sampled_from(KINDS), st.lists(c, max_size=3).map(tuple)), max_leaves=8)


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


def remaining(left, gone, label):
    """The forest of nodes that are not gone, nested, by post-order."""
    out = []  # (first leaf, nested)
    for k, first in enumerate(left):
        if k in gone:
            continue
        inner = []
        while out and out[-1][0] >= first:
            inner.append(out.pop()[1])
        out.append((first, (label(k), tuple(inner[::-1]))))
    return tuple(x for _, x in out)


@given(tree, tree)
@settings(max_examples=150, deadline=None)
def test_operations_cost_the_distance_and_give_the_target(a, b):
    (la, fa), (lb, fb) = arrays(a), arrays(b)
    steps = trees.EditTables(la, fa, lb, fb).operations()
    renamed = dict((x, y) for x, y in steps if x is not None and y is not None)
    assert sorted(x for x, _ in steps if x is not None) == list(range(len(la))) and sorted(y for _, y in steps if y is not None) == list(range(len(lb)))
    cost = sum(1.0 if x is None or y is None else 0.0 if la[x] == lb[y] else trees.CHEAP.get((la[x], lb[y]), 1.0) for x, y in steps)
    assert cost == pytest.approx(trees.edit_distance(la, fa, lb, fb))
    # Without deleted nodes and with new names the source is the target without inserted nodes.
    deleted, inserted = {x for x, y in steps if y is None}, {y for x, y in steps if x is None}
    assert remaining(fa, deleted, lambda k: lb[renamed[k]]) == remaining(fb, inserted, lambda k: lb[k])
    assert [renamed[x] for x in sorted(renamed)] == sorted(renamed.values())


def test_operation_rows(spark):
    html = spark.createDataFrame([("x", "<div><p>a</p><b>c</b></div>"), ("y", "<div><p>a</p><i>c</i><br></div>"), ("z", "")], "file_id string, content string")
    pairs = spark.createDataFrame([("x", "y"), ("z", "x"), ("x", "x")], "a string, b string")
    rows = trees.operations(pairs, trees.parse(html)).collect()
    distance = {(r.a, r.b): r.distance for r in trees.compare(pairs, trees.parse(html), min_ratio=0).collect()}
    assert {(r.operation, r.old, r.new) for r in rows if r.a == "x"} == {("rename", "b", "i"), ("insert", None, "br")}
    assert sum(r.cost for r in rows if r.a == "z") == distance["z", "x"] == 5 and all(r.operation == "insert" and r.post_a is None for r in rows if r.a == "z")
    marked = trees.compare(pairs, trees.parse(html), min_ratio=0.5).where("not aligned").collect()
    assert [(r.a, r.distance) for r in marked] == [("z", 5.0)]


def whole_table(p, q):
    t = np.zeros((len(p) + 1, len(q) + 1), dtype=int)
    for i, x in enumerate(p, 1):
        for j, y in enumerate(q, 1):
            t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
    return t


def test_rows_of_the_line_table():
    rng = np.random.default_rng(0)
    for n, m in [(0, 3), (3, 0), (1, 1), (7, 5), (30, 40), (65, 20)]:
        p, q = rng.integers(0, 6, n), rng.integers(0, 6, m)
        table, want = align.Table(p, q), whole_table(p, q)
        for i in range(n, -1, -1):
            assert table.row(i).tolist() == want[i].tolist()
            assert table.row(max(0, i - 1)).tolist() == want[max(0, i - 1)].tolist()


def test_alignment_of_many_lines_in_little_memory():
    r = random.Random(0)
    a, b = [[str(r.randrange(6000)) for _ in range(6000)] for _ in range(2)]
    tracemalloc.start()
    steps = align.align(a, b, replace=False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20  # the whole table would take 144 MB
    assert [a[i] for _, i, _ in steps if i is not None] == a and [b[j] for _, _, j in steps if j is not None] == b
    assert sum(k == "unchanged" for k, _, _ in steps) == align.Table(*[np.array([int(x) for x in s]) for s in (a, b)]).row(6000)[-1]


@given(tree, tree)
@settings(max_examples=100, deadline=None)
def test_tables_filled_together_are_those_of_single_forests(a, b):
    (la, fa), (lb, fb) = arrays(a), arrays(b)
    together = trees.EditTables(la, fa, lb, fb)
    apart = object.__new__(trees.EditTables)
    apart.__dict__.update(together.__dict__, tree=np.zeros((len(la), len(lb))))
    for i in sorted({first: k for k, first in enumerate(fa)}.values()):
        for j in sorted({first: k for k, first in enumerate(fb)}.values()):
            apart.forest(i, j)
    assert together.tree == pytest.approx(apart.tree)


def test_small_trees_need_no_forest_of_their_own(monkeypatch):
    monkeypatch.setattr(trees.EditTables, "forest", lambda *_: pytest.fail("a forest by itself"))
    (la, fa), (lb, fb) = arrays(("B", (("B", ()), ("B", (("A", ()),))))), arrays(("B", (("A", ()),)))
    assert trees.edit_distance(la, fa, lb, fb) == 2


def test_equal_pairs_of_trees_are_compared_once(spark):
    html = spark.createDataFrame([(str(k), f"<p>{k}</p>" if k % 2 else f"<p><b>{k}</b></p>") for k in range(20)], "file_id string, content string")
    pairs = spark.createDataFrame([(str(k), str(k + 1)) for k in range(19)], "a string, b string")
    keyed, every = trees._distinct(pairs, trees.parse(html))
    assert keyed.count() == 19 and every.count() == 2
    assert {(r["distance"], r["aligned"]) for r in trees.compare(pairs, trees.parse(html)).collect()} == {(1.0, True)}
    assert trees.operations(pairs, trees.parse(html)).count() == 19


def test_a_tree_against_none():
    assert trees.EditTables(["A"], [0], [], []).operations() == [(0, None)] and trees.EditTables([], [], ["A"], [0]).operations() == [(None, 0)]
