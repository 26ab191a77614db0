import random

from parallax.operators import symbols


def _plain(a, b, near):
    key = lambda r: r[:3]
    gone, new = [r for r in a if key(r) not in {key(x) for x in b}], [r for r in b if key(r) not in {key(x) for x in a}]
    out, used, kept = [], set(), set()
    for n, k, f, _ in gone:
        if to := [x[2] for x in new if x[:2] == (n, k)]:
            out.append((n, k, f, min(to), "name"))
            used.add((n, k, f))
            kept.add((n, k, min(to)))
    free = [x for x in new if key(x) not in kept]
    for n, k, f in {key(r) for r in gone} - used:
        offers = [(abs(r[3] - x[3]), x[2], x[0]) for r in gone if key(r) == (n, k, f) for x in free if x[1] == k and abs(r[3] - x[3]) <= near]
        if offers:
            out.append((n, k, f, min(offers)[1], "line"))
    return sorted(out)


def test_as_a_plain_search(spark):
    """Symbols of several lines included: the nearest of all their lines counts."""
    r = random.Random(11)
    rows = lambda names: [(f"n{r.choice(names)}", r.choice("fv"), f"f{r.randrange(5)}", r.randrange(60)) for _ in range(60)]
    a, b = rows(range(40)), rows(range(25, 70))
    frame = lambda d: spark.createDataFrame(d, "name string, kind string, file_path string, line int")
    for near in (0, 3, 10):
        got = sorted(map(tuple, symbols.migrations(frame(a), frame(b), near).collect()))
        assert got == _plain(a, b, near) and {x[4] for x in got} == {"name", "line"}


def test_symbols_are_not_multiplied_by_lines_near_by(spark):
    """Only the lines of a kind are spread over those near by, not each symbol."""
    a = spark.createDataFrame([(f"a{i}", "f", "old", i % 3) for i in range(3000)], "name string, kind string, file_path string, line int")
    b = spark.createDataFrame([(f"b{i}", "f", "new", i % 5) for i in range(50)], "name string, kind string, file_path string, line int")
    out = symbols.migrations(a, b)
    assert out.count() == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spread = plan[plan.index("Generate explode"):]
    assert "Aggregate [kind" in spread.split("LogicalRDD")[0]
