import pytest
from pyspark.sql import functions as F

from parallax.functions import classify, similarity, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (similarity.char_jaccard, "hello", "help", 3 / 5),
        (similarity.char_jaccard, "", "x", 0.0),
        (similarity.char_jaccard, "", "", 1.0),
        (similarity.edit_similarity, "kitten", "sitting", 1 - 3 / 7),
        (similarity.edit_similarity, "", "", 1.0),
        (similarity.edit_similarity, "é", "e", 0.0),
        (similarity.name_similarity, "get_user", "getUser", 0.95),
        (similarity.line_similarity, "abc", "abd", 2 / 3),
        (similarity.line_similarity, " abc ", "abc", 1.0),
        (similarity.type_similarity, "int", "i32", 1.0),
        (similarity.type_similarity, "List<String>", "List<Integer>", 0.82),
        (similarity.type_similarity, "List<String>", "ArrayList<String>", 0.82),
        (similarity.search_similarity, "main", "MAIN", 0.95),
    ],
)
def test_pairs(spark, f, a, b, want):
    assert value(spark, f(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_nulls(spark):
    null = F.lit(None).cast("string")
    assert value(spark, similarity.edit_similarity(null, F.lit("a"))) is None


def test_calls_and_sets(spark):
    a, b = F.array(F.lit("x"), F.lit("y"), F.lit("y")), F.array(F.lit("y"))
    assert value(spark, similarity.call_overlap(a, b)) == pytest.approx(2 / 3)
    empty = F.expr("cast(array() as array<string>)")
    assert value(spark, similarity.call_overlap(empty, empty)) == 1.0
    assert value(spark, similarity.set_jaccard(a, b)) == pytest.approx(1 / 2)


def test_control_flow(spark):
    paths = F.array(F.array(F.lit("if"), F.lit("for")))
    other = F.array(F.array(F.lit("if")), F.array(F.lit("while")))
    assert value(spark, similarity.control_flow_similarity(paths, other)) == pytest.approx(1 / 2)
    none = F.expr("cast(array() as array<array<string>>)")
    assert value(spark, similarity.control_flow_similarity(none, other)) == 1.0
    assert value(spark, similarity.control_flow_similarity(paths, none)) == 0.0


@pytest.mark.parametrize("path, want", [("a/b.Py", "py"), ("a.b/c", None), (".bashrc", None), ("x.tar.gz", "gz")])
def test_extension(spark, path, want):
    assert value(spark, text.extension(F.lit(path))) == want


@pytest.mark.parametrize("content, want", [("", []), ("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(spark, content, want):
    assert value(spark, text.lines(F.lit(content))) == want


@pytest.mark.parametrize("pattern, want", [("*.java", True), ("src/*", True), ("*Calc*", True), ("Calc.java", True), ("Calc", False), ("src/*.py", False)])
def test_glob(spark, pattern, want):
    assert value(spark, text.glob(F.lit("src/Calc.java"), pattern)) is want


def test_excludes_win(spark):
    assert value(spark, text.wanted(F.lit("a/b.py"), ("*.py",), ("a/*",))) is False


@pytest.mark.parametrize("kind, s, want", [("modified", 0.8, 0.2), ("renamed", 0.5, 0.3), ("moved", 0.5, 0.2), ("added", None, 1.0)])
def test_magnitude(spark, kind, s, want):
    assert value(spark, classify.magnitude(F.lit(kind), F.lit(s).cast("double"))) == pytest.approx(want)


def element(name="f", path="a", line=1):
    return F.struct(F.lit(name).alias("name"), F.lit(path).alias("file_path"), F.lit(line).alias("start_line"))


@pytest.mark.parametrize("other, want", [((), "modify"), (("g",), "rename"), (("f", "a", 2), "move"), (("f", "b"), "cross_file_move"), (("g", "b"), "rename")])
def test_change_type(spark, other, want):
    assert value(spark, classify.change_type(element(), element(*other))) == want


def test_line_tags(spark):
    assert value(spark, classify.line_tags(F.lit("x = 1"), F.lit("if y: return"))) == ["Control flow change", "Return statement change", "Assignment change"]
