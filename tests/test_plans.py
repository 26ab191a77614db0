import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from parallax.operators import reports
from parallax.plans import comparison
from parallax.sources import catalog, files
from parallax.streaming import changes

OLD = {"src/a.py": "def add(a, b):\n    total = a + b\n    return total\n\ndef gone(x):\n    return x * 2\n", "src/b.py": "def keep(v):\n    print(v)\n    return v\n"}
NEW = {"src/a.py": "def add(a, b):\n    total = a + b + 0\n    return total\n\ndef fresh(zz):\n    import os\n    os.remove(zz)\n", "lib/b.py": "def keep(v):\n    print(v)\n    return v\n"}


@pytest.fixture
def folders(tmp_path):
    for name, tree in (("old", OLD), ("new", NEW)):
        for path, content in tree.items():
            p = tmp_path / name / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(content)
    return str(tmp_path / "old"), str(tmp_path / "new")


def test_compare_folders(spark, folders, tmp_path):
    c = comparison.compare_folders(spark, *folders)
    kinds = {r["name"]: r.change_type for r in c.changes.collect()}
    assert kinds == {"add": "modified", "gone": "deleted", "fresh": "added", "keep": "moved"}
    assert c.changes.where("name = 'keep'").first().is_unchanged_move
    s = c.summary().first()
    assert (s.n_added, s.n_deleted, s.n_modified, s.n_moved, s.n_total) == (1, 1, 1, 1, 3)
    assert [r["name"] for r in c.changed().collect()] == ["add", "fresh", "gone"]
    assert c.diff("add").where("change_type = 'modified'").count() == 1
    c.save(str(tmp_path / "kept"), "one")
    assert comparison.Comparison.load(spark, str(tmp_path / "kept"), "one").changes.count() == 4
    opt = comparison.compare(*[comparison.codefront.functions(files.scan(spark, f).select(F.col("rel_path").alias("path"), "content")) for f in folders], optimal=True)
    assert {r["name"]: r.change_type for r in opt.changes.collect()} == kinds


def test_scan(spark, folders):
    old = files.scan(spark, folders[0])
    assert {r.rel_path for r in old.collect()} == set(OLD)
    assert files.scan(spark, folders[0], include=("*a.py",)).count() == 1
    assert files.scan(spark, folders[0], max_depth=1).count() == 0
    rows, errors = files.read_many(spark, folders[0], ["src/a.py", "nope"])
    assert rows.count() == 1 and [(r.rel_path, r.error) for r in errors.collect()] == [("nope", "not found")]
    assert [(r["name"], r.is_dir, r.n_files) for r in files.listing(old).collect()] == [("src", True, 2)]
    assert {r.folder for r in files.tree(old).collect()} == {"", "src"}
    both = files.paired(old, files.scan(spark, folders[1]))
    assert both.where("source is null").count() == 1 and both.where("target is null").count() == 1


def test_compare_names(spark):
    s = "id int, name string, address string, code string"
    a = spark.createDataFrame([(1, "main", "0x1000", "if (x) f(1);"), (2, "process_data", "0x2000", "g(16);")], s)
    b = spark.createDataFrame([(1, "main", "0x1100", "f(1, 2);"), (2, "process_dat", "0x1100", "g(17);"), (3, "new", "0x3", "")], s)
    c = comparison.compare_names(a, b)
    assert c.list_matches().count() == 2 and c.summary().first().n_added == 1
    assert [r.category for r in c.list_all().collect()] == ["matched", "matched", "added"]
    assert c.suggest("mian").first()["name"] == "main"
    assert c.analyse("main")["arguments"].count() == 1 and c.diff("main").count() >= 1
    assert c.distribution().first().n == 2


def test_render(spark):
    df = spark.createDataFrame([("a<b", 1, None)], "x string, y int, z string")
    assert "a&lt;b" in reports.render(df, "html") and "| a<b | 1 |  |" in reports.render(df, "markdown")
    assert reports.render(df, "xml").startswith("<report>") and reports.render(df) == "x=a<b  y=1  z="
    assert json.loads(reports.json_rows(df).first().json) == {"x": "a<b", "y": 1}
    row = spark.createDataFrame([("a,b", "c", "Java", 0.5, 1, 2, 3)], "source_file string, target_file string, language string, similarity double, changes int, refactoring_patterns int, processing_time_ms int")
    assert reports.csv_lines(row).first().line == '"a,b",c,Java,0.500000,1,2,3'


def test_catalog(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"functions": [{"name": "main", "address": "0x1"}]}) if self.path == "/functions" else "int main() {}"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    catalog.register(spark)
    df = spark.read.format("function_catalog").options(urls=f"http://127.0.0.1:{server.server_port}", code="true").load()
    assert [(r["name"], r.address, r.code) for r in df.collect()] == [("main", "0x1", "int main() {}")]
    server.shutdown()
    assert list(catalog.function_rows("main 0x1\nf 0x2\n")) == [("main", "0x1", "main"), ("f", "0x2", "f")]


def test_stream(spark, tmp_path):
    base, src, out = str(tmp_path / "base"), str(tmp_path / "in"), str(tmp_path / "out")
    s = "k int, name string, v int, ts timestamp"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, name string, v int, t string").selectExpr("k", "name", "v", "cast(t as timestamp) as ts")
    rows((1, "a", 1, "2024-01-01"), (2, "b", 1, "2024-01-01")).select("k", "name", "v").write.parquet(f"{base}/0")
    rows((1, "a", 1, "2024-01-02"), (1, "a", 2, "2024-01-03"), (3, "c", 1, "2024-01-02")).write.parquet(src)
    stream = spark.readStream.schema(s).parquet(src)
    changes.compare_stream(stream, base, out, str(tmp_path / "cp"), key=["k"], name="name", values=["v"], time="ts").awaitTermination()
    assert {(r.k, r.change_type) for r in spark.read.parquet(out).collect()} == {(1, "modified"), (3, "added")}
    assert {(r.k, r.v) for r in spark.read.parquet(f"{base}/1").collect()} == {(1, 2), (2, 1), (3, 1)}
