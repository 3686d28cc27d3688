"""Walking, differences, extraction and streams."""

import json

import pytest
from pyspark.sql import functions as F

from graphmill.extract import extract, extract_files
from graphmill.functions import columns as C
from graphmill.sources import files
from graphmill.sources.languages import detect
from graphmill.streaming.index import FILES, current, incremental_index, tally_stream


def symbols(language, path, text):
    return {(r.kind, r.qualified_name) for r in extract(language, path, text) if r.what == "symbol"}


def test_python_tree():
    recs = extract("Python", "m/x.py", 'import os\nclass A:\n  """d"""\n  def f(self):\n    os.path.join(1)\n')
    assert {(r.kind, r.qualified_name) for r in recs if r.what == "symbol"} == {("Module", "m.x"), ("Class", "m.x.A"), ("Method", "m.x.A.f")}
    assert {(r.kind, r.name) for r in recs if r.what == "edge"} == {("IMPORTS", "os"), ("CALLS", "os.path.join")}


@pytest.mark.parametrize(
    "language,path,text,want",
    [
        ("Go", "b.go", "package b\ntype S struct {\n}\nfunc (s *S) Get() int { return 1 }\n", {("Module", "b"), ("Class", "b.S"), ("Method", "b.S.Get")}),
        ("JavaScript", "x.js", "class A {\n  go(x) { return f(x); }\n}\nconst k = (a) => { g(a); };\n", {("Module", "x"), ("Class", "x.A"), ("Method", "x.A.go"), ("Function", "x.k")}),
        ("Python", "p.py", "def broken(:\n  pass\n", {("Module", "p"), ("Function", "p.broken")}),
        ("Ruby", "a.rb", "class A\n  def go\n    f(1)\n  end\nend\n", {("Module", "a"), ("Class", "a.A"), ("Method", "a.A.go")}),
        ("SQL", "s.sql", "-- create table no (x)\ncreate table a (x int);", {("Module", "s"), ("Class", "s.a")}),
        ("Markdown", "r.md", "# A\n## B\n```\n# no\n```\n# C\n", {("Document", "r"), ("Section", "r.a"), ("Section", "r.a.b"), ("Section", "r.c")}),
        ("HTML", "i.html", "<h1>A</h1><h2>B</h2>", {("Document", "i"), ("Section", "i.a"), ("Section", "i.a.b")}),
        ("JSON", "c.json", '{"a": {"b": 1}}', {("Module", "c"), ("Setting", "c.a"), ("Setting", "c.a.b")}),
        ("TOML", "c.toml", "[a]\nb = 1\n", {("Module", "c"), ("Setting", "c.a"), ("Setting", "c.a.b")}),
        ("XML", "p.xml", "<a><b/></a>", {("Module", "p"), ("Setting", "p.a"), ("Setting", "p.a.b")}),
        ("HCL", "m.tf", 'resource "t" "n" {\n}\n', {("Module", "m"), ("Resource", "m.resource.t.n")}),
        ("Go", "e.go", "", {("Module", "e")}),
        ("Unknown", "e", "anything", {("Module", "e")}),
    ],
)
def test_extractors(language, path, text, want):
    assert symbols(language, path, text) == want


def test_go_members_reads_and_writes():
    text = "package p\nvar limit = 3\ntype S struct {\n\ta, b int\n\tw *Writer `json:\"w\"`\n}\ntype R interface {\n\tRead(p []byte) (int, error)\n}\nfunc (s *S) Go() {\n\ts.a = limit + cfg.Max\n\ts.w.Put(1)\n}\n"
    recs = extract("Go", "p.go", text)
    assert {(r.qualified_name, r.name, r.signature) for r in recs if r.what == "field"} == {("p.S", "a", "int"), ("p.S", "b", "int"), ("p.S", "w", "*Writer")}
    assert {(r.qualified_name, r.name) for r in recs if r.what == "interface_method"} == {("p.R", "Read")}
    assert {(r.kind, r.name) for r in recs if r.what == "edge" and r.qualified_name == "p.S.Go"} == {("WRITES", "s.a"), ("READS", "limit"), ("READS", "cfg.Max"), ("CALLS", "s.w.Put")}
    assert [r.parent for r in recs if r.name == "Go"] == ["p.S"]


def test_long_files_take_linear_time():
    import time

    def took(n):
        text = "".join(f"function f{k}(a) {{ return g(a) + '{{'; }}\n" for k in range(n))
        t = time.perf_counter()
        assert len(extract("JavaScript", "x.js", text)) == 2 * n + 1
        return time.perf_counter() - t

    took(100)
    assert took(8000) < 12 * max(took(1000), 0.01)


def test_faulty_files_are_failures(spark):
    df = spark.createDataFrame([("p", "a.json", "{1"), ("p", "b.toml", "= 1"), ("p", "c.json", "{}")], "project_id string, file_path string, content string")
    rows = extract_files(df).collect()
    assert {r.file_path for r in rows if r.what == "failure"} == {"a.json", "b.toml"} and sum(r.kind == "Module" for r in rows) == 3


@pytest.mark.parametrize(
    "path,want",
    [("a/server_test.go", True), ("server.go", False), ("x.test.tsx", True), ("x.spec.js", True), ("x.test.cjs", True), ("x.spec.unrelated", False), ("test_x.py", True), ("x_test.py", True), ("tests/x.py", True), ("x_spec.rb", True), ("spec/x.rb", True), ("XTest.kt", True), ("XSpec.scala", True), ("X.java", False), ("src/test/X.java", True), ("src/featuretest/x.go", False), ("testdata/x.go", False), ("contest_winner.go", False), ("e2e/x.ts", True)],
)
def test_test_files(spark, path, want):
    assert spark.range(1).select(C.is_test_file(F.lit(path))).first()[0] is want


def test_equal_names_are_told_apart():
    names = [r.qualified_name for r in extract("Python", "p.py", "def f(): pass\ndef f(): pass\n")]
    assert names == ["p", "p.f", "p.f~2"]


def test_extract_files_with_nulls(spark):
    df = spark.createDataFrame([("p", "a.py", "def f(): pass", 1), ("p", "b.py", None, 1), (None, None, "x", 1)], "project_id string, file_path string, content string, kind int")
    assert extract_files(df).where("kind = 'Function'").count() == 1
    assert extract_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("path,first,want", [("a/Makefile", "", "Makefile"), ("x.PY", "", "Python"), ("bin/run", "#!/usr/bin/env python3", "Python"), ("run", "#!/bin/sh -e", "Bash"), ("run", "", "Unknown"), ("a.zzz", "#!/bin/sh", "Unknown")])
def test_detect(path, first, want):
    assert detect(path, first) == want


def test_walk(spark, tmp_path):
    rows = (("a.py", "x = 1"), ("node_modules/b.js", "1"), ("sub/c.MIN.js", "1"), ("sub/d.go", "package d"), ("go.sum", "x"), (".gitignore", "*.log\n/out/\n"), ("x.log", "1"), ("sub/out/e.py", "e = 1"), ("out/f.py", "1"), (".hidden/g.py", "1"), ("sub/.gitignore", "!keep.log\nd*.txt\n"), ("sub/keep.log", "k"), ("sub/data.txt", "1"), ("Cargo.lock", "1"), ("sub/__init__.py", ""))
    for name, text in rows:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    got = files.walk(spark, str(tmp_path), "p")
    assert {r.file_path: r.content for r in got.collect()} == {"a.py": "x = 1", "sub/d.go": "package d", "sub/out/e.py": "e = 1", "sub/keep.log": "k", "sub/__init__.py": ""}


def test_hunks(spark):
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,2 +3,4 @@ x\n+a\n@@ -9 +20,0 @@\n-b\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "diff_id int, value string")
    assert sorted(tuple(r) for r in files.hunks(df).collect()) == [(1, "f", 3, 6), (1, "f", 20, 20)]


def test_columns(spark):
    df = spark.createDataFrame([("v1.10.0",), ("v1.9.3",), ("dev",)], "v string")
    assert [r.v for r in df.orderBy(C.version_key(F.col("v")).desc()).collect()] == ["v1.10.0", "v1.9.3", "dev"]
    row = spark.range(1).select(C.slug(F.lit("Ab  c, d!")).alias("s"), C.staleness(F.lit(7300)).alias("a"), C.package_of(F.lit("a/b/c.go")).alias("p"), C.line_range_text(F.lit("aéb"), F.lit(1), F.lit(3)).alias("t"), C.is_test_file(F.lit("x/foo_test.go")).alias("f"), C.token_estimate(F.lit("abcde")).alias("k")).first()
    assert tuple(row) == ("ab-c-d", "2h", "b", "é", True, 2)


def _records(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _file(path, content, hash_, seen):
    return {"project_id": "p", "file_path": path, "content": content, "file_hash": hash_, "seen_at": seen}


def functions_of(spark, out):
    return {r.name for r in current(spark, out).where("kind = 'Function'").collect()}


def test_incremental_index(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    run = lambda: incremental_index(spark, src, out, cp).awaitTermination()
    _records(tmp_path / "in", "1.json", _file("a.py", "def f(): pass", "1", 1))
    run()
    _records(tmp_path / "in", "2.json", _file("a.py", "def f(): pass", "1", 2))
    _records(tmp_path / "in", "3.json", _file("b.py", "def g(): pass", "2", 2))
    run()
    _records(tmp_path / "in", "4.json", _file("b.py", "def h(): pass", "3", 3))
    run()
    assert functions_of(spark, out) == {"f", "h"}
    _records(tmp_path / "in", "5.json", _file("b.py", "def late(): pass", "4", 1), _file("a.py", None, None, 9))
    run()
    assert functions_of(spark, out) == {"h"}
    _records(tmp_path / "in", "6.json", _file("a.py", "def f(): pass", "1", 10))
    run()
    assert functions_of(spark, out) == {"f", "h"}
    assert spark.createDataFrame([], FILES).count() == 0


def test_the_last_record_of_a_file_counts(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    _records(tmp_path / "in", "1.json", _file("a.py", "def old(): pass", "h9", 1), _file("a.py", "def new(): pass", "h0", 2))
    incremental_index(spark, src, out, cp).awaitTermination()
    assert functions_of(spark, out) == {"new"}


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    for k, name in enumerate("fgh"):
        _records(tmp_path / "in", f"{k}.json", _file(f"{name}.py", f"def {name}(): pass", name, k))
        incremental_index(spark, src, out, cp).awaitTermination()
    before = sorted(map(str, current(spark, out).collect()))
    last = max(int(x.name) for x in (tmp_path / "cp" / "commits").iterdir() if x.name.isdigit())
    (tmp_path / "cp" / "commits" / str(last)).unlink()
    for x in (tmp_path / "cp" / "commits").glob(".*crc"):
        x.unlink()
    incremental_index(spark, src, out, cp).awaitTermination()
    assert sorted(map(str, current(spark, out).collect())) == before and functions_of(spark, out) == {"f", "g", "h"}


def test_tally_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "ts string, tool string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "c"))
    calls = spark.readStream.schema("ts timestamp, tool string, value double").parquet(str(tmp_path / "c"))
    q = tally_stream(calls).writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r)[1:] for r in spark.sql("select * from tally").collect()] == [("a", 2, 3.0)]


def test_pages(spark):
    import http.server
    import threading

    from graphmill.sources import pages

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path == "/a"
            self.send_response(200 if found else 404)
            self.end_headers()
            self.wfile.write(b"<title> Guide </title><script>x()</script><p>Read   this</p>" if found else b"no")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = pages.pages(spark.createDataFrame([(f"{at}/a",), (f"{at}/a",), (f"{at}/b",), ("file:///etc/hosts",), (None,)], "url string")).cache()
    assert {r.url: r.status for r in got.collect()} == {f"{at}/a": 200, f"{at}/b": 404, "file:///etc/hosts": None, None: None}
    (doc,) = pages.documents(got, "p").collect()
    assert doc.name == "Guide" and doc.docstring == "Guide Read this" and doc.kind == "Document"
    server.shutdown()


def test_ignore_rules():
    import re

    (rule,) = files.ignore_rules("# comment\n\n!src/**/*.p[yc]\n")
    assert rule[1] and re.search(rule[2], "src/a/b.py") and re.search(rule[2], "src/b.pyc".replace("pyc", "pc")) and not re.search(rule[2], "lib/src/a.py")


def test_dotted_paths_and_forms(spark):
    row = spark.range(1).select(C.dotted(F.array(F.lit("a"), F.lit("b.c"), F.lit(None))).alias("d"), C.compact(F.lit("abcdef\ng"), 4).alias("c"), C.compact(F.lit(None).cast("string"), 4).alias("n"), C.snippet(F.lit("x\n  Word y"), "word", 3).alias("s"))
    row = row.select("*", C.undotted(F.col("d")).alias("u")).first()
    assert row.d == "a.b\\.c" and row.u == ["a", "b.c"] and row.c == "abc…" and row.n is None and row.s == " Word y"
