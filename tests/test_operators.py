"""Traversal, keys, orphans, audits, logs, upkeep and resolution on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphmill.operators import audit, composite, orphans, ranges, resolve, search, skew, store, telemetry, traverse

E = "project_id string, from_id string, to_id string, kind string, confidence double"


def edges(spark, *pairs, kind="CALLS"):
    return spark.createDataFrame([("p", a, b, kind, 1.0) for a, b in pairs], E)


def starts(spark, *ids):
    return spark.createDataFrame([("p", i) for i in ids], "project_id string, start string")


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- traversal
def test_walks_may_pass_their_start(spark):
    e = edges(spark, ("s", "a"), ("s", "b"), ("b", "a"), ("a", "s"))
    assert got(traverse.walks(e, starts(spark, "s"), ["CALLS"], 2, 3), "id", "depth") == [("a", 2), ("b", 3)]


def test_closure_of_a_diamond(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("C", "D"), ("A", "C"))
    want = [("A", "B", 1), ("A", "C", 1), ("A", "D", 2), ("B", "C", 1), ("B", "D", 2), ("C", "D", 1)]
    assert got(traverse.closure(e, 3), "from_id", "to_id", "depth") == want
    assert traverse.closure(e.limit(0), 3).count() == 0


def test_cycles_and_self_edges_end(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("a", "a"))
    assert got(traverse.walks(e, starts(spark, "a"), ["CALLS"], 1, 5), "id", "depth") == [("b", 1)]
    assert got(traverse.closure(e, 8), "from_id", "to_id") == [("a", "b"), ("b", "a")]


def test_trace_directions_and_kinds(spark):
    e = edges(spark, ("a", "b"), ("b", "c")).union(edges(spark, ("a", "c"), kind="HTTP_CALLS"))
    assert got(traverse.trace(e, starts(spark, "a"), "out", None, 2), "id", "depth", "via") == [("b", 1, "CALLS"), ("c", 1, "CALLS")]
    assert got(traverse.trace(e, starts(spark, "b"), "both", None, 2), "id", "depth") == [("a", 1), ("c", 1)]
    with pytest.raises(ValueError):
        traverse.trace(e, starts(spark, "a"), "sideways")


def test_walks_equal_recursive_sql(spark):
    import random

    r = random.Random(3)
    e = edges(spark, *{(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(30)})
    e.createOrReplaceTempView("e_links")
    want = spark.sql("WITH RECURSIVE w AS (SELECT from_id AS s, to_id AS t, 1 AS d FROM e_links UNION ALL SELECT s, to_id, d + 1 FROM w JOIN e_links ON from_id = t WHERE d < 3) SELECT s, t, min(d) FROM w WHERE d >= 2 AND s <> t GROUP BY s, t")
    mine = traverse.walks(e, e.select("project_id", F.col("from_id").alias("start")), ["CALLS"], 2, 3)
    assert got(mine, "start", "id", "depth") == sorted(tuple(x) for x in want.collect())


def test_adaptive_depth(spark):
    e = edges(spark, *((f"c{k}", "t") for k in range(6)), ("x", "c0"), ("y", "u"), ("z", "y"))
    assert {r[0] for r in got(traverse.adaptive_depth(e, starts(spark, "t", "u")), "id")} == {f"c{k}" for k in range(6)} | {"y", "z"}


# ---- keys
def test_hot_keys_counts_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)] * 1 + [(None, 1)] * 94, "k string, table_name int")
    assert got(skew.hot_keys({"t": (df, "k")}), "table_name", "key_value") == [("t", "a")]
    assert skew.hot_keys({"t": (df.limit(0), "k")}).count() == 0


def test_hot_key_at_the_limit(spark):
    df = spark.createDataFrame([("a",)] * 2 + [(f"x{k}",) for k in range(98)], "k string")
    assert got(skew.hot_keys({"t": (df, "k")}), "key_value") == [("a",)]


def test_per_key(spark):
    df = spark.createDataFrame([("a", "u", 0.5), ("a", "u", 1.0), ("a", None, None), (None, "v", 2.0)], "k string, c string, v double")
    assert got(skew.per_key(df, "k", "c", "v"), "key_value", "n_rows", "n_callers", "mean_value") == [("a", 3, 1, 0.75)]


def test_keyed_join_is_whole_with_one_huge_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50))).alias("key"))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key <> 'k7'").withColumn("flag", F.lit(1))
    out = skew.keyed_join(rows, keys, ["key"], ("flag",), total=3000)
    assert out.count() == 2970 and out.where("flag = 1").count() == 2970
    assert skew.keyed_join(rows.limit(0), keys, ["key"], ("flag",)).count() == 0


# ---- orphans
def orphan_tables(spark):
    t = datetime(2024, 1, 31)
    s = spark.createDataFrame(
        [("p", "1", "f", "m.f", t, None), ("p", "2", "old", "m.old", t, None), ("p", "2", "old", "m.old", t + timedelta(1), t + timedelta(1)), ("q", "3", "g", "m.g", t, None), ("p", "4", None, None, t, None)],
        "project_id string, id string, name string, qualified_name string, indexed_at timestamp, deleted_at timestamp",
    )
    e = spark.createDataFrame(
        [
            (1, "p", "m.f", " `f()` ", t), (1, "p", "m.f", " `f()` ", t), (2, "p", "m.old", "len", t), (3, "p", "", None, t), (4, "p", "m.f", "g", t), (5, "q", "'m.g'", "F", t + timedelta(5)), (6, "z", "a", "len", None), (7, "p", "  ", "()", t), (8, "p", "len", "m.f", t),
        ],
        "edge_id long, project_id string, from_qn string, to_name string, seen_at timestamp",
    )
    return e, s, spark.createDataFrame([("len", "Python"), (None, "Go")], "ext_name string, language string")


def test_orphans(spark):
    found = orphans.orphan_edges(*orphan_tables(spark))
    assert got(found, "edge_id", "ref_field") == [(2, "from_qn"), (4, "to_name"), (5, "to_name"), (6, "from_qn"), (8, "from_qn")]


def test_orphan_counts(spark):
    rows = got(orphans.orphan_counts(*orphan_tables(spark)), "ref_field", "month", "n_orphans")
    assert sorted(rows, key=repr) == sorted([("from_qn", "2024-01", 2), ("to_name", "2024-01", 1), ("to_name", "2024-02", 1), ("from_qn", None, 1)], key=repr)


def test_orphans_of_nothing(spark):
    e, s, x = orphan_tables(spark)
    assert orphans.orphan_edges(e.limit(0), s, x).count() == 0
    assert orphans.orphan_edges(e, s.limit(0), x.limit(0)).count() == 12


# ---- audits
N = "project_id string, id string, name string, kind string, language string, file_path string, start_line int, end_line int, is_exported boolean, is_entry_point boolean, is_test boolean, extraction_confidence double, qualified_name string"


def nodes(spark, *rows):
    full = [("p", i, i, "Function", "Go", path, a, b, False, False, test, c, i) for i, path, a, b, test, c in rows]
    return spark.createDataFrame(full, N)


def test_dead_code_and_audit(spark):
    n = nodes(spark, ("a", "x/a.go", 1, 5, False, 0.4), ("b", "x/b.go", 1, 5, False, 0.95), ("init", "x/c.go", 1, 2, False, 1.0), ("t", "x/t_test.go", 1, 2, True, 0.8))
    e = edges(spark, ("t", "b"), ("b", "c"))
    assert got(audit.dead_code(n, e), "id") == [("a",)]
    assert audit.dead_code(n, e, interface_methods=spark.createDataFrame([("p", "a")], "project_id string, name string")).count() == 1
    assert got(audit.audit_unused(n, e, n.select("project_id", "id")), "id", "confidence") == [("a", "high"), ("b", "low"), ("init", "high"), ("t", "high")]
    assert got(audit.confidence_histogram(n), "bucket", "n") == sorted([("[.5,.7)", 0), ("[.7,.9)", 1), ("[.9,1]", 2), ("[0,.5)", 1)])


def test_changed_nodes_overlap_once(spark):
    n = nodes(spark, ("a", "f", 1, 500, False, 1.0), ("b", "f", 600, 610, False, 1.0), ("c", "g", 1, 9, False, 1.0))
    h = spark.createDataFrame([("p", "f", 100, 400), ("p", "f", 610, 700), ("p", "f", 5, 4)], "project_id string, file_path string, first int, last int")
    assert got(audit.changed_nodes(n, h), "id", "lines") == [("a", 301), ("b", 1)]


def test_symbol_moves_and_verify(spark):
    old = nodes(spark, ("a", "f", 1, 2, False, 1.0), ("b", "f", 3, 4, False, 1.0))
    new = old.withColumn("id", F.when(F.col("id") == "a", "z").otherwise(F.col("id")))
    assert got(audit.symbol_moves(old, new), "old_id", "new_id") == [("a", "z")]
    s = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "4")], "file_path string, hash string")
    f = spark.createDataFrame([("x", "1"), ("y", "3"), ("n", "5")], "file_path string, hash string")
    assert got(audit.verify_files(s, f), "file_path", "state") == [("n", "new"), ("w", "missing"), ("x", "in-sync"), ("y", "drifted")]


# ---- logs
def test_tallies_and_entropy(spark):
    t = datetime(2024, 1, 10)
    c = spark.createDataFrame([(k, "s", "search", "low", 10 * k, 5, 1000 * k, 90.0, t - timedelta(days=k)) for k in range(1, 10)], "call_id long, session_id string, tool string, complexity_tier string, response_bytes long, tokens_used long, tokens_saved long, tokens_saved_pct double, ts timestamp")
    assert telemetry.tool_tally(c, 7).first().calls == 8
    assert telemetry.tool_mix(c).first().entropy == 0.0
    empty = c.limit(0)
    assert telemetry.tool_tally(empty).count() == 0
    assert telemetry.session_sums(empty).first().calls == 0
    assert telemetry.tool_mix(empty).first().calls == 0


def test_next_calls(spark):
    t = datetime(2024, 1, 1)
    h = spark.createDataFrame([(1, "s", t), (2, "s", t + timedelta(seconds=2)), (3, "x", t)], "id long, session_id string, ts timestamp")
    c = spark.createDataFrame([(10 + k, "s", f"t{k}", t + timedelta(seconds=k)) for k in range(5)], "call_id long, session_id string, tool string, ts timestamp")
    assert got(telemetry.next_calls(h, c), "id", "position", "call_id") == [(1, 1, 11), (1, 2, 12), (1, 3, 13), (2, 1, 13), (2, 2, 14)]


def test_prometheus_escapes(spark):
    df = spark.createDataFrame([('a"b', 3)], "tool string, count long")
    assert telemetry.prometheus(df, "m", ["tool"], ["count"]).first().line == 'm_count{tool="a\\"b"} 3'


# ---- upkeep
def test_upserts(spark):
    a = spark.createDataFrame([("p", "1", "old"), ("p", "2", "same")], "project_id string, id string, name string")
    b = spark.createDataFrame([("p", "1", "new"), ("p", "3", None)], "project_id string, id string, name string")
    assert sorted(got(store.upsert_nodes(a, b), "id", "name"), key=repr) == sorted([("1", "new"), ("2", "same"), ("3", None)], key=repr)
    e = edges(spark, ("1", "2"))
    assert store.upsert_edges(e, edges(spark, ("1", "2"), ("2", "1"), ("2", "1")).withColumn("confidence", F.lit(0.1))).orderBy("from_id").select("confidence").collect() == [(1.0,), (0.1,)]


def test_cascade_stays_in_its_project(spark):
    n = nodes(spark, ("a", "f", 1, 2, False, 1.0), ("b", "g", 1, 2, False, 1.0))
    e = edges(spark, ("a", "b")).union(edges(spark, ("a", "b")).withColumn("project_id", F.lit("q")))
    kept, left = store.delete_files(n, e, spark.createDataFrame([("p", "f")], "project_id string, file_path string"))
    assert got(kept, "id") == [("b",)] and got(left, "project_id") == [("q",)]


def test_merge_projects_and_failures(spark):
    n = spark.createDataFrame([("w", "1", "x"), ("l", "1", "y"), ("l", "2", "z"), ("o", "1", "k")], "project_id string, id string, name string")
    assert got(store.merge_projects(n, ["project_id", "id"], "w", ["l"]), "project_id", "id", "name") == [("o", "1", "k"), ("w", "1", "x"), ("w", "2", "z")]
    f = spark.createDataFrame([("p", "f", "r", 1, 2, 1)], "project_id string, file_path string, reason string, first_seen int, last_seen int, times int")
    assert got(store.upsert_failures(f, f.withColumn("last_seen", F.lit(9))), "first_seen", "last_seen", "times") == [(1, 9, 2)]


# ---- search
def test_search(spark):
    d = spark.createDataFrame([(1, "red fox jumps"), (2, "red red dog"), (3, None), (4, "Fóx; under_score"), (5, ""), (6, "fox red"), (7, "ŻÓŁW fœtus")], "id int, text string")
    index = search.text_index(d)
    ids = lambda q, **k: [r.id for r in search.search(index, q, **k).collect()]
    assert set(ids("fox")) == {1, 4, 6} and ids("red NOT fox") == [2] and ids('"red fox"') == [1] and ids('"fox red"') == [6]
    assert set(ids("jum* OR dog")) == {1, 2} and ids("zoł*") == [7] and ids("żołw") == [7] and ids("zolw") == [] and ids("ŻÓŁW") == [7]
    assert ids("  ") == [] and ids("(fox OR dog) NOT (jumps OR score)") == [2, 6] or set(ids("(fox OR dog) NOT (jumps OR score)")) == {2, 6}
    assert search.search_with_fallback(index, "fox cow")[1] == "or" and search.search_with_fallback(index, "jum")[1] == "prefix" and search.search_with_fallback(index, "fox")[1] is None
    assert search.search(search.text_index(d.limit(0)), "fox").count() == 0
    assert search.search(search.open_index(spark, index.path), "dog").count() == 1
    with pytest.raises(search.SearchError):
        search.search(index, "fo.*")


def test_corpora_and_hints(spark):
    n = spark.createDataFrame([("p", "1", "run", "m.run", None, None, "Function", "Go", 1.0), ("p", "2", "run", "c.run", None, None, "Setting", "YAML", 1.0), ("q", "3", "Run it", "d", None, "how to run", "Document", "Markdown", 1.0)], "project_id string, id string, name string, qualified_name string, signature string, docstring string, kind string, language string, extraction_confidence double")
    index = search.node_index(n)
    assert {c: [r.id for r in search.search(index, "run", c).collect()] for c in search.CORPORA} == {"code": ["1"], "config": ["2"], "docs": ["3"]}
    assert search.search(index, '"run m"', "code").count() == 0, "no phrase spans two fields"
    assert got(search.exact_match_hint(n, " run ", ("Function",)), "id") == [("2",)]
    assert search.route_corpus("all")[0] == "code" and search.route_corpus("all")[1] and search.route_corpus(None) == ("code", None)
    with pytest.raises(search.SearchError):
        search.route_corpus("nothing")
    assert search.default_min_confidence("getUser") == 0.0 and search.default_min_confidence("get user") == 0.71 and search.default_min_confidence("x y", "docs") == 0.0


@pytest.mark.parametrize("raw,want", [("a b", "a b"), ("a-b", '"a-b"'), ("x AND y", "x AND y"), ("AND x", '"AND" x'), ("foo*", "foo*"), ("don't", "don t"), ("   ", ""), ("a.b/c", '"a.b/c"'), ('"p q"', '"p q"'), ("f()", '"f()"')])
def test_sanitize(raw, want):
    assert search.sanitize(raw) == want


# ---- resolution
NODES = "project_id string, id string, file_path string, name string, qualified_name string, kind string, language string, parent string"
REFS = "project_id string, from_file string, kind string, from_qn string, to_name string, confidence double, receiver_type string, base_type string"


def graph_nodes(spark, *rows):
    return spark.createDataFrame([("p", i, path, qn.rsplit(".", 1)[-1], qn, kind, lang, None) for i, path, qn, kind, lang in rows], NODES)


def refs(spark, *rows):
    return spark.createDataFrame([("p", f, k, a, b, c, r, t) for f, k, a, b, c, r, t in rows], REFS)


def test_resolution_order(spark):
    n = graph_nodes(spark, ("a", "f.go", "m.main", "Function", "Go"), ("b", "g.go", "m.run", "Function", "Go"), ("c", "testdata/g.go", "t.run", "Function", "Go"), ("d", "h.go", "m.T.Only", "Method", "Go"), ("e", "v.go", "m.cfg", "Variable", "Go"), ("s", "x.yml", "run", "Setting", "YAML"))
    p = refs(
        spark,
        *(("f.go", "CALLS", a, b, c, None, None) for a, b, c in (("m.main", "run", 0.5), ("m.main", "`run`", 0.9), ("m.main", "x.Only()", 0.7), ("m.main", "m.main", 1.0), ("m.main", "strings.Only", 1.0), ("m.main", "Only", 1.0), (None, "run", 0.5))),
        ("f.go", "READS", "m.main", "cfg", 0.6, None, None), ("f.go", "WRITES", "m.main", "cfg", 0.5, None, None), ("f.go", "READS", "m.main", "run", 0.6, None, None), ("other/f.go", "READS", "m.main", "cfg", 0.6, None, None), ("f.go", "IMPORTS", "m.main", "fmt", 1.0, None, None),
    )
    assert got(resolve.resolve_calls(p, n), "from_id", "to_id", "confidence", "way") == [("a", "b", 0.9, "2 bare name"), ("a", "d", 0.7, "5 only method")]
    assert got(resolve.resolve_reads(p, n), "to_id", "kind", "confidence", "source") == [("b", "CALLS", 0.4, "binding_pass"), ("e", "READS", 0.6, "resolve_pass"), ("e", "WRITES", 0.5, "resolve_pass")]
    e, made = resolve.resolve_imports(p, n)
    assert got(e, "to_id") == [("@external/fmt::fmt#Module",)] and made.count() == 1
    none = p.limit(0)
    assert resolve.resolve_calls(none, n).count() == 0 and resolve.resolve_reads(p, n.limit(0)).count() == 0


def test_calls_by_receiver_and_class(spark):
    n = graph_nodes(
        spark, ("go", "pkg/a.go", "pkg.Store.load", "Method", "Go"), ("go2", "pkg/b.go", "pkg.Log.load", "Method", "Go"), ("js", "w/c.js", "w.c.Cart", "Class", "JavaScript"), ("js1", "w/c.js", "w.c.Cart.add", "Method", "JavaScript"), ("js2", "w/d.js", "w.d.Bag.add", "Method", "JavaScript"),
        ("caller", "pkg/z.go", "pkg.Store.go", "Method", "Go"), ("web", "w/e.js", "w.e.main", "Function", "JavaScript"), ("close", "pkg/a.go", "pkg.Store.Close", "Method", "Go"),
    )
    p = refs(spark, ("pkg/z.go", "CALLS", "pkg.Store.go", "s.load", 1.0, "*Store", None), ("pkg/z.go", "CALLS", "pkg.Store.go", "s.log.load", 1.0, "*Store", None), ("w/e.js", "CALLS", "w.e.main", "this.add", 1.0, "Cart", None), ("pkg/z.go", "CALLS", "pkg.Store.go", "x.Close", 1.0, None, None), ("pkg/z.go", "CALLS", "pkg.Store.go", "strings.load", 1.0, "*Store", None))
    fields = spark.createDataFrame([("p", "pkg.Store", "log", "*Log")], "project_id string, struct_qn string, field_name string, field_type string")
    assert got(resolve.resolve_calls(p, n, fields), "from_id", "to_id", "way") == [("caller", "go", "3 receiver type"), ("caller", "go2", "3 receiver type"), ("web", "js1", "4 class member")]
    assert got(resolve.resolve_calls(p, n), "to_id") == [("go",), ("js1",)]


def test_reads_of_fields_and_other_languages(spark):
    n = graph_nodes(spark, ("r", "a/x.go", "a.reader", "Function", "Go"), ("f", "a/y.go", "a.Name", "Function", "Go"), ("v", "a/y.py", "a.total", "Variable", "Python"), ("s", "a/z.go", "a.String", "Method", "Go"))
    p = refs(spark, ("a/x.go", "READS", "a.reader", "Name", 1.0, None, "Rec"), ("a/x.go", "READS", "a.reader", "total", 1.0, None, None), ("a/x.go", "READS", "a.reader", "String", 1.0, None, None))
    fields = spark.createDataFrame([("p", "a.Rec", "Name", "string")], "project_id string, struct_qn string, field_name string, field_type string")
    assert got(resolve.resolve_reads(p, n), "to_id", "kind") == [("f", "CALLS")]
    assert resolve.resolve_reads(p, n, fields).count() == 0


def test_python_names(spark):
    n = graph_nodes(spark, ("m", "src/app/core/a.py", "src.app.core.a", "Module", "Python"), ("h", "src/app/util.py", "src.app.util.help", "Function", "Python"), ("x", "src/app/core/b.py", "src.app.core.b.go", "Function", "Python"))
    p = refs(spark, *(("src/app/core/a.py", "IMPORTS", "src.app.core.a", name, 1.0, None, None) for name in ("..util.help", ".b.go", "app.util.help", ".....far", "json")))
    e, made = resolve.resolve_imports(p, n)
    assert got(e, "from_id", "to_id") == [("m", "@external/json::json#Module"), ("m", "h"), ("m", "x")] and got(made, "name") == [("json",)]


def test_settings_and_modules_made_for_them(spark):
    n = graph_nodes(spark, ("v", "group_vars/all.yml", "group_vars.all.port", "Setting", "YAML"), ("w", "conf/app.yml", "conf.app.host", "Setting", "YAML"), ("t", "tasks/main.yml", "tasks.main", "Module", "YAML"))
    p = refs(spark, ("tasks/main.yml", "USES_VAR", "tasks.main", "port", 1.0, None, None), ("tasks/main.yml", "USES_VAR", "tasks.main", "host", 1.0, None, None), ("t/x.j2", "USES_VAR", None, "port", 1.0, None, None), ("conf/app.yml", "USES_VAR", "app", "port", 1.0, None, None))
    e, made = resolve.resolve_settings(p, n)
    assert got(e, "from_id", "to_id") == [("t", "v"), ("t/x.j2::x#Module", "v"), ("w", "v")] and got(made, "id") == [("t/x.j2::x#Module",)]


def test_scopes_and_moves(spark):
    n = graph_nodes(spark, ("a", "f.go", "m.a", "Function", "Go"), ("b", "g.go", "m.b", "Function", "Go"))
    e = edges(spark, ("a", "b"), ("b", "a")).withColumn("source", F.lit("resolve_pass"))
    files = spark.createDataFrame([("p", "f.go")], "project_id string, file_path string")
    assert got(resolve.replace_scoped(e, e.limit(0), n, ["CALLS"], files), "from_id") == [("b",)]
    assert resolve.replace_scoped(e, e.limit(0), n, ["CALLS"]).count() == 0
    moves = spark.createDataFrame([("p", "a", "z")], "project_id string, old_id string, new_id string")
    assert got(resolve.current_ids(n, moves), "old_id", "id") == [("a", "z"), ("b", "b")]


def test_platform_siblings(spark):
    cols = "project_id string, id string, file_path string, name string, qualified_name string, kind string, language string, parent string"
    n = spark.createDataFrame([("p", "l", "os/foo_linux.go", "open", "x", "Function", "Go", None), ("p", "w", "os/foo_windows.go", "open", "y", "Function", "Go", None)], cols)
    assert got(resolve.platform_siblings(edges(spark, ("a", "l")), n), "from_id", "to_id") == [("a", "w")]


# ---- composites
def test_suspects(spark):
    n = nodes(spark, ("pkg.load", "a.go", 1, 2, False, 1.0), ("save", "b.go", 1, 2, False, 1.0)).withColumn("name", F.substring_index("id", ".", -1))
    f = spark.createDataFrame([(1, "p", "panic: pkg.load failed\n\tat /x (b.go:3)\n\tsave()"), (2, "p", None), (3, "p", "panic: nil")], "failure_id int, project_id string, text string")
    changed = spark.createDataFrame([("p", "a.go")], "project_id string, file_path string")
    rows = got(composite.suspects(f, n, edges(spark, ("x", "save")), changed), "failure_id", "id", "score")
    assert rows == [(1, "pkg.load", 0.75), (1, "save", 0.6525)]


def test_context_and_plan(spark):
    n = nodes(spark, ("loader", "f", 1, 2, False, 1.0), ("caller", "g", 1, 2, False, 1.0), ("mate", "f", 3, 4, False, 1.0), ("far", "h", 1, 2, False, 1.0)).withColumn("signature", F.lit(None).cast("string")).withColumn("docstring", F.lit(None).cast("string"))
    index, e = search.node_index(n), edges(spark, ("caller", "loader"), ("far", "caller"))
    assert got(composite.context_for_task(n, e, index, "loader"), "id", "role") == [("caller", "caller"), ("loader", "seed"), ("mate", "sibling")]
    decisions = spark.createDataFrame([("d1", "why the Loader is slow"), ("d2", "other")], "key string, text string")
    rows, warnings = composite.plan_change(n, e, index, "loader", 4, decisions)
    assert got(rows, "role", "id", "depth") == [("decision", "d1", 0), ("direct", "caller", 1), ("indirect", "far", 2)] and warnings == []
    page, about = composite.pages(n, ["id"], 3, -1)
    assert page.count() == 3 and about["total"] == 4 and about["has_more"] and len(about["warnings"]) == 1


def test_committed_versions(spark, tmp_path):
    a = spark.createDataFrame([(1,)], "k int")
    for df in (a, a.union(a)):
        store.commit(df, str(tmp_path / "t"))
    assert store.committed(spark, str(tmp_path / "t")).count() == 2


def test_lookups_and_merges(spark):
    n = nodes(spark, ("a", "f", 1, 2, False, 1.0), ("b", "g", 1, 2, False, 1.0))
    want = spark.createDataFrame([("p", "a"), ("p", None), ("q", "b")], "project_id string, id string")
    assert got(store.lookup(n, want), "id") == [("a",)]
    assert got(store.edges_of(edges(spark, ("a", "b"), ("b", "a")), want), "from_id") == [("a",)]
    r = spark.createDataFrame([("x", "1", 1), ("y", "2", 2)], "key string, text string, extra int").drop("extra")
    assert got(store.put_record(store.put_record(r, "x", "9"), "y", None), "key", "text") == [("x", "9")]
    m = spark.createDataFrame([("l2", "1", "z"), ("l1", "1", "b"), ("l1", "1", "a")], "project_id string, id string, name string")
    assert got(store.merge_projects(m, ["project_id", "id"], "w", ["l1", "l2"]), "project_id", "id", "name") == [("w", "1", "a")]


def test_running_sum_over_many_ranges(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, 2).alias("v"))
    rows = ranges.running_sum(df, ["g"], ["k"], "v", "s", parts=9).collect()
    want: dict = {}
    for k in range(2000):
        g = "hot" if k % 10 < 8 else "b" if k % 10 == 8 else None
        want[g, k] = want.get(g, 0) + (2 if k % 7 else 0)
        want[g] = want[g, k]
    assert len(rows) == 2000 and all(r.s == want[r.g, r.k] for r in rows)
    assert ranges.running_sum(df.limit(0), ["g"], ["k"], "v", "s").count() == 0


def test_written_tables(spark):
    import os

    from graphmill import session

    df = session.written(spark.range(5).withColumn("x y", F.lit(None).cast("string")))
    folder = session.own_folder(spark)
    assert df.count() == 5 and df.columns == ["id", "x y"] and os.path.isdir(folder) and session.own_folder(spark) == folder
    assert session.written(df.limit(0)).count() == 0
