"""The pattern language on a graph of thirteen nodes, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphmill.catalog import EDGES, NODES, Graph
from graphmill.plans.pattern import QueryError, empty_hints, parse, run

#: A bakery in three languages: id, name, kind, language, exported, entry, test, complexity, docstring.
ROWS = [
    ("k1", "startShift", "Function", "Kotlin", False, True, False, 4, "begins the day"),
    ("k2", "BakeLoaf", "Function", "Kotlin", True, False, False, 6, "bakes"),
    ("k3", "weighFlour", "Function", "Kotlin", False, False, False, 1, None),
    ("k4", "Oven", "Class", "Kotlin", True, False, False, 0, "an oven"),
    ("k5", "heat", "Method", "Kotlin", True, False, False, 3, ""),
    ("k6", "cool", "Method", "Kotlin", False, False, False, 2, None),
    ("r1", "start_shift", "Function", "Ruby", False, True, False, 2, "begins"),
    ("r2", "weigh_flour", "Function", "Ruby", False, False, False, 1, ""),
    ("r3", "Recipe", "Class", "Ruby", True, False, False, 0, ""),
    ("t1", "bakesEvenly", "Function", "Kotlin", True, False, True, 7, ""),
    ("v1", "TEMPERATURE", "Constant", "Kotlin", True, False, False, 0, ""),
    ("v2", "stock", "Variable", "Ruby", False, False, False, 0, None),
    ("y1", "menu", "Setting", "YAML", False, False, False, 0, "daily menu"),
]
CALLS = [("k1", "k2"), ("k2", "k3"), ("k2", "k5"), ("k3", "k3"), ("k5", "k6"), ("r1", "r2"), ("t1", "k2")]
LINKS = [(a, b, "CALLS") for a, b in CALLS] + [("k5", "v1", "READS"), ("k6", "v1", "READS"), ("r1", "v2", "READS"), ("r2", "v2", "WRITES")]


def graph(spark, rows=ROWS, links=LINKS):
    full = []
    for id_, name, kind, lang, exported, entry, test, cx, doc in rows:
        v = dict.fromkeys(NODES.names)
        v |= dict(project_id="p", id=id_, file_path="shop/bread.kt", name=name, qualified_name=name, kind=kind, language=lang, start_line=1, end_line=20, is_exported=exported, is_entry_point=entry, is_test=test, complexity=cx, docstring=doc, extraction_confidence=1.0)
        full.append(tuple(v[n] for n in NODES.names))
    nodes = spark.createDataFrame(full, NODES)
    edges = spark.createDataFrame([("p", a, b, k, 1.0, None, "per_file", "") for a, b, k, *_ in links], EDGES)
    return Graph(nodes, edges, "p")


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark)


CASES = [
    ("MATCH (f:Function) RETURN COUNT(*)", [(6,)]),
    ("MATCH (f:Function) RETURN f.language, COUNT(*)", [("Kotlin", 4), ("Ruby", 2)]),
    ("MATCH (f:Function) RETURN SUM(f.complexity), AVG(f.complexity), MIN(f.complexity), MAX(f.complexity)", [(21.0, 3.5, 1.0, 7.0)]),
    ("MATCH (f:Function) WHERE f.complexity > 1 AND f.complexity < 7 RETURN f.id", [("k1",), ("k2",), ("r1",)]),
    ("MATCH (x) WHERE x.docstring IS NOT NULL RETURN x.id", [("k1",), ("k2",), ("k4",), ("r1",), ("y1",)]),
    ("MATCH (x) RETURN COUNT(x.docstring)", [(10,)]),
    ("MATCH (x) RETURN COUNT(DISTINCT x.language)", [(3,)]),
    ("MATCH (x) WHERE x.is_exported = true AND NOT (x.kind = 'Class' OR x.kind = 'Constant') RETURN x.name", [("BakeLoaf",), ("bakesEvenly",), ("heat",)]),
    ("MATCH (x) WHERE x.name CONTAINS 'FLOUR' RETURN x.id", [("k3",), ("r2",)]),
    ("MATCH (f:Function)-[:CALLS]->(m:Method) RETURN f.id, m.id", [("k2", "k5")]),
    ("MATCH (x)-[:CALLS]->(x) RETURN x.id", [("k3",)]),
    ("MATCH (x)-[r]->(y) RETURN r.kind, COUNT(*) AS k", [("CALLS", 7), ("READS", 3), ("WRITES", 1)]),
    ("MATCH (x)-[:READS|WRITES]->(y {name: 'stock'}) RETURN x.id", [("r1",), ("r2",)]),
    ("MATCH (x)-[:CALLS*1..2]->(y) WHERE x.id = 'k1' RETURN y.id", [("k2",), ("k3",), ("k5",)]),
    ("MATCH (x)-[:CALLS*1..2]->(y) WHERE y.id = 'k6' RETURN x.id", [("k2",), ("k5",)]),
    ("MATCH (x)-[:CALLS*2..3]->(y) WHERE x.id = 'k2' RETURN y.id", [("k3",), ("k6",)]),
    ("MATCH (x)-[*1..2]->(y) WHERE x.id = 'k6' RETURN y.id", []),
    ("MATCH (x) WHERE x.docstring = '' AND x.kind IN ['Method', 'Variable', 'Constant'] RETURN x.id", [("k5",), ("k6",), ("v1",), ("v2",)]),
    ("MATCH (x) WHERE NOT x.is_exported AND x.name STARTS WITH 'START' RETURN x.id", [("k1",), ("r1",)]),
    ("MATCH (x) WHERE x.name =~ '^[A-Z]+$' RETURN x.id", [("v1",)]),
    ("MATCH (x) RETURN DISTINCT x.language", [("Kotlin",), ("Ruby",), ("YAML",)]),
    ("MATCH (x {kind: 'Class'}) RETURN x.qn", [("Oven",), ("Recipe",)]),
    ("MATCH (x) RETURN x.id LIMIT 0", []),
    ("MATCH (f:Function) RETURN f.name AS who, f.complexity ORDER BY f.complexity DESC LIMIT 1", [("bakesEvenly", 7)]),
    ("MATCH (x) RETURN x.kind AS k, COUNT(*) AS n ORDER BY n DESC LIMIT 2", [("Class", 2), ("Function", 6)]),
    ("MATCH (x) RETURN MAX(x.is_exported) AS m, COUNT(x) AS n", [(None, 13)]),
    ("MATCH (x) WHERE x.id = 'v2' RETURN x", [('{"project_id":"p","id":"v2","file_path":"shop/bread.kt","name":"stock","qualified_name":"stock","kind":"Variable","language":"Ruby","start_line":"1","end_line":"20","complexity":"0","is_exported":"false","is_test":"false","is_entry_point":"false","extraction_confidence":"1.0"}',)]),
    ("MATCH (x) RETURN x, COUNT(*) AS n", [(None, 13)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_results(g, text, want):
    assert sorted(tuple(r) for r in run(g, text).df.collect()) == sorted(want)


def test_no_warnings(g):
    assert run(g, CASES[0][0]).warnings == []


@pytest.mark.parametrize(
    "text,part",
    [
        ("MATCH (n) RETURN n.nothing", "unknown property"),
        ("MATCH (n) WHERE m.x = 1 RETURN n.id", "unknown variable"),
        ("MATCH (a)-[:KNOWS]->(b) RETURN a.id", "isn't recognised"),
        ("MATCH (a)-[:CALLS*0..2]->(b) RETURN a.id", "one hop"),
        ("MATCH (a)-[:CALLS*3..1]->(b) RETURN a.id", "reversed"),
        ("MATCH (n) RETURN MAX(n.name)", "no numbers"),
        ("MATCH (n) RETURN n.id ORDER BY n.nope", "unknown property"),
        ("MATCH (a)-[:CALLS]->(a) RETURN a.id", "one variable"),
        ("MATCH (n) WHERE n.complexity = 'x' RETURN n.id", "compared with text"),
    ],
)
def test_warnings(g, text, part):
    assert any(part in w for w in run(g, text).warnings)


@pytest.mark.parametrize(
    "text",
    [
        "RETURN n", "MATCH (n)", "MATCH (n) MATCH (m) RETURN n", "MATCH (n) RETURN n.id SKIP 2", "MATCH (n) WHERE n.a != 1 RETURN n.id", "MATCH (n) WHERE n.a IN [] RETURN n.id", "MATCH (n) WHERE n.a IN (1) RETURN n.id", "MATCH (a)<-[:X]-(b) RETURN a.id",
        "MATCH (n) RETURN n.id ORDER BY n.a, n.b", "CREATE (n)", "MATCH (n) WHERE n.a =~ '[' RETURN n.id", "MATCH (n) WHERE n.a =~ 'a(?=b)' RETURN n.id", "MATCH (n) RETURN lower(n.id)", "MATCH (n) RETURN 1", "MATCH (n) WHERE n.a > -1 RETURN n.id", "MATCH (n) RETURN n.id LIMIT x", "MATCH (a)-[:X]->(b)-[:Y]->(c) RETURN a.id", "MTCH (n) RETURN n.id", "MATCH (n) RETURN n.id WHERE n.a = 1",
    ],
)
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def test_hint():
    with pytest.raises(QueryError, match="did you mean MATCH"):
        parse("MTCH (n) RETURN n.id")


def test_alias_of_keyword_kind(spark):
    assert parse("MATCH (n:Order) RETURN n.limit").start.kind == "Order"


def test_inverted_equals_forward(g):
    back = run(g, "MATCH (a)-[:CALLS*1..3]->(b) WHERE b.id = 'k6' RETURN a.id").df.collect()
    forth = run(g, "MATCH (a)-[:CALLS*1..3]->(b) RETURN a.id, b.id", max_rows=1000).df.where(F.col("`b.id`") == "k6").collect()
    assert sorted(r[0] for r in back) == sorted(r[0] for r in forth)


def test_paths_compare_case_sensitively(g):
    assert run(g, "MATCH (a)-[:CALLS*1..2]->(b) WHERE b.name CONTAINS 'COOL' RETURN b.id").df.count() == 0
    assert run(g, "MATCH (a)-[:CALLS]->(b) WHERE b.name CONTAINS 'COOL' RETURN b.id").df.count() == 1


def test_column_comparison_and_compat(g):
    q = "MATCH (n) WHERE n.name = n.qualified_name RETURN COUNT(*) AS k"
    assert run(g, q).df.first().k == 13
    r = run(g, "MATCH (n) WHERE n.name = n.kind RETURN COUNT(*) AS k", compat=True)
    assert r.df.first().k == 13 and r.warnings


def test_surest_of_equal_edges(spark):
    g = graph(spark)
    more = spark.createDataFrame([("p", "k1", "k2", "CALLS", 0.3, None, "x", "")], EDGES)
    rows = run(Graph(g.nodes, g.edges.union(more), "p"), "MATCH (a)-[r:CALLS]->(b) WHERE b.id = 'k2' AND a.id = 'k1' RETURN r.confidence").df.collect()
    assert [r[0] for r in rows] == [1.0]


def test_empty_graph(spark):
    e = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), "p")
    assert run(e, "MATCH (n) RETURN n.id").df.count() == 0
    assert run(e, "MATCH (n) RETURN COUNT(*) AS k").df.first().k == 0
    assert run(e, "MATCH (a)-[:CALLS*1..3]->(b) RETURN a.id").df.count() == 0


def test_projects_apart(spark):
    g = graph(spark)
    other = g.nodes.withColumn("project_id", F.lit("q"))
    both = Graph(g.nodes.union(other), g.edges.union(g.edges.withColumn("project_id", F.lit("q")).limit(1)), "p")
    assert run(both, "MATCH (a)-[:CALLS]->(b) RETURN COUNT(*) AS k").df.first().k == 7
    assert run(both, "MATCH (n) RETURN COUNT(*) AS k", cross_project=True).df.first().k == 26
    with pytest.raises(QueryError):
        run(Graph(g.nodes, g.edges), "MATCH (n) RETURN n.id")


def test_all_rows_unless_cut_on_request(spark):
    n = spark.range(10_050).select(*(F.lit("t").alias(f.name) if f.name == "project_id" else F.col("id").cast("string").alias("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in NODES))
    g = Graph(n, spark.createDataFrame([], EDGES), project="t")
    assert run(g, "MATCH (n) RETURN n.id", max_rows=None).df.count() == 10_050
    assert run(g, "MATCH (n) RETURN n.id LIMIT 10040", max_rows=20_000).df.count() == 10_040
    assert run(g, "MATCH (n) RETURN DISTINCT n.id", max_rows=None).df.count() == 10_050
    assert run(g, "MATCH (n) RETURN n.id, COUNT(*) AS k", max_rows=None).df.count() == 10_050
    assert run(g, "MATCH (n) RETURN n.id LIMIT 7", max_rows=None).df.count() == 7
    assert run(g, "MATCH (n) RETURN n.id").df.count() == 200


def test_a_cut_result_says_so(g):
    r = run(g, "MATCH (n) RETURN n.id", max_rows=4)
    assert r.to_json()["total"] == 4 and any("only 4 rows" in w for w in r.probe())
    assert run(g, "MATCH (n) RETURN n.id", max_rows=13).probe() == [] and run(g, "MATCH (n) RETURN n.id LIMIT 3", max_rows=4).probe() == []
    assert run(g, "MATCH (n) RETURN COUNT(*) AS k", max_rows=1).probe() == []


def test_hints_and_filters(g):
    assert empty_hints(g, "MATCH (n:function) WHERE n.language = 'Rubi' RETURN n.id") == ["no node has kind 'function'; did you mean 'Function'?", "no node has language 'Rubi'; did you mean 'Ruby'?"]
    assert run(g, "MATCH (n) RETURN n.id, n.file_path", include_fixtures=False).df.count() == 13
    assert run(g, "MATCH (n) RETURN n.id", min_confidence=0.5).warnings
    assert run(g, "MATCH (n) RETURN n.id, n.confidence", min_confidence=1.5).df.count() == 0
