"""Searches over stored indexes of documents and of symbols, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import GRAPH_CTE, entity_graph
from ..functions import columns as C
from ..operators import composite, resolve, search
from ..session import table
from .register import Register
from .resolve_queries import IN_FORCE

_R = Register()
_OPEN: dict[tuple[str, str, str], search.Index] = {}


def _stored(spark: SparkSession, d: str, what: str, make) -> search.Index:
    """The index of a folder's tables; built at its first use by an application and kept."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _OPEN:
        _OPEN[key] = make()
    return _OPEN[key]


def _documents(spark: SparkSession, d: str) -> search.Index:
    return _stored(spark, d, "documents", lambda: search.text_index(table(spark, d, "documents").select("doc_id", "text"), key="doc_id"))


def _in_force(spark: SparkSession, d: str) -> DataFrame:
    return resolve.nodes_in_force(table(spark, d, "symbols"), "signature", "docstring", "extraction_confidence")


def _symbols(spark: SparkSession, d: str) -> search.Index:
    return _stored(spark, d, "symbols", lambda: search.node_index(_in_force(spark, d)))


_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BM25 = """WITH {ctes}t AS ({texts}), c AS (SELECT *, {counts} FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, {dfs} FROM c)
SELECT {keys}, round({score}, 6) AS score FROM c, s WHERE {where} ORDER BY score DESC, {keys} LIMIT 20"""
_DOC_TEXTS = f"SELECT doc_id AS id, {_TOKENS.format('text')} AS t, len({_TOKENS.format('text')}) AS n FROM documents"
_FIELDS = [_TOKENS.format(f) for f in search.FIELDS]
_CORPUS = "CASE WHEN kind = 'Document' OR language IN ('Markdown', 'HTML') THEN 'docs' WHEN language IN ('YAML', 'JSON', 'HCL', 'TOML', 'XML') THEN 'config' ELSE 'code' END"
_SYMBOL_TEXTS = f"SELECT project_id, id, kind, language, extraction_confidence, list_concat(list_concat(list_concat({_FIELDS[0]}, {_FIELDS[1]}), {_FIELDS[2]}), {_FIELDS[3]}) AS t, " + " + ".join(f"len({f})" for f in _FIELDS) + f" AS n FROM in_force WHERE {_CORPUS} = 'code'"


def _bm25(terms: list[str], where: str, scored: int = 9, symbols: bool = False) -> str:
    counts = ", ".join((t if t.startswith("len(") else f"len(list_filter(t, lambda x: {t}))") + f" AS f{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((docs - d{k} + 0.5) / (d{k} + 0.5)), 0.000001) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(min(scored, len(terms))))
    return _BM25.format(ctes=IN_FORCE + ", " if symbols else "", texts=_SYMBOL_TEXTS if symbols else _DOC_TEXTS, counts=counts, dfs=dfs, score=score, where=where, keys="project_id, id" if symbols else "id")


def _found(spark: SparkSession, d: str, q: str) -> DataFrame:
    return search.search(_documents(spark, d), q).select("id", "score")


@_R(_bm25(["x = 'graph'", "x = 'commit'"], "f0 > 0 AND f1 > 0"))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "graph commit")


@_R(_bm25(["x = 'schema'", "starts_with(x, 'reconc')"], "f0 > 0 OR f1 > 0"))
def bm25_or_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "schema OR reconc*")


@_R(_bm25(["x = 'symbol'", "x = 'module'"], "f0 > 0 AND NOT f1 > 0", 1))
def bm25_not(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "symbol NOT module")


@_R(_bm25(["len(list_filter(range(1, len(t)), lambda k: t[k] = 'each' AND t[k + 1] = 'schema'))", "x = 'index'"], "f0 > 0 OR (f0 > 0 AND f1 > 0)"))
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase, with a word in parentheses that only adds to the score."""
    return _found(spark, d, '"each schema" OR ("each schema" AND index)')


@_R(_bm25(["x = 'resultat'"], "f0 > 0"))
def bm25_accents(spark: SparkSession, d: str) -> DataFrame:
    """Words are found without their accents."""
    return _found(spark, d, "Résultat")


@_R(_bm25(["x = 'string'", "x = 'error'"], "f0 > 0 AND f1 > 0 AND kind = 'Function' AND extraction_confidence >= 0.71", symbols=True))
def search_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Functions by two words of their names, signatures or documentation, with the floor of confidence."""
    floor = search.default_min_confidence("string error")
    return search.search(_symbols(spark, d), "string error", "code", where=(F.col("kind") == "Function") & (F.col("extraction_confidence") >= floor))


@_R(_bm25(["starts_with(x, 'snaplea')"], "f0 > 0", symbols=True))
def search_fall_through(spark: SparkSession, d: str) -> DataFrame:
    """One word that nothing has is searched for as the beginning of words."""
    return search.search_with_fallback(_symbols(spark, d), "snapLea", "code")[0]


@_R(_bm25(["x = 'telemetry'", "x = 'nosuchword'"], "f0 > 0 OR f1 > 0", symbols=True))
def search_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Words that nothing has together are searched for apart."""
    return search.search_with_fallback(_symbols(spark, d), "telemetry nosuchword", "code")[0]


@_R(f"WITH {IN_FORCE} SELECT project_id, id, kind, language FROM in_force WHERE name = '__main__' AND kind NOT IN ('Function', 'Method')")
def exact_match_hints(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with exactly the name asked for that the filter by kind leaves out."""
    return search.exact_match_hint(_in_force(spark, d), "__main__", ("Function", "Method"))


@_R(f"WITH {IN_FORCE} SELECT corpus, count(*) AS docs, round(avg(n), 6) AS mean FROM (SELECT {_CORPUS} AS corpus, " + " + ".join(f"len({f})" for f in _FIELDS) + " AS n FROM in_force) GROUP BY corpus")
def index_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Texts and mean length of each corpus of the stored index."""
    return _symbols(spark, d).corpora.select("corpus", "docs", F.round("mean", 6).alias("mean"))


@_R(f"WITH t AS ({_DOC_TEXTS}) SELECT term, count(DISTINCT id) AS docs, count(*) AS total FROM (SELECT id, unnest(t) AS term FROM t) u GROUP BY term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of each term of the stored index."""
    return _documents(spark, d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("total"))


_QUERIES = ("graph commit", "schema", "symbol module", "cache")


@_R(" UNION ALL ".join("(SELECT '{0}' AS query, id FROM ({1}) LIMIT 1)".format(q, _bm25([f"x = '{w}'" for w in q.split()], " AND ".join(f"f{k} > 0" for k in range(len(q.split()))))) for q in _QUERIES))
def search_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each canned query."""
    out = None
    for q in _QUERIES:
        best = search.search(_documents(spark, d), q, limit=1).select(F.lit(q).alias("query"), "id")
        out = best if out is None else out.unionAll(best)
    return out


_ENTITY_TEXTS = "SELECT id, " + "list_concat(list_concat(list_concat({0}, {1}), {2}), {3}) AS t, ".format(*_FIELDS) + " + ".join(f"len({f})" for f in _FIELDS) + " AS n, kind FROM g_nodes"


@_R(
    f"""WITH RECURSIVE {GRAPH_CTE}, t AS ({_ENTITY_TEXTS}), c AS (SELECT *, len(list_filter(t, lambda x: x = 'nation')) AS f0, len(list_filter(t, lambda x: x = 'region')) AS f1, len(list_filter(t, lambda x: x = '1')) AS f2 FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM c),
    seeds AS (SELECT id FROM (SELECT id, round({" + ".join(f"greatest(ln((docs - d{k} + 0.5) / (d{k} + 0.5)), 0.000001) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(3))}, 6) AS score FROM c, s WHERE f0 > 0 AND f1 > 0 AND f2 > 0 AND kind IN ('Nation', 'Supplier', 'Region')) ORDER BY score DESC, id LIMIT 5),
    parts AS (SELECT id, 1 AS r, 0 AS depth FROM seeds UNION ALL SELECT from_id, 2, 1 FROM g_edges JOIN seeds ON to_id = id WHERE kind = 'CALLS' AND from_id <> to_id UNION ALL SELECT to_id, 3, 1 FROM g_edges JOIN seeds ON from_id = id WHERE kind = 'CALLS' AND from_id <> to_id UNION ALL SELECT n.id, 4, 0 FROM g_nodes n WHERE file_path IN (SELECT file_path FROM g_nodes WHERE id IN (SELECT id FROM seeds)))
    SELECT id, CASE min(r) WHEN 1 THEN 'seed' WHEN 2 THEN 'caller' WHEN 3 THEN 'callee' ELSE 'sibling' END AS role, arg_min(depth, (r, depth)) AS depth FROM parts GROUP BY id"""
)
def context_for_task(spark: SparkSession, d: str) -> DataFrame:
    """What the words of a task find among nations, suppliers and regions, with callers, callees and neighbours."""
    g = entity_graph(spark, d)
    index = _stored(spark, d, "entities", lambda: search.node_index(g.nodes))
    return composite.context_for_task(g.nodes, g.edges, index, "nation region 1", kinds=("Nation", "Supplier", "Region"))


@_R(
    f"""WITH RECURSIVE {GRAPH_CTE}, links AS (SELECT DISTINCT to_id AS a, from_id AS b FROM g_edges WHERE kind = 'CALLS'), target AS (SELECT id, name, file_path FROM g_nodes WHERE file_path = 'nation/2'),
    walk(start, id, depth) AS (SELECT a, b, 1 FROM links JOIN target ON a = target.id UNION SELECT start, l.b, depth + 1 FROM walk w JOIN links l ON l.a = w.id WHERE depth < 2),
    near AS (SELECT n.id, min(w.depth) AS depth, min(CASE WHEN split_part(n.file_path, '/', -2) <> split_part(t.file_path, '/', -2) THEN 1 ELSE 0 END) = 1 AS cross_package FROM (SELECT start, id, min(depth) AS depth FROM walk WHERE id <> start GROUP BY ALL) w JOIN g_nodes n ON n.id = w.id JOIN target t ON t.id = w.start GROUP BY n.id),
    rows AS (SELECT CASE WHEN is_test OR {C.TEST_SQL.format('file_path')} THEN 'test' WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS role, near.id, depth, cross_package FROM near JOIN g_nodes USING (id)
      UNION ALL SELECT 'decision', r_name, 0, false FROM region WHERE EXISTS (SELECT 1 FROM target WHERE length(name) >= 3 AND contains(lower(concat(r_name, ' keeps nation_5 and nation_7')), lower(name))))
    SELECT * FROM rows ORDER BY depth, role, id LIMIT 400"""
)
def plan_change(spark: SparkSession, d: str) -> DataFrame:
    """What a change of the nations of one file touches, with the decision records that name them."""
    g = entity_graph(spark, d)
    index = _stored(spark, d, "entities", lambda: search.node_index(g.nodes))
    decisions = table(spark, d, "region").select(F.col("r_name").alias("key"), F.concat("r_name", F.lit(" keeps nation_5 and nation_7")).alias("text"))
    return composite.plan_change(g.nodes, g.edges, index, "nation/2", 2, decisions, most=400)[0]


queries, oracle_sql = _R.queries, _R.oracle_sql
