"""Queries as DataFrames: scan, one-hop join or path, then one shape of result.

All rows take part: the result's limit is applied last, never to a scan.
Results that are cut are put in a total order first, so they are the same on
every run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...catalog import ALIASES, BOOLEANS, EDGE_KINDS, Graph
from ...functions.columns import is_fixture
from ...operators.predicates import condition
from ...operators.traverse import walks
from .parser import Cond, Item, Query, QueryError, Tree, _near, parse

DEFAULT_LIMIT, MOST_HOPS = 200, 10
EDGE_PROPS = ("kind", "confidence")


@dataclass
class QueryResult:
    """Rows with the diagnostics of their query."""

    df: DataFrame
    warnings: list[str] = field(default_factory=list)
    #: rows before the cut by max_rows, and how many it keeps; None where it can't cut
    uncut: tuple[DataFrame, int] | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def probe(self) -> list[str]:
        """The warnings, with one if max_rows has cut the result; this counts one row more than it keeps."""
        if self.uncut is not None and self.uncut[0].limit(self.uncut[1] + 1).count() > self.uncut[1]:
            self.warnings.append(f"only {self.uncut[1]} rows are returned; raise max_rows or add a LIMIT")
            self.uncut = None
        return self.warnings

    def to_json(self) -> dict:
        """Columns, rows, total and warnings of a result that has been limited."""
        rows = [list(r) for r in self.df.collect()]
        return {"columns": self.columns, "rows": rows, "total": len(rows), "warnings": self.probe()}


def _conds(tree) -> list[Cond]:
    if tree is None:
        return []
    if isinstance(tree, Cond):
        return [tree]
    return [c for p in tree.parts for c in _conds(p)]


def _and_chain(tree) -> list | None:
    """The parts of a tree that is one AND chain of conditions; None otherwise."""
    if tree is None:
        return []
    if isinstance(tree, Cond):
        return [tree]
    if tree.op != "AND":
        return None
    parts = [_and_chain(p) for p in tree.parts]
    return None if None in parts else [c for p in parts for c in p]


class _Compiler:
    def __init__(self, q: Query, g: Graph, max_rows: int | None, cross: bool, compat: bool):
        self.q, self.g, self.compat = q, g, compat
        self.max_rows = None if max_rows is None else max(0, max_rows)
        self.warnings = list(q.warnings)
        self.uncut: tuple[DataFrame, int] | None = None
        self.node_vars = [q.start.var] + ([q.end.var] if q.end and q.end.var != q.start.var else [])
        self.edge_var = q.edge.var if q.edge else None
        self.path = bool(q.edge and q.edge.path)
        self.nodes = g.nodes if cross or g.project is None else g.nodes.where(F.col("project_id") == g.project)
        self.edges = g.edges if cross or g.project is None else g.edges.where(F.col("project_id") == g.project)

    # ---- names
    def prop(self, name: str) -> str | None:
        name = ALIASES.get(name, name)
        return name if name in self.g.properties else None

    def column(self, var: str, name: str) -> Column | None:
        if var == self.edge_var:
            return F.col(f"{var}__{name}") if name in EDGE_PROPS and not self.path else None
        real = self.prop(name)
        return F.col(f"{var}__{real}") if var in self.node_vars and real else None

    def bound(self, nodes: DataFrame, var: str) -> DataFrame:
        """Nodes with the columns of one variable, filtered by its inline pattern."""
        n = self.q.start if var == self.q.start.var else self.q.end
        for pattern in (self.q.start, self.q.end):
            if pattern is None or pattern.var != n.var:
                continue
            if pattern.kind:
                nodes = nodes.where(F.col("kind") == pattern.kind)
            for k, v in pattern.props.items():
                real = self.prop(k)
                if real is None:
                    self.warnings.append(f"unknown property {k!r} in a pattern; it matches nothing")
                    nodes = nodes.where(F.lit(False))
                else:
                    nodes = nodes.where(condition(F.col(real), "=", v, boolean=real in BOOLEANS, numeric=real in self.g.numeric))
        return nodes.select(*(F.col(p).alias(f"{var}__{p}") for p in self.g.properties))

    # ---- conditions
    def where(self, tree, memory: bool) -> Column:
        if isinstance(tree, Tree):
            parts = [self.where(p, memory) for p in tree.parts]
            if tree.op == "NOT":
                return ~parts[0]
            return reduce(lambda a, b: a & b if tree.op == "AND" else a | b, parts)
        c: Cond = tree
        left = self.column(c.var, c.prop)
        if left is None:
            return F.lit(True)  # with a warning; see analyse()
        real = self.prop(c.prop) if c.var in self.node_vars else c.prop
        boolean, numeric = real in BOOLEANS, real in self.g.numeric or real == "confidence"
        if c.op == "COLUMN":
            op, var, name = c.value
            right = self.column(var, name)
            if self.compat or right is None:
                self.warnings.append("comparisons of two columns are ignored")
                return F.lit(True)
            out = {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}.get(op)
            if out is None:
                raise QueryError("=~ needs a literal pattern")
        else:
            out = condition(left, c.op, c.value, boolean=boolean, numeric=numeric, memory=memory)
        return F.coalesce(out, F.lit(False)) if memory else out

    def analyse(self) -> None:
        q, w = self.q, self.warnings
        known = {*self.node_vars, *([self.edge_var] if self.edge_var else [])}
        used = [(c.var, c.prop) for c in _conds(q.where)] + [(i.var, i.prop) for i in q.items if i.var != "*"]
        if isinstance(q.order, Item) and q.order.prop:
            used.append((q.order.var, q.order.prop))
        names = {i.name for i in q.items}
        for var, prop in dict.fromkeys(used):
            if var not in known:
                if not (prop is None and var in names):
                    w.append(f"unknown variable {var!r}; its conditions and values are ignored")
            elif prop is not None and self.column(var, prop) is None:
                w.append(f"unknown property {var}.{prop}; it is null" + (" on paths" if var == self.edge_var else ""))
        for k in q.edge.kinds if q.edge else []:
            if k not in EDGE_KINDS:
                w.append(f"edge kind {k!r} isn't recognised")
        if q.end and q.end.var == q.start.var:
            w.append("both ends are one variable: only edges of a node to itself match")
        for c in _conds(q.where):
            real = self.prop(c.prop) if c.var in self.node_vars else None
            if real in self.g.numeric and isinstance(c.value, str) and c.op in ("=", "<>", "<", ">", "<=", ">=") and not _number(c.value):
                w.append(f"{c.var}.{c.prop} is a number and is compared with text")
        aggregates = [i for i in q.items if i.function]
        for i in aggregates:
            real = self.prop(i.prop) if i.prop else None
            if real and i.function != "COUNT" and real not in self.g.numeric:
                w.append(f"{i.name} has no numbers to work on")
        if aggregates and any(not i.function and i.prop is None for i in q.items):
            w.append("a whole node beside an aggregate is one null group")
        if aggregates and isinstance(q.order, Item) and not q.order.function and q.order.plain not in {i.plain for i in q.items if not i.function} and q.order.plain not in names:
            w.append("ORDER BY names something that isn't in the grouped result")

    # ---- rows
    def rows(self) -> DataFrame:
        q = self.q
        if q.edge is None:
            out = self.bound(self.nodes, q.start.var)
            memory = False
        elif not self.path:
            out = self.hop()
            memory = False
        else:
            out = self.reach()
            memory = True
        return out.where(self.where(q.where, memory)) if q.where is not None else out

    def narrowed(self, var: str) -> tuple[DataFrame, bool]:
        """The nodes of a variable with its own conditions of an AND chain, which hold again later, and whether any narrow them."""
        nodes = self.bound(self.nodes, var)
        mine = [c for c in _and_chain(self.q.where) or [] if c.var == var and c.op != "COLUMN"]
        for c in mine:
            nodes = nodes.where(self.where(c, False))
        return nodes, bool(mine) or any(n is not None and n.var == var and (n.kind or n.props) for n in (self.q.start, self.q.end))

    def hop(self) -> DataFrame:
        q, a, b = self.q, self.q.start.var, self.q.end.var
        e = self.edges.select("project_id", "from_id", "to_id", "kind", "confidence")
        if q.edge.kinds:
            e = e.where(F.col("kind").isin(q.edge.kinds))
        ends = {"from_id": self.narrowed(a), "to_id": self.narrowed(b)} if a != b else {"from_id": self.narrowed(a)}
        if a == b:
            e = e.where("from_id = to_id")
        for (end, (nodes, narrow)), var in zip(ends.items(), (a, b)):
            if narrow:  # edges of other nodes don't take part
                e = e.join(nodes.select(F.col(f"{var}__project_id").alias("project_id"), F.col(f"{var}__id").alias(end)), ["project_id", end], "left_semi")
        # of several edges with the same ends and kind the surest one counts
        e = e.groupBy("project_id", "from_id", "to_id", "kind").agg(F.max("confidence").alias("confidence"))
        ev = self.edge_var or "_edge"
        out = e.select("project_id", "from_id", "to_id", F.col("kind").alias(f"{ev}__kind"), F.col("confidence").alias(f"{ev}__confidence"))
        for (end, (nodes, _)), var in zip(ends.items(), (a, b)):
            out = out.join(nodes, (out.project_id == nodes[f"{var}__project_id"]) & (out[end] == nodes[f"{var}__id"]))
        return out

    def reach(self) -> DataFrame:
        q, a, b = self.q, self.q.start.var, self.q.end.var
        chain = _and_chain(q.where)
        equal = lambda v: [c for c in chain or [] if c.var == v and c.op == "="]
        inward = bool(chain) and bool(equal(b)) and not equal(a) and a != b
        first = b if inward else a
        starts = self.bound(self.nodes, first)
        mine = [c for c in chain or [] if c.var == first]
        for c in mine:  # they hold again after the walk, so this only narrows
            starts = starts.where(self.where(c, True))
        high = min(q.edge.high, MOST_HOPS)
        if high < q.edge.high:
            self.warnings.append(f"paths have {MOST_HOPS} hops at most")
        found = walks(self.edges, starts.select(F.col(f"{first}__project_id").alias("project_id"), F.col(f"{first}__id").alias("start")), q.edge.kinds or ["CALLS"], min(q.edge.low, high), high, inward)
        ends = {first: "start", (a if inward else b): "id"}
        out = found
        for var, key in ends.items():
            n = self.bound(self.nodes, var)
            out = out.join(n, (out.project_id == n[f"{var}__project_id"]) & (out[key] == n[f"{var}__id"]))
        return out

    # ---- shape
    def value(self, i: Item) -> Column:
        if i.prop is None and i.var in self.node_vars:
            props = [p for p in self.g.properties]
            m = F.create_map(*[x for p in props for x in (F.lit(p), F.col(f"{i.var}__{p}").cast("string"))])
            return F.to_json(F.map_filter(m, lambda _, v: v.isNotNull()))
        c = self.column(i.var, i.prop) if i.prop else None
        return F.lit(None).cast("string") if c is None else c

    def aggregate(self, i: Item) -> Column:
        if i.var == "*" or i.prop is None:
            return F.count(F.lit(1))
        c = self.column(i.var, i.prop)
        if c is None:
            c = F.lit(None).cast("string")
        if i.function == "COUNT":
            return F.count_distinct(c.cast("string")) if i.distinct else F.count(c)
        number = F.lit(None).cast("double") if self.prop(i.prop) in BOOLEANS else c.try_cast("double")
        if i.function == "SUM":
            return F.coalesce(F.sum(number), F.lit(0.0))
        return {"AVG": F.avg, "MIN": F.min, "MAX": F.max}[i.function](number)

    def order_name(self) -> str | None:
        """The result column that ORDER BY names, if it names one."""
        o = self.q.order
        if not isinstance(o, Item):
            return None
        for i in self.q.items:
            if o.name == i.name or (o.prop is None and o.function is None and o.var == i.name) or (not o.function and o.plain == i.plain and not i.function):
                return i.name
        if o.function is None and o.prop is None and self.q.edge is None:
            same = [i.name for i in self.q.items if i.prop == o.var]
            return same[0] if same else None
        return None

    def order_column(self) -> Column | None:
        """The column of ORDER BY before the projection."""
        o = self.q.order
        if not isinstance(o, Item) or o.function:
            return None
        if o.prop is not None:
            return self.column(o.var, o.prop)
        return self.column(self.q.start.var, o.var) if self.q.edge is None else None

    def result(self) -> DataFrame:
        q = self.q
        self.analyse()
        rows = self.rows()
        limit = q.limit if q.limit is not None or self.max_rows is None else DEFAULT_LIMIT
        cut = limit if self.max_rows is None else min(limit, self.max_rows)
        first = lambda df, n: df if n is None else df.limit(n)
        name = self.order_name()
        sort = lambda c: c.desc_nulls_last() if q.descending else c.asc_nulls_first()
        if any(i.function for i in q.items):
            keys = [i for i in q.items if not i.function]
            aggregates = [self.aggregate(i).alias(i.name) for i in q.items if i.function]
            group = [(self.value(i) if i.prop is not None else F.lit(None).cast("string")).alias(i.name) for i in keys]
            extra = None
            if name is None and isinstance(q.order, Item) and q.order.function:
                extra = self.aggregate(q.order).alias("__order")
            out = (rows.groupBy(*group) if keys else rows).agg(*aggregates, *([extra] if extra is not None else []))
            by = [sort(F.col(f"`{name}`" if name else "__order"))] if name or extra is not None else []
            if q.order is not None and not by:
                self.warnings.append("ORDER BY has no such column; it is ignored")
            tie = [F.col(f"`{i.name}`").asc_nulls_first() for i in keys] + [F.col(f"`{i.name}`") for i in q.items if i.function]
            return first(out.orderBy(*by, *tie), limit).select(*(F.col(f"`{i.name}`") for i in q.items))
        before = self.order_column()
        if q.order is not None and name is None and before is None:
            self.warnings.append("ORDER BY has no such column; it is ignored")
        values = [self.value(i).alias(i.name) for i in q.items]
        if q.distinct:
            hidden = before if name is None and before is not None else F.lit(0)
            keyed = rows.select(*values, hidden.alias("__order"))
            out = keyed.groupBy(*(F.col(f"`{i.name}`") for i in q.items)).agg((F.max if q.descending else F.min)("__order").alias("__order"))
            by = [sort(F.col(f"`{name}`" if name else "__order"))]
            tie = [F.col(f"`{i.name}`").asc_nulls_first() for i in q.items]
            return self.cut(out.orderBy(*by, *tie), limit, cut).select(*(F.col(f"`{i.name}`") for i in q.items))
        ids = [F.col(f"{v}__{k}") for v in self.node_vars for k in ("project_id", "id")]
        if q.edge and not self.path:
            ids.append(F.col(f"{self.edge_var or '_edge'}__kind"))
        key = before if before is not None else self.value(next(i for i in q.items if i.name == name)) if name else F.lit(0)
        out = rows.select(*values, key.alias("__order"), *(c.alias(f"__tie{k}") for k, c in enumerate(ids)))
        return self.cut(out.orderBy(sort(F.col("__order")), *(F.col(f"__tie{k}") for k in range(len(ids)))), limit, cut).select(*(F.col(f"`{i.name}`") for i in q.items))

    def cut(self, rows: DataFrame, limit: int | None, most: int | None) -> DataFrame:
        """Rows up to the limit; where max_rows is less than it, the rows are kept for a warning."""
        if most is not None and (limit is None or most < limit or self.q.limit is None):
            self.uncut = (rows if self.q.limit is None else rows.limit(self.q.limit), most)
        return rows if most is None else rows.limit(most)


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def run(graph: Graph, text: str | Query, max_rows: int | None = DEFAULT_LIMIT, cross_project: bool = False, compat: bool = False, include_fixtures: bool = True, min_confidence: float | None = None) -> QueryResult:
    """A query over a graph.

    Lazy but for paths, whose levels are computed one by one.  ``max_rows`` cuts
    results without aggregates; with None only the query's own LIMIT cuts.  With
    ``compat`` comparisons of two columns are ignored with a warning, otherwise
    they are evaluated.  Fixture paths and low confidences are filtered where
    the result has the column, else a confidence floor gives a warning.  An
    empty graph gives no rows, or one row of a global aggregate.
    """
    if graph.project is None and not cross_project:
        raise QueryError("name a project, or ask for all projects")
    q = parse(text) if isinstance(text, str) else text
    c = _Compiler(q, graph, max_rows, cross_project, compat)
    df = c.result()
    plain = {ALIASES.get(i.prop, i.prop): i.name for i in q.items if i.prop and not i.function}
    if not include_fixtures and "file_path" in plain:
        df = df.where(~F.coalesce(is_fixture(F.col(f"`{plain['file_path']}`")), F.lit(False)))
    if min_confidence is not None:
        if "extraction_confidence" in plain:
            df = df.where(F.col(f"`{plain['extraction_confidence']}`") >= min_confidence)
        else:
            c.warnings.append("a confidence floor needs extraction_confidence in RETURN; it is ignored")
    return QueryResult(df, c.warnings, c.uncut)


def empty_hints(graph: Graph, text: str | Query) -> list[str]:
    """Why a query may have found nothing: kinds and languages that the graph doesn't have, with close spellings.

    Spellings with one letter's difference are counted where the nodes are, and the most frequent come to the driver.
    """
    q = parse(text) if isinstance(text, str) else text
    out = []
    kinds = {n.kind for n in (q.start, q.end) if n and n.kind} | {c.value for c in _conds(q.where) if ALIASES.get(c.prop, c.prop) == "kind" and c.op == "="}
    languages = {c.value for c in _conds(q.where) if c.prop == "language" and c.op == "="}
    for column, asked in (("kind", kinds), ("language", languages)):
        if not asked:
            continue
        for x in sorted(map(str, asked)):
            # only spellings close to the one asked for reach the driver
            close = F.levenshtein(F.lower(column), F.lit(x.lower())) <= 1
            known = [r[0] for r in graph.nodes.where((F.col(column) == x) | close).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(20).collect()]
            if x not in known:
                near = [k for k in known if k.lower() == x.lower() or _near(k.lower(), x.lower())]
                out.append(f"no node has {column} {x!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return out
