"""Grammars against the languages' own parsers, and the operators around them."""

import json
import random
import warnings

import pytest

from graphmill.llm import invalid, pairs, syntax
from graphmill.llm.doclex import functions

PYTHON = """
import os, sys as s
from . import (a, b as c,)
@dec(1)[0]
async def f(a, /, b: int = 2, *args, c, **kw) -> list[int]:
    async with x as y, z: pass
    return [i async for i in y if i] + {**kw}["k"], f"{a!r:>{b}} {c=} {{}} {d['x']}"
class A[T](B, metaclass=M):
    x: int = 1
    def g(self): return lambda x, *y: (yield)
try:
    x = y = (1, *z)
except* E as e:
    raise V from None
else: pass
finally:
    del x[0], y.z
match p:
    case [1, -2.5, "s", *rest] | {"k": v, **o} if v: ...
    case A(x=1) as q: pass
    case _: pass
print(*a, sep='', **k); x @= 1; x[1:2, ::3] = not a in b is not c
if (n := 10) > 5: pass
elif a if b else c: pass
type X[T] = list[T]
"""
GO = """package p
import ("fmt"; m "x/y")
type S[T any] struct { a, b int `json:"x"`; *E; F[int] }
type I interface { M(x int) (y string, err error); ~int | string }
const ( A = iota; B )
var x, y = 1, map[string][]int{"a": {1, 2}, "b": nil}
func (s *S[T]) F(a ...int) (r int, err error) {
	for i := range a { if v, ok := m[i]; ok && v > 1 { continue } else if x { break } }
	switch t := v.(type) { case int, string: return 1, nil; default: }
	select { case x := <-c: _ = x; case c <- 1: }
L:
	for ;; { goto L }
	defer func() { recover() }()
	if (x == T{1}) { return }
	a[1], b.c = <-d, []byte("x")
	var f func(int) string = nil
	go f(1)
	return len(a[1:2:3]), &T{A: 1, B: []int{1,
	}}
}
"""
JS = """'use strict'
import d, {x as y, default as z} from 'm'
export default class extends B { static #p = 1; get a() { return this.#p } async *g() { yield* x; await y } static { f() } [k] = 2; 'm'() {} }
export const {a, b: [c, ...d2], ...e} = f`t${x}u`, g = async (p = 1, {q}) => ({...p}), h = x => x / 2 / 3
for await (const v of w) if (v) continue; else break
for (let i = 0, n = 1; i < n; i++) ;
label: while (a?.b?.[c]?.(d) ?? e) { do x++; while (y) }
switch (x) { case 1: default: y }
try { throw new Error } catch { } finally { }
var r = /[/\\]]+/gi.test(s), t = a ? b : c => d, o = {get x() { return 1 }, set x(v) {}, async f() {}, *g() {}, [k]: 1, if: 2, s}
;[a, b] = [b, a], {a: o.x} = o
if (a) b
else c
new.target
"""


def ok(kind, text):
    return syntax.check(kind, text)[0]


@pytest.mark.parametrize("kind,text", [("python", PYTHON), ("go", GO), ("mjs", JS.replace("new.target", "")), ("json", '{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}'), ("python", ""), ("python", "# c"), ("js", ""), ("json", " [] "), ("js", "#!/usr/bin/env node\nreturn_ = 1"), ("go", "package p")])
def test_valid(kind, text):
    v = syntax.check(kind, text)
    assert v[0], (v, text[v[1] - 40 : v[1] + 20])


BAD = [
    ("python", "def f(:\n  pass"), ("python", "x = "), ("python", "if x:\n"), ("python", "  x = 1"), ("python", "print 'a'"), ("python", "def f():\nreturn 1"), ("python", "x = (1,\n"), ("python", "a = 'x"), ("python", "else:\n  pass"), ("python", "f() = 1"), ("python", "def f(a=1, b): pass"), ("python", "x = 1abc"), ("python", "f'{a b}'"), ("python", "<<<<<<< HEAD\nx = 1\n=======\n"), ("python", "if x:\n    a\n  b"), ("python", "a = 01"), ("python", "x\0"), ("python", "try:\n  x\n"),
    ("go", ""), ("go", "package p\nfunc f() {\n"), ("go", "package p\nx := 1\n"), ("go", "package p\nfunc f() { if x == T{1} { } }\n"), ("go", "package p\nvar x = []int{1\n}\n"), ("go", "package p\nfunc f() { a b }\n"), ("go", "package p\nvar s = 'ab'\n"),
    ("js", "function (a) {}"), ("js", "let x = ;"), ("js", "if (x {"), ("js", "return 1"), ("cjs", "import a from 'b'"), ("mjs", "with (a) { b c }"), ("js", "a b"), ("js", "const x"), ("js", "f() = 1"), ("js", "`a${b c}`"), ("js", "class A { x y }"), ("js", "var s = 'a\nb'"), ("js", "interface A { x: number }"), ("js", "let x: number = 1"),
    ("json", ""), ("json", "{'a': 1}"), ("json", "[1,]"), ("json", "NaN"), ("json", '{"a": 01}'), ("json", "[1] 2"), ("json", '"\\x"'), ("json", "// c\n1"),
]


@pytest.mark.parametrize("kind,text", BAD)
def test_invalid(kind, text):
    valid, at, cause = syntax.check(kind, text)
    assert not valid and 0 <= at <= len(text) and cause


def test_furthest_failure_and_cause():
    assert syntax.line_of("a = 1\nb = (2\nc = )\n", syntax.check("python", "a = 1\nb = [2\nc = )\n")[1]) == 3
    v = syntax.check("go", "package p\n\nfunc f() {\n\tx := 1\n\ty = = 2\n}\n")
    assert v[1] == 35 and v[2] == "unexpected token"
    assert syntax.check("js", "a();\n<<<<<<< ours\nb();\n=======\nc();\n>>>>>>> theirs\n")[2] == "merge conflict"
    assert syntax.check("json", '{"a": [1, 2')[2] == "unclosed bracket"


def _truth(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "f", "exec", dont_inherit=True, flags=0x400)
        return True
    except (SyntaxError, ValueError):
        return False


def test_python_mutations_agree_with_the_interpreter():
    """Random deletions, swaps and insertions of tokens."""
    r = random.Random(5)
    rows = [x for x in PYTHON.split("\n")]
    wrong = []
    for _ in range(400):
        text = list("\n".join(rows))
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(text))
            op = r.random()
            if op < 0.5:
                del text[k : k + r.randrange(1, 4)]
            else:
                text[k:k] = r.choice(["(", ")", ":", ",", "=", " ", "x ", "\n", "'", "*", "if "])
        t = "".join(text)
        if _truth(t) != ok("python", t):
            wrong.append(t)
    # early errors beyond the grammar are left to the compiler
    assert len(wrong) <= 12


def test_json_mutations_agree():
    r = random.Random(6)
    base = '{"a": [1, -2.5e3, true, null, "\\u00e9", {"b": "c"}], "d": {}}'
    for _ in range(1500):
        t = list(base)
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(t))
            t[k : k + r.randrange(0, 2)] = r.choice(["", ",", "]", "1", '"', "{", " ", "0", "e", "-"])
        t = "".join(t)
        try:
            json.loads(t, parse_constant=lambda _: 1 / 0)
            want = True
        except (ValueError, ZeroDivisionError):
            want = False
        assert ok("json", t) == want, t


def test_brackets_of_any_depth(spark):
    deep = "[" * 50_000 + "]" * 50_000
    assert ok("json", deep) and not ok("json", deep[:-1]) and not ok("json", "[" * 50_000 + "x" + "]" * 50_000)
    assert ok("go", "package p\nvar x = " + "(" * 5000 + "1" + ")" * 5000 + "\n") and ok("js", "x = " + "[{a:(" * 500 + "1" + ")}]" * 500)
    assert ok("python", "x = " + "(" * 200 + "1" + ")" * 200) and not ok("python", "x = " + "(" * 201 + "1" + ")" * 201)
    df = spark.createDataFrame([(1, "p", "deep.json", deep)], "file_id long, project_id string, file_path string, content string")
    assert invalid.syntax_flags(df).first().valid is True


def test_very_deep_and_long_texts():
    assert ok("json", "[" * 3000 + "]" * 3000)
    assert not ok("json", "[" * 3000 + "]" * 2999)
    assert ok("python", "x = 1\n" * 50_000)
    assert ok("js", "f(1);\n" * 20_000)


@pytest.mark.parametrize("path,text,want", [("a.PY", "", "python"), ("a.cjs", "", "cjs"), ("bin/x", "#!/usr/bin/env python3\n", "python"), ("bin/x", "x", None), ("a.b/c", "#!/usr/bin/node", "js"), (None, "", None), ("x.txt", "", None)])
def test_kind_of(path, text, want):
    assert syntax.kind_of(path, text) == want


FILES = "file_id long, project_id string, file_path string, content string, language string, extra int"


def test_operator_cases(spark):
    df = spark.createDataFrame([(1, "p", "a.py", "x = (", "Go", 1), (1, "p", "a.py", "x = (", "Go", 1), (2, "p", "b.py", "", None, 1), (3, "p", "c.py", None, None, 1), (4, None, "d.json", "", None, 1), (5, "p", "e.txt", "(((", None, 1), (6, "p", None, "#!/bin/sh", None, 1)], FILES)
    assert sorted(r.file_id for r in invalid.invalid_files(df).collect()) == [1, 4]
    flags = {r.file_id: r.valid for r in invalid.syntax_flags(df).collect()}
    assert flags == {1: False, 2: True, 3: None, 4: False, 5: None, 6: None}
    assert invalid.invalid_files(df.limit(0)).count() == 0


def test_rates(spark, data):
    from graphmill.llm import queries

    rows = queries.p3_rates(spark, data).collect()
    assert sum(r.files for r in rows) == 60 and all(r.invalid_files <= r.files for r in rows)
    assert {r.language for r in rows} <= {"Python", "Go", "JavaScript", "JSON"}


# ---- documentation
PY = '''
# Sorts by size first.
@dec
def a(x):
    pass

def b(x):
    """b"""
# A comment set apart.

def c(x): pass
class K:
    # return self.x(y)
    def d(self, x):
        r"""Drops what is stale."""
    async def e(self):
        "TODO"
        s = """
def no(): pass
"""
'''


def test_python_functions():
    got = {f.name: f.docs for f in functions("python", PY)}
    assert list(got) == ["a", "b", "c", "d", "e"]
    assert got["a"] == ("Sorts by size first.",) and got["c"] == () and got["d"] == ("Drops what is stale.", "return self.x(y)")
    assert {f.name for f, _ in pairs.documented("x.py", PY)} == {"a", "d"}


def test_braces():
    js = "/** Keeps the newest. */\nexport const f = (a) => {\n  const s = '} function no() {';\n};\nclass A {\n  // Never blocks.\n  async g(x) { if (x) { y(); } }\n}\n// far\n\nfunction h() {}\n"
    got = {f.name: (js[f.start : f.end], f.docs) for f in functions("js", js) if f.docs}
    assert got["f"][0].endswith("};") and got["g"][1] == ("Never blocks.",) and "h" not in got
    go = "package p\n\n// F walks the tree twice.\n//\n//go:noinline\nfunc (s *S) F(a int) int {\n\treturn '{'\n}\n"
    (f,) = functions("go", go)
    assert go[f.start : f.end].endswith("}") and f.line == 6


@pytest.mark.parametrize(
    "doc,name,params,comment,want",
    [
        ("Returns the last value seen, or none.", "get", (), False, True), ("Get the value.", "get_value", (), False, False), ("getValue(x)", "getValue", ("x",), True, False), ("TODO", "f", (), False, False), ("N/A", "f", (), False, False), ("-----", "f", (), False, False), ("", "f", (), False, False),
        ("@param x\n@returns {*}", "f", ("x",), True, False), ("Args:\n    x:", "f", ("x",), False, False), ("return cache.get(k)", "f", (), True, False), ("eslint-disable-next-line no-console", "f", (), True, False), ("Auto-generated method stub", "f", (), False, False), ("Écrit le bloc puis ferme.", "f", (), False, True), ("f: safe to call twice.", "f", (), False, True), ("TODO: later\nBlocks until free.", "f", (), False, True),
    ],
)
def test_describes(doc, name, params, comment, want):
    assert pairs.describes(doc, name, params, comment, "python") is want


def test_pairs(spark):
    f = spark.createDataFrame([(1, "p", "a.py", PY, None, 1), (2, "p", "b.py", "def (", None, 1), (3, "p", "c.py", None, None, 1)], FILES)
    s = spark.createDataFrame([("p", "1", "a.py", "a", "m.a", "Function", "def a(x)", 4, 1, None), ("p", "2", "a.py", "d", "m.K.d", "Method", None, 13, 1, None), ("p", "2", "a.py", "d", "m.K.d", "Method", None, 13, 2, 3)], "project_id string, id string, file_path string, name string, qualified_name string, kind string, signature string, start_line int, indexed_at int, deleted_at int")
    assert [tuple(r) for r in pairs.code_pairs(f, s, code=False).collect()] == [(1, "m.a")]
    row = pairs.code_pairs(f, s).first()
    assert row.code.startswith("def a(x)") and row.documentation == "Sorts by size first."
    assert pairs.code_pairs(f.limit(0), s).count() == 0


def test_pairs_of_equal_names(spark):
    f = spark.createDataFrame([(1, "p", "a.py", "# Reads the file whole.\ndef a(): pass\n# Writes the rows back.\ndef a(): pass\n", None, 1)] * 2, FILES)
    s = spark.createDataFrame([("p", str(n), "a.py", "a", "m.a", "Function", "def a()", n, 1, None) for n in (2, 4)], "project_id string, id string, file_path string, name string, qualified_name string, kind string, signature string, start_line int, indexed_at int, deleted_at int")
    assert sorted((r.start_line, r.documentation) for r in pairs.code_pairs(f, s).collect()) == [(2, "Reads the file whole."), (4, "Writes the rows back.")]
    assert pairs.code_pairs(f, s, code=False).count() == 1


@pytest.mark.parametrize("lines", [3, 39, 40, 200])
def test_comment_above_a_long_decorator(lines):
    rows = "".join(f"    ('@a{k}', [{k}]),\n" for k in range(lines))
    text = f"import pytest\n\n# Says which rows are kept.\n@other\n@pytest.mark.parametrize('x,y', [\n{rows}])\ndef kept(x, y):\n    return x\n"
    (found,) = functions("python", text)
    assert found.docs and "Says which rows are kept" in found.docs[0]
