"""Functions paired with the documentation written for them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import map_rows
from . import syntax
from .doclex import Found, functions

#: Words of sentences that stand for documentation still to be written.
PLACEHOLDER = frozenset(
    "todo fixme xxx tbd tba wip hack doc docs docstring documentation documented undocumented description descriptions desc placeholder missing pending none n na nil null empty blank stub stubs auto autogenerated generated automatically method function func summary comment comments text "
    "no not yet provided available given written done add write insert fill put go goes here in me this later soon to be see above below same as self explanatory obvious ditto etc and the a an is it please nothing something say needed required document describe explain lorem ipsum".split()
)
#: Words that add nothing to a name.
FILLER = frozenset("a an the this that these it its is are of for to from in on with and or by as at function functions method methods func procedure routine helper constructor return returns returned perform performs do does will".split())
#: Marks of tools at the start of a comment line.
DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint|jshint|jslint|tslint|jscs|istanbul|c8 ignore|v8 ignore|prettier|@ts-|ts-(?:ignore|nocheck|expect)|@flow|@jsx|pylint|flake8|noqa|type:\s*ignore|mypy|pyright|pyre-|fmt:\s*(?:on|off|skip)|yapf|isort|black:|ruff|bandit|nosec|pragma|nolint|lint:|go:\w|\+build|export \w+$|line \S+:\d|-\*-|vim?:|coding[:=]|sourcemappingurl|nosonar|cspell|codespell|spell-?check|biome|deno-|webpack\w*:|region\b|endregion\b|#region|#endregion|jscpd|codacy|sonar|coverage:|pytype|doctest:|noinspection|@formatter|clang-format|global \w+$|exported \w+$|cgo)"
)
TAG = re.compile(r"^\s*(?:[@\\]\w+|:\w+[^:]*:|(?:args?|arguments|params?|parameters|returns?|return type|yields?|raises|throws|exceptions?|examples?|usage|notes?|see also|attributes|keyword args|kwargs|input|inputs|output|outputs)\s*:?\s*$)", re.I)
TODO = re.compile(r"^\W*(?:todo|fixme|xxx|hack|wip|tbd|tba)\b(?!\s+(?:list|item)s?\b)", re.I)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_CODE = re.compile(r"[(\[{=;]|^\s*(?:return|import|from|break|continue|pass|raise|throw|del|assert)\b")
_BROKEN_CODE = re.compile(r"[{};]\s*$|^\s*(?:if|for|while|elif|else|def|class|with|try|switch|case|func)\b.*[:{]\s*$|^\s*\w+(?:\.\w+)*\s*(?::=|=(?!=)|\+=|-=)\s*\S+\s*$|^\s*[)\]}]+[,;]?\s*$")


_IES = re.compile(r"(?:ies|ied)$")
_ENDING = re.compile(r"(?:ing|ed|es|s|e)$")


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    w = word.lower()
    if len(w) > 3:
        w = _IES.sub("y", w)
        w = _ENDING.sub("", w) or w
        if len(w) > 3 and w[-1] == w[-2]:
            w = w[:-1]
    return w[:-1] + "i" if w.endswith("y") else w


_FILLER = frozenset(map(_stem, FILLER))


@lru_cache(maxsize=50_000)
def _is_code(kind: str, text: str) -> bool:
    """Is a comment's text code of the file's language that was taken out?"""
    rows = [r for r in text.split("\n") if r.strip()]
    if not rows or not all(_CODE.search(r) or _BROKEN_CODE.search(r) for r in rows):
        return False
    if kind == "python":
        first = len(rows[0]) - len(rows[0].lstrip())
        whole = "async def f():\n" + "\n".join("    " + r[first:] if r[:first].strip() == "" else "    " + r for r in rows)
    elif kind == "go":
        whole = "package p\nfunc f() {\n" + "\n".join(rows) + "\n}"
    else:
        whole = "async function f() {\n" + "\n".join(rows) + "\n}"
    if syntax.check("js" if kind == "js" else kind, whole)[0]:
        return True
    return all(_BROKEN_CODE.search(r) or _is_code(kind, r.strip()) for r in rows) if len(rows) > 1 else bool(_BROKEN_CODE.search(rows[0]))


def describes(doc: str, name: str, params: tuple[str, ...], comment: bool, kind: str) -> bool:
    """Does documentation say something about what the function does or how it behaves?

    It doesn't if nothing is left without rulers, tags, directives for tools,
    placeholders, words of the function's name and parameters, and code that was
    commented out.
    """
    rows = [r.strip() for r in doc.split("\n")]
    rows = [r for r in rows if any(c.isalpha() for c in r)]
    rows = [r for r in rows if not (TAG.match(r) or DIRECTIVE.match(r) or TODO.match(r))]
    if not rows:
        return False
    if comment and _is_code(kind, "\n".join(rows)):
        return False
    own = {_stem(w) for x in (name, *params) for w in _SPLIT.findall(x)} | {p.lower() for p in params} | {name.lower()} | _FILLER
    for r in rows:
        words = _SPLIT.findall(r)
        if all(w.lower() in PLACEHOLDER for w in words):
            continue
        if any(_stem(w) not in own and w.lower() not in own for w in words):
            return True
    return False


_LEX = {"python": "python", "go": "go", "js": "js", "mjs": "js", "cjs": "js"}


def documented(path: str | None, text: str | None) -> list[tuple[Found, str]]:
    """Functions of a file that parses, with the documentation that describes them."""
    kind = syntax.kind_of(path, text or "")
    if text is None or kind not in _LEX:
        return []
    out = []
    for f in functions(_LEX[kind], text):
        good = [d for d, c in zip(f.docs, f.comments) if describes(d, f.name, f.params, c, _LEX[kind])]
        if good:
            out.append((f, "\n".join(x.strip() for x in good)))
    return out if out and syntax.check(kind, text)[0] else []


def _rows(code: bool):
    def fn(file_id: int, project_id: str, path: str, text: str) -> Iterator[tuple]:
        plain = None
        for f, doc in documented(path, text):
            if code:
                plain = plain or (text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text)
                yield file_id, project_id, path, f.name, f.line, doc, plain[f.start : f.end]
            else:
                yield file_id, project_id, path, f.name, f.line

    return fn


def symbols_in_force(symbols: DataFrame, columns: list[str]) -> DataFrame:
    """The last version of each (project_id, id) that isn't deleted: project_id and the given columns.

    Of versions with equal indexed_at a deletion wins, then the largest values.
    """
    last = F.max(F.struct("indexed_at", F.col("deleted_at").isNotNull().alias("gone"), *columns)).alias("v")
    return symbols.groupBy("project_id", "id").agg(last).where(~F.col("v.gone")).select("project_id", *(F.col(f"v.{c}").alias(c) for c in columns))


def code_pairs(files: DataFrame, symbols: DataFrame, code: bool = True) -> DataFrame:
    """Code and documentation of each documented function: file_id, qualified_name, start_line, kind, signature, documentation, code.

    With code=False only file_id and qualified_name, each once.  A function is
    joined to the symbol in force with the same name at the same line; one
    without gives no row, nor do null contents, files that don't parse and files
    without functions.  Functions of equal qualified name at different lines
    are different pairs.  Repeated rows of files give one result; if their
    contents differ, the least of its columns in order.
    """
    cols = "file_id long, project_id string, file_path string, name string, start_line int"
    rows = map_rows(files.select("file_id", "project_id", "file_path", "content"), _rows(code), cols + (", documentation string, code string" if code else ""))
    keys = ["project_id", "file_path", "name", "start_line"]
    there = symbols_in_force(symbols.where(F.col("kind").isin("Function", "Method")), ["file_path", "name", "start_line", "qualified_name", *(["kind", "signature"] if code else [])])
    joined = rows.join(there, keys)
    if not code:
        return joined.select("file_id", "qualified_name").distinct()
    rest = ["kind", "signature", "documentation", "code"]
    return joined.groupBy("file_id", "qualified_name", "start_line").agg(F.min(F.struct(*rest)).alias("v")).select("file_id", "qualified_name", "start_line", *(f"v.{c}" for c in rest))
