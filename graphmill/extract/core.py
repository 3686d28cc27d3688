"""One extractor per language behind one function, and the operator that runs them over files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.mapping import map_rows
from ..sources.languages import detect


class Record(NamedTuple):
    """A symbol (what = 'symbol'), a reference ('edge'), a field of a struct or a method that an interface declares ('field', 'interface_method'; qualified_name is the owner's)."""

    what: str
    kind: str
    name: str  # of the symbol; of an edge's target
    qualified_name: str  # of the symbol; of an edge's source
    start_line: int
    end_line: int
    signature: str | None = None
    docstring: str | None = None
    parent: str | None = None
    complexity: int = 0
    is_exported: bool = False
    confidence: float = 1.0


EXTRACTED = "project_id string, file_path string, language string, what string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, docstring string, parent string, complexity int, is_exported boolean, confidence double"

Extractor = Callable[[str, str], Iterator[Record]]
_EXTRACTORS: dict[str, Extractor] = {}


def register(*languages: str) -> Callable[[Extractor], Extractor]:
    """Adds an extractor for languages; a later one replaces an earlier one."""

    def add(fn: Extractor) -> Extractor:
        for x in languages:
            _EXTRACTORS[x] = fn
        return fn

    return add


def module_name(path: str) -> str:
    """Dotted name of a file without its extension."""
    return re.sub(r"\.\w+$", "", path).strip("/").replace("/", ".")


def extract(language: str, path: str, text: str) -> list[Record]:
    """Symbols and references of a text; a module symbol first.

    Symbols with the same qualified name and kind get ~line behind the name from
    the second on.  Unknown languages and empty texts give the module only.
    """
    from . import code, markup  # noqa: F401  (they register themselves)

    mod = module_name(path)
    kind = "Document" if language in ("Markdown", "HTML") else "Module"
    out = [Record("symbol", kind, mod.rsplit(".", 1)[-1], mod, 1, max(1, text.count("\n") + (not text.endswith("\n"))), is_exported=True)]
    fn = _EXTRACTORS.get(language)
    if fn and text:
        seen: dict[tuple[str, str], int] = {}
        for r in fn(path, text):
            if r.what == "symbol":
                key = (r.qualified_name, r.kind)
                if key in seen:
                    r = r._replace(qualified_name=f"{r.qualified_name}~{r.start_line}")
                seen[key] = 1
            out.append(r)
    return out


def complexity(text: str) -> int:
    """One more than the number of branch words."""
    from ..functions.columns import COMPLEXITY_WORDS

    return 1 + sum(text.count(w) for w in COMPLEXITY_WORDS)


def extract_files(files: DataFrame) -> DataFrame:
    """EXTRACTED rows of files (project_id, file_path, content); null contents give none, failures the module and a 'failure' row with the whole error."""

    def fn(project: str, path: str | None, text: str | None) -> Iterator[tuple]:
        if text is None or path is None:
            return
        language = detect(path, text.split("\n", 1)[0])
        try:
            for r in extract(language, path, text):
                yield (project, path, language, *r)
        except (ValueError, RecursionError, SyntaxError) as e:
            for r in extract("Unknown", path, text):
                yield (project, path, language, *r)
            yield (project, path, language, "failure", type(e).__name__, str(e), module_name(path), 1, 1, None, None, None, 0, False, 0.0)

    return map_rows(files.select("project_id", "file_path", "content"), fn, EXTRACTED)
