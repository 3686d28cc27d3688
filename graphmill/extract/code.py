"""Extractors of programming languages: a syntax tree for Python, pattern rows for the others."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from .core import Record, complexity, module_name, register


@register("Python")
def python(path: str, text: str) -> Iterator[Record]:
    """Classes, functions and methods with calls and imports from the syntax tree; pattern rows if it can't be parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield from by_patterns("Python", path, text)
        return
    mod = module_name(path)
    lines = text.split("\n")

    def walk(body: list, owner: str, in_class: bool) -> Iterator[Record]:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                qn = f"{owner}.{n.name}"
                cls = isinstance(n, ast.ClassDef)
                head = lines[n.lineno - 1].strip()
                body_text = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                yield Record("symbol", "Class" if cls else "Method" if in_class else "Function", n.name, qn, n.lineno, n.end_lineno or n.lineno, head, ast.get_docstring(n), owner if in_class else None, 0 if cls else complexity(body_text), not n.name.startswith("_"), 1.0)
                yield from walk(n.body, qn, cls)
                if not cls:
                    yield from refs(n.body, qn)
            elif isinstance(n, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                yield from walk([*n.body, *getattr(n, "orelse", []), *getattr(n, "finalbody", [])], owner, in_class)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    yield Record("edge", "IMPORTS", a.name, owner, n.lineno, n.lineno)
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                for a in n.names:
                    yield Record("edge", "IMPORTS", f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}", owner, n.lineno, n.lineno)

    def refs(body: list, owner: str) -> Iterator[Record]:
        stack = [n for n in body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        seen = set()
        while stack:
            n = stack.pop()
            if isinstance(n, ast.Call) and (name := _dotted(n.func)) and name not in seen:
                seen.add(name)
                yield Record("edge", "CALLS", name, owner, n.lineno, n.lineno)
            stack.extend(c for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))

    yield from walk(tree.body, mod, False)
    yield from refs(tree.body, mod)


def _dotted(n: ast.AST) -> str | None:
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else None


class Patterns(NamedTuple):
    """How a language shows its symbols: patterns with a group 'name', and how blocks end."""

    symbols: tuple[tuple[str, str], ...]
    imports: str = r"(?!)"
    block: str = "brace"  # brace, indent or end
    comment: str = r"//[^\n]*|/\*[\s\S]*?\*/"
    exported: str = r""
    confidence: float = 0.85


_N = r"(?P<name>[A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|partial|open|export|default|declare|const|inline|extern|unsafe|pub(?:\([^)]*\))?|suspend|data|readonly|synchronized|native|case|implicit|lazy|fileprivate|mutating|external|factory)\s+)*"
_C_FN = rf"(?m)^[ \t]*{_MODS}[\w:<>\[\],.*&?\s]+?[\s*&]{_N}\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:throws\s+[\w.,\s]+)?(?:->\s*[\w:<>&*\s]+)?\{{"
_CLASS = rf"(?m)^[ \t]*{_MODS}(?:class|struct|record|object|trait|enum|union|namespace|actor|extension|mixin|protocol|impl(?:<[^>]*>)?)\s+{_N}"
#: Patterns by language.
TABLE: dict[str, Patterns] = {
    "Python": Patterns((("Class", rf"(?m)^[ \t]*class\s+{_N}"), ("Function", rf"(?m)^[ \t]*(?:async\s+)?def\s+{_N}\s*\(")), r"(?m)^[ \t]*(?:from\s+(?P<name>[\w.]+)\s+import|import\s+(?P<other>[\w.]+))", "indent", r"#[^\n]*", r"^(?!_)"),
    "Go": Patterns((("Method", rf"(?m)^func\s*\([^()]*\)\s*{_N}"), ("Function", rf"(?m)^func\s+{_N}"), ("Interface", rf"(?m)^type\s+{_N}\s+interface\b"), ("Class", rf"(?m)^type\s+{_N}\s+(?!interface)"), ("Constant", rf"(?m)^const\s+{_N}"), ("Variable", rf"(?m)^var\s+{_N}")), r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<name>[^"\n]+)"\s*$', exported=r"^[A-Z]"),
    "JavaScript": Patterns((("Class", rf"(?m)^[ \t]*{_MODS}class\s+{_N}"), ("Function", rf"(?m)^[ \t]*{_MODS}function\s*\*?\s*{_N}\s*\("), ("Function", rf"(?m)^[ \t]*{_MODS}(?:const|let|var)?\s*{_N}\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>"), ("Method", rf"(?m)^[ \t]+(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b){_N}\s*\([^()]*\)\s*\{{")), r"""(?m)(?:^import\s+(?:[^'"\n]*from\s*)?|require\(\s*)['"](?P<name>[^'"\n]+)['"]"""),
    "Rust": Patterns((("Function", rf"(?m)^[ \t]*{_MODS}fn\s+{_N}"), ("Interface", rf"(?m)^[ \t]*{_MODS}trait\s+{_N}"), ("Class", rf"(?m)^[ \t]*{_MODS}(?:struct|enum|union)\s+{_N}")), r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<name>[\w:]+)"),
    "Java": Patterns((("Interface", rf"(?m)^[ \t]*{_MODS}@?interface\s+{_N}"), ("Class", _CLASS), ("Method", _C_FN)), r"(?m)^import\s+(?:static\s+)?(?P<name>[\w.*]+)"),
    "Ruby": Patterns((("Class", r"(?m)^[ \t]*(?:class|module)\s+(?P<name>[A-Z][\w:]*)"), ("Function", r"(?m)^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")), r"(?m)^[ \t]*require(?:_relative)?\s+['\"](?P<name>[^'\"]+)", "end", r"#[^\n]*"),
    "PHP": Patterns((("Interface", rf"(?m)^[ \t]*{_MODS}interface\s+{_N}"), ("Class", _CLASS), ("Function", rf"(?m)^[ \t]*{_MODS}function\s+&?{_N}")), r"(?m)^[ \t]*(?:use|require_once|include)\s+['\"]?(?P<name>[\w\\/.]+)", comment=r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/"),
    "C": Patterns((("Class", rf"(?m)^[ \t]*(?:typedef\s+)?(?:struct|union|enum|class)\s+{_N}\s*[{{:]"), ("Function", _C_FN), ("Constant", rf"(?m)^[ \t]*#define\s+{_N}")), r"(?m)^[ \t]*#include\s+[<\"](?P<name>[^>\"\n]+)"),
    "CSharp": Patterns((("Interface", rf"(?m)^[ \t]*{_MODS}interface\s+{_N}"), ("Class", _CLASS), ("Method", _C_FN)), r"(?m)^using\s+(?P<name>[\w.]+)"),
    "Kotlin": Patterns((("Interface", rf"(?m)^[ \t]*{_MODS}interface\s+{_N}"), ("Class", _CLASS), ("Function", rf"(?m)^[ \t]*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_N}\s*\(")), r"(?m)^import\s+(?P<name>[\w.*]+)"),
    "Swift": Patterns((("Interface", rf"(?m)^[ \t]*{_MODS}protocol\s+{_N}"), ("Class", _CLASS), ("Function", rf"(?m)^[ \t]*{_MODS}func\s+{_N}")), r"(?m)^import\s+(?P<name>[\w.]+)"),
    "Lua": Patterns((("Function", r"(?m)^[ \t]*(?:local\s+)?function\s+(?P<name>[\w.:]+)"), ("Function", rf"(?m)^[ \t]*(?:local\s+)?{_N}\s*=\s*function")), r"require\s*\(?['\"](?P<name>[^'\"]+)", "end", r"--\[\[[\s\S]*?\]\]|--[^\n]*"),
    "Zig": Patterns((("Function", rf"(?m)^[ \t]*(?:pub\s+)?(?:export\s+)?fn\s+{_N}"), ("Class", rf"(?m)^[ \t]*(?:pub\s+)?const\s+{_N}\s*=\s*(?:struct|enum|union)")), r'@import\("(?P<name>[^"]+)"'),
    "Scala": Patterns((("Interface", rf"(?m)^[ \t]*{_MODS}trait\s+{_N}"), ("Class", _CLASS), ("Function", rf"(?m)^[ \t]*{_MODS}def\s+{_N}")), r"(?m)^import\s+(?P<name>[\w.{{}},\s]+)"),
    "Dart": Patterns((("Class", _CLASS), ("Method", _C_FN)), r"(?m)^import\s+['\"](?P<name>[^'\"]+)"),
    "R": Patterns((("Function", r"(?m)^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function"),), r"(?:library|require)\((?P<name>\w+)", comment=r"#[^\n]*"),
    "Elixir": Patterns((("Class", r"(?m)^[ \t]*defmodule\s+(?P<name>[\w.]+)"), ("Function", rf"(?m)^[ \t]*defp?\s+{_N}")), r"(?m)^[ \t]*(?:alias|import|use)\s+(?P<name>[\w.]+)", "end", r"#[^\n]*"),
    "Bash": Patterns((("Function", r"(?m)^[ \t]*(?:function\s+(?P<name>[\w-]+)|(?P<other>[\w-]+)\s*\(\)\s*\{)"),), r"(?m)^[ \t]*(?:source|\.)\s+(?P<name>\S+)", comment=r"(?<![\w$\"'{])#[^\n]*"),
    "Makefile": Patterns((("Function", r"(?m)^(?P<name>[\w./%-]+)\s*:(?!=)"), ("Variable", r"(?m)^(?P<name>\w+)\s*[:?+]?=")), r"(?m)^-?include\s+(?P<name>\S+)", "indent", r"#[^\n]*"),
    "SQL": Patterns((("Class", r"(?im)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)"), ("Function", r"(?im)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+(?P<name>[\w.\"`]+)")), comment=r"--[^\n]*|/\*[\s\S]*?\*/"),
    "Jinja": Patterns((("Function", r"\{%-?\s*macro\s+(?P<name>\w+)"), ("Section", r"\{%-?\s*block\s+(?P<name>\w+)"), ("Variable", r"\{%-?\s*set\s+(?P<name>\w+)")), r"\{%-?\s*(?:extends|include|import|from)\s+['\"](?P<name>[^'\"]+)", comment=r"\{#[\s\S]*?#\}"),
}
TABLE["TypeScript"] = TABLE["JavaScript"]._replace(symbols=(("Interface", rf"(?m)^[ \t]*{_MODS}(?:interface|type)\s+{_N}"), ("Class", rf"(?m)^[ \t]*{_MODS}(?:abstract\s+)?(?:class|enum|namespace)\s+{_N}"), *TABLE["JavaScript"].symbols[1:]))
TABLE["C++"] = TABLE["C"]._replace(symbols=(("Class", _CLASS), *TABLE["C"].symbols[1:]))
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
_CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*\(")
_CONTROL = frozenset("if for while switch catch return function else do sizeof synchronized".split())
_NOT_CALLS = frozenset("if for while switch catch return function func def fn fun sizeof typeof new await yield not and or in elif except with assert print_ match case lambda defer go select class super".split())


#: A regular expression literal, which stands where an operand may begin.
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+\n])|(?<=\breturn))[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"


def _blank(comment: str, text: str, strings: bool = True, regex: bool = False) -> str:
    """The text without comments and strings, with the same offsets; a comment inside a string stays a string."""
    pattern = re.compile(rf"({_STRING}{'|' + _REGEX if regex else ''})|({comment})")

    def one(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0]) if m[2] is not None or strings else m[0]

    return pattern.sub(one, text)


def _braces(masked: str) -> dict[int, int]:
    """Ends of brace blocks by their starts."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def _block_end(kind: str, masked: str, at: int, braces: dict[int, int]) -> int:
    if kind == "brace":
        k = masked.find("{", at)
        stop = masked.find("\n", at)
        if k < 0 or 0 <= stop < k and masked[at : min(k, at + 2000)].strip().count("\n") > 2:
            return stop if stop >= 0 else len(masked)
        return braces.get(k, len(masked))
    begin = masked.rfind("\n", 0, at) + 1
    stop = masked.find("\n", begin)
    row = masked[begin : stop if stop >= 0 else len(masked)]
    indent = len(row) - len(row.lstrip())
    pos = masked.find("\n", at)
    last = pos if pos >= 0 else len(masked)
    while pos >= 0:
        nxt = masked.find("\n", pos + 1)
        line = masked[pos + 1 : nxt if nxt >= 0 else len(masked)]
        if line.strip():
            depth = len(line) - len(line.lstrip())
            if kind == "end" and depth <= indent and re.match(r"\s*end\b", line):
                return nxt if nxt >= 0 else len(masked)
            if depth <= indent and kind == "indent":
                break
            last = nxt if nxt >= 0 else len(masked)
        pos = nxt
    return last


_FIELD = re.compile(r"(?m)^[ \t]*((?:[A-Za-z_]\w*[ \t]*,[ \t]*)*[A-Za-z_]\w*)[ \t]+([\w.*\[\]{}<>() -]+?)[ \t]*(?:`[^`\n]*`)?[ \t]*$")
_DECLARED = re.compile(r"(?m)^[ \t]*([A-Za-z_]\w*)\s*\(")
_WRITTEN = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*(?:[-+*/%&|^]|<<|>>|&\^)?=(?!=)")
_DOTTED = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?![\w(.]|\s*\()")


def _go_members(kind: str, qn: str, body: str, line: int) -> Iterator[Record]:
    """Fields of a struct and methods that an interface declares."""
    if kind == "Interface":
        for m in _DECLARED.finditer(body):
            yield Record("interface_method", "Method", m[1], qn, line, line, confidence=0.85)
    else:
        for m in _FIELD.finditer(body):
            for name in m[1].split(","):
                yield Record("field", "Field", name.strip(), qn, line, line, m[2].strip(), confidence=0.85)


def _go_uses(qn: str, body: str, values: frozenset[str], line: int) -> Iterator[Record]:
    """What a function writes, and which package values and selected names it reads, each once."""
    written = {m[1] for m in _WRITTEN.finditer(body)}
    for name in sorted(written):
        yield Record("edge", "WRITES", name, qn, line, line, confidence=0.85)
    for name in sorted({m[1] for m in _DOTTED.finditer(body)} - written):
        if "." in name or name in values:
            yield Record("edge", "READS", name, qn, line, line, confidence=0.85)


def by_patterns(language: str, path: str, text: str) -> Iterator[Record]:
    """Symbols by a language's patterns, nested by their blocks, with imports and calls.

    Linear in the text but for the depth of nesting: lines are found in a table
    of their starts and blocks in a table of their ends.  Go also gives fields
    of structs, methods of interfaces, reads and writes.
    """
    p = TABLE[language]
    mod = module_name(path)
    masked = _blank(p.comment, text, regex=language in ("JavaScript", "TypeScript"))
    begins = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(begins, at)
    braces = _braces(masked) if p.block == "brace" else {}
    found = []
    for rank, (kind, pattern) in enumerate(p.symbols):
        for m in re.finditer(pattern, masked):
            name = m["name"] or (m["other"] if "other" in m.re.groupindex else None)
            if name and name not in _CONTROL:
                value = kind in ("Variable", "Constant")  # no block of its own
                end = (masked.find("\n", m.end()) + 1 or len(masked)) if value else _block_end(p.block, masked, m.end() - 1, braces)
                found.append((m.start() + len(m[0]) - len(m[0].lstrip()), end, kind, name.strip('"`'), rank))
    found.sort(key=lambda f: (f[0], f[4]))
    values = frozenset(f[3] for f in found if f[2] in ("Variable", "Constant"))
    stack: list[tuple[int, str, str]] = []
    spans = []
    taken = set()
    for start, end, kind, name, _ in found:
        if start in taken:
            continue
        taken.add(start)
        while stack and stack[-1][0] <= start:
            stack.pop()
        owner = stack[-1] if stack else None
        in_class = bool(owner and owner[2] in ("Class", "Interface"))
        if kind == "Function" and in_class:
            kind = "Method"
        stop = masked.find("\n", start)
        row = text[start : stop if stop >= 0 else len(text)].rstrip(" {")
        parent = owner[1] if in_class else None
        if kind == "Method" and language == "Go" and (r := re.match(r"func\s*\(\s*\w*\s*\*?\s*(\w+)", row)):
            parent = f"{mod}.{r[1]}"
            qn = f"{parent}.{name}"
        else:
            qn = f"{owner[1] if owner else mod}.{name}"
        line = line_of(start)
        yield Record("symbol", kind, name, qn, line, line_of(max(start, end - 1)), row, None, parent, complexity(text[start:end]) if kind in ("Function", "Method") else 0, bool(re.search(p.exported, name)) if p.exported else not name.startswith("_"), p.confidence)
        if language == "Go" and kind in ("Class", "Interface") and (k := masked.find("{", start, end)) >= 0:
            yield from _go_members(kind, qn, text[k + 1 : end - 1], line)
        stack.append((end, qn, kind))
        if kind in ("Function", "Method"):
            spans.append((start, end, qn))
    whole = _blank(p.comment, text, strings=False)
    for m in re.finditer(p.imports, whole):
        name = m["name"] or (m["other"] if "other" in m.re.groupindex else None)
        if name:
            line = line_of(m.start())
            yield Record("edge", "IMPORTS", name, mod, line, line, confidence=p.confidence)
    for start, end, qn in spans:
        seen = set()
        body = masked.find("{", start, end) if p.block == "brace" else masked.find("\n", start, end)
        if language == "Go" and body >= 0:
            yield from _go_uses(qn, masked[body:end], values, line_of(start))
        for m in _CALL.finditer(masked, max(body, start), end):
            if m[1] not in seen and m[1] not in _NOT_CALLS:
                seen.add(m[1])
                line = line_of(m.start())
                yield Record("edge", "CALLS", m[1], qn, line, line, confidence=p.confidence)


def _make(language: str):
    def fn(path: str, text: str) -> Iterator[Record]:
        return by_patterns(language, path, text)

    return fn


for _language in TABLE:
    if _language != "Python":
        register(_language)(_make(_language))
