"""Extractors of documents and configuration: Markdown, HTML, XML, YAML, JSON, TOML and HCL."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

from .core import Record, module_name, register


def slug(text: str) -> str:
    return re.sub(r"[\s-]+", "-", re.sub(r"[^\w\s-]", "", text.lower().strip())).strip("-")


def _sections(mod: str, heads: list[tuple[int, str, int]], last: int) -> Iterator[Record]:
    """Headings (level, title, line) as a hierarchy of dotted sections."""
    stack: list[tuple[int, str]] = []
    for k, (level, title, line) in enumerate(heads):
        while stack and stack[-1][0] >= level:
            stack.pop()
        owner = stack[-1][1] if stack else mod
        qn = f"{owner}.{slug(title) or 'section'}"
        end = next((x[2] - 1 for x in heads[k + 1 :] if x[0] <= level), last)
        yield Record("symbol", "Section", title, qn, line, max(line, end), parent=owner if stack else None, is_exported=True)
        stack.append((level, qn))


@register("Markdown")
def markdown(path: str, text: str) -> Iterator[Record]:
    """Headings as sections and links to other places as references; fenced code is skipped."""
    mod, heads, links, fence = module_name(path), [], [], ""
    rows = text.split("\n")
    for n, row in enumerate(rows, 1):
        m = re.match(r"\s{0,3}(```+|~~~+)", row)
        if m:
            fence = "" if fence and row.strip().startswith(fence) else fence or m[1]
            continue
        if fence:
            continue
        if h := re.match(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$", row):
            heads.append((len(h[1]), h[2], n))
        elif n > 1 and re.fullmatch(r"\s*(=+|-{2,})\s*", row) and rows[n - 2].strip() and not rows[n - 2].lstrip().startswith(("#", "-", "|", ">")):
            heads.append((1 if "=" in row else 2, rows[n - 2].strip(), n - 1))
        links += [(m[1], n) for m in re.finditer(r"\]\(([^)\s]+)[^)]*\)", row)]
    yield from _sections(mod, heads, len(rows))
    for target, n in dict.fromkeys(links):
        yield Record("edge", "REFERENCES", target, mod, n, n)


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heads: list[tuple[int, str, int]] = []
        self.links: dict[str, int] = {}
        self.open: tuple[int, list[str], int] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if re.fullmatch(r"h[1-6]|title", tag):
            self.open = (0 if tag == "title" else int(tag[1]), [], self.getpos()[0])
        target = a.get("src") if tag == "script" else a.get("href") if tag in ("a", "link") else None
        if target and not target.startswith(("#", "javascript:")):
            self.links.setdefault(target, self.getpos()[0])

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.open and re.fullmatch(r"h[1-6]|title", tag):
            title = " ".join("".join(self.open[1]).split())
            if title:
                self.heads.append((self.open[0], title, self.open[2]))
            self.open = None


@register("HTML")
def html(path: str, text: str) -> Iterator[Record]:
    """Title and headings as sections; scripts, sheets and links, each once, as imports."""
    p = _Html()
    p.feed(text)
    mod = module_name(path)
    yield from _sections(mod, p.heads, text.count("\n") + 1)
    for target, line in p.links.items():
        yield Record("edge", "IMPORTS", target, mod, line, line)


@register("XML")
def xml(path: str, text: str) -> Iterator[Record]:
    """Elements as dotted settings; a text that isn't well-formed gives those before the fault."""
    mod, out, stack = module_name(path), [], []
    p = expat.ParserCreate()

    def start(name: str, attrs: dict) -> None:
        stack.append(name)
        out.append(Record("symbol", "Setting", name, f"{mod}.{'.'.join(stack)}", p.CurrentLineNumber, p.CurrentLineNumber))

    p.StartElementHandler = start
    p.EndElementHandler = lambda _: stack.pop()
    p.EntityDeclHandler = lambda *_: (_ for _ in ()).throw(ValueError("entities aren't read"))
    try:
        p.Parse(text, True)
    except (expat.ExpatError, ValueError):
        pass
    seen = set()
    for r in out:
        if r.qualified_name not in seen:
            seen.add(r.qualified_name)
            yield r


def _settings(mod: str, value: object, path: tuple[str, ...], lines: dict[str, int]) -> Iterator[Record]:
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        if isinstance(value, list) and not isinstance(v, (dict, list)):
            continue
        here = (*path, str(k))
        if isinstance(value, dict):
            line = lines.get(str(k), 1)
            yield Record("symbol", "Setting", str(k), f"{mod}.{'.'.join(here)}", line, line, None if isinstance(v, (dict, list)) else str(v)[:200])
        yield from _settings(mod, v, here, lines)


def _key_lines(text: str, pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for n, row in enumerate(text.split("\n"), 1):
        for m in re.finditer(pattern, row):
            out.setdefault(m[1], n)
    return out


@register("JSON")
def json_settings(path: str, text: str) -> Iterator[Record]:
    value = json.loads(text)  # a text that is no JSON is a failure of its file
    yield from _settings(module_name(path), value, (), _key_lines(text, r'"((?:[^"\\]|\\.)*)"\s*:'))


@register("TOML")
def toml(path: str, text: str) -> Iterator[Record]:
    value = tomllib.loads(text)  # a ValueError where it is no TOML
    yield from _settings(module_name(path), value, (), _key_lines(text, r"(?:^\s*|[\[.\"])([\w-]+)\"?\s*(?:=|\]|\.)"))


@register("YAML")
def yaml(path: str, text: str) -> Iterator[Record]:
    """Keys by indentation as dotted settings, with the files and variables that tasks name."""
    mod, stack = module_name(path), []
    for n, row in enumerate(text.split("\n"), 1):
        m = re.match(r"^(\s*(?:-\s+)*)(['\"]?)([\w./-]+)\2\s*:(?:\s+(.*))?$", re.sub(r"\s+#.*$", "", row))
        if not m or row.lstrip().startswith("#"):
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        owner = [s[1] for s in stack]
        yield Record("symbol", "Setting", m[3], ".".join([mod, *owner, m[3]]), n, n, m[4])
        stack.append((depth, m[3]))
        value = (m[4] or "").strip().strip("'\"")
        kind = {"src": "RENDERS", "template": "RENDERS", "include": "INCLUDES", "include_tasks": "INCLUDES", "import_tasks": "INCLUDES", "import_playbook": "INCLUDES", "include_role": "INCLUDES", "include_vars": "LOADS", "vars_files": "LOADS"}.get(m[3].rsplit(".", 1)[-1])
        if kind and value and (kind != "RENDERS" or value.endswith((".j2", ".tmpl", ".tpl"))):
            yield Record("edge", kind, value, mod, n, n)
        for v in dict.fromkeys(re.findall(r"\{\{\s*([\w.]+)", row)):
            yield Record("edge", "USES_VAR", v, mod, n, n)


_HCL = re.compile(r'^\s*(resource|data|module|variable|output|provider|locals|terraform)\b((?:\s+"[^"]*")*)\s*\{', re.M)
_HCL_KINDS = {"resource": "Resource", "data": "DataSource", "module": "Module", "variable": "Variable", "output": "Output", "provider": "Provider", "locals": "Block", "terraform": "Block"}


@register("HCL")
def hcl(path: str, text: str) -> Iterator[Record]:
    """Blocks with their labels, module sources as imports, and references between blocks."""
    mod = module_name(path)
    bare = re.sub(r"#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in _HCL.finditer(bare):
        labels = re.findall(r'"([^"]*)"', m[2])
        depth, end = 0, len(bare)
        for b in re.compile(r"[{}]").finditer(bare, m.end() - 1):
            depth += 1 if b[0] == "{" else -1
            if depth == 0:
                end = b.end()
                break
        name = ".".join(labels) or m[1]
        qn = f"{mod}.{m[1]}.{name}"
        first, last = text.count("\n", 0, m.start(1)) + 1, text.count("\n", 0, end - 1) + 1
        yield Record("symbol", _HCL_KINDS[m[1]], labels[-1] if labels else m[1], qn, first, last, m[0].strip().rstrip("{").strip(), is_exported=m[1] == "output")
        body = bare[m.end() : end]
        if m[1] == "locals":
            for x in re.finditer(r"(?m)^\s*(\w+)\s*=", body):
                line = first + body.count("\n", 0, x.start(1))
                yield Record("symbol", "Local", x[1], f"{mod}.local.{x[1]}", line, line)
        if s := re.search(r'(?m)^\s*source\s*=\s*"([^"]+)"', body):
            yield Record("edge", "IMPORTS", s[1], qn, first, first)
        for ref in dict.fromkeys(re.findall(r"\b((?:var|local|module|data\.\w+)\.\w+|[a-z]\w*_\w+\.\w+)", body)):
            yield Record("edge", "REFERENCES", ref, qn, first, first)
