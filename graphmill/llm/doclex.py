"""Functions of a source file with the documentation written for them.

A lexer that knows strings and comments blanks both out of a copy of the text,
so that heads and braces can be found in what is left; braces (in Python,
indentation) delimit each function.  Documentation is a docstring or a comment
block that ends on the line above the function, decorators aside.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .syntax import JavaScript, line_at, starts

_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
_BLANK = {
    "go": re.compile(rf"""({_C_COMMENT})|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]*)'"""),
    "js": re.compile(
        rf"""({_C_COMMENT})|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?:[^{{}}`]|\{{[^{{}}]*\}}|`[^`]*`)*\}})*`"""
        rf"""|(?:(?<=[(,=:\[!&|?;{{}}~^*%<>])|(?<=[(,=:\[!&|?;{{}}~^*%<>] )|(?<=\breturn )|(?<=\n)){JavaScript._regex}"""
    ),
    "python": re.compile(
        r"""(\#[^\n]*)|(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"""
    ),
}
_PY_DEF = re.compile(r"(?m)^([ \t\f]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*\(|(?<=[:;] )def[ \t]+(\w+)[ \t]*\(")
_PY_DOC = re.compile(r"""(?:[ \t\f]|\#[^\n]*|\r?\n|\\\n)*([rRuU]?)(\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')""")
_PY_AFTER = re.compile(r"[ \t\f]*(?:;|\#|\r?\n|$)")
_AFTER = re.compile(r"[;{}](?=[ \t]*[A-Za-z_$#*])")
_GO_DEF = re.compile(r"[ \t]*func[ \t]*(?:\([^()]*\)[ \t]*)?(\w+)[ \t]*(?:\[[^\]]*\])?\(")
_JS_DEF = re.compile(
    r"[ \t]*"
    r"(?:(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*([\w$]+)[ \t]*\("
    r"|(?:export[ \t]+)?(?:const|let|var)[ \t]+([\w$]+)[ \t]*=[ \t]*(?:async\b[ \t]*)?(?:function\b|\(|[\w$]+[ \t]*=>)"
    r"|(?:[\w$.]+\.)([\w$]+)[ \t]*=[ \t]*(?:async\b[ \t]*)?(?:function\b|\(|[\w$]+[ \t]*=>)"
    r"|(?:(?:static|async|get|set)[ \t]+)*\*?[ \t]*(\#?[\w$]+)[ \t]*(?:\(|:[ \t]*(?:async\b[ \t]*)?(?:function\b|\(|[\w$]+[ \t]*=>)|=[ \t]*(?:async\b[ \t]*)?(?:\(|[\w$]+[ \t]*=>)))"
)
#: Words that are followed by parentheses and a brace without being functions.
_JS_NOT = frozenset("if for while switch catch with function return typeof await new super import else do".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")
_NOT_LINE_END = re.compile(r"[^\n]")
_STAR = re.compile(r"^[ \t]*\*?(?!\*) ?|\*+$")
_SLASHES = re.compile(r"^//+!?")
_HASHES = re.compile(r"^#+[:!]?")
_VALUE = re.compile(r"[:=][^,()\[\]]*(?:\[[^\]]*\])?")
_DEFAULT = re.compile(r"=[^,()]*")
_AT = re.compile(r"[ \t]*@[\w$.]+")
_ARROW = re.compile(r"\s*=>\s*")
_OPEN = re.compile(r"\s*\{")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")


class Found(NamedTuple):
    name: str
    line: int  # of the head, decorators not counted
    start: int  # character offsets of the code, end exclusive
    end: int
    params: tuple[str, ...]
    docs: tuple[str, ...]  # each piece without comment marks
    comments: tuple[bool, ...]  # whether the piece is a comment block


def _close(masked: str, at: int) -> int:
    """Offset behind the bracket that closes the one at masked[at]; the end if none does."""
    depth = 0
    for m in _BRACKET.finditer(masked, at):
        if m[0] in _PAIRS:
            depth += 1
        else:
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(masked)


def mask(kind: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with blanks for strings and comments, and the comments' offsets."""
    comments: list[tuple[int, int]] = []

    def one(m: re.Match) -> str:
        if m[1] is not None:
            comments.append(m.span())
        t = m[0]
        return " " * len(t) if "\n" not in t else _NOT_LINE_END.sub(" ", t)

    return _BLANK[kind].sub(one, text), comments


def _strip(comment: str) -> str:
    """A comment's text without its marks."""
    if comment.startswith("/*"):
        body = comment[2:-2]
        body = body[1:] if body[:1] in "*!" else body
        return "\n".join(_STAR.sub("", x).rstrip() for x in body.split("\n"))
    if comment.startswith("//"):
        return _SLASHES.sub("", comment).strip()
    return _HASHES.sub("", comment).strip()


def _above(first: int, own: dict[int, tuple[int, str]]) -> str | None:
    """The comment block that ends on the line before `first`; own maps a comment's last line to its first and text."""
    parts: list[str] = []
    line = first - 1
    while line in own:
        begins, text = own[line]
        parts.append(text)
        line = begins - 1
    return "\n".join(reversed(parts)) if parts else None


def functions(kind: str, text: str) -> list[Found]:
    """Functions and methods of a text in python, go or js, in order.

    Byte order marks and any line ends are accepted.  Texts without functions,
    empty ones included, give an empty list.
    """
    if "\r" in text:
        text = text.replace("\r\n", " \n").replace("\r", "\n")
    masked, spans = mask(kind, text)
    begins = starts(text)
    lines = text.split("\n")
    own: dict[int, tuple[int, str]] = {}
    for a, b in spans:
        la, lb = line_at(begins, a), line_at(begins, b - 1)
        if not text[begins[la - 1] : a].strip() and not text[b : begins[lb] if lb < len(begins) else len(text)].strip():
            own[lb] = (la, _strip(text[a:b]))
    return (_python if kind == "python" else _braces)(kind, text, masked, begins, lines, own)


_BRACKET = re.compile(r"[()\[\]{}]")


def _opened(masked: str) -> dict[int, int]:
    """Where the bracket was opened, for each place where one is closed."""
    out, stack = {}, []
    for m in _BRACKET.finditer(masked):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            out[m.start()] = stack.pop()
    return out


def _python(kind: str, text: str, masked: str, begins: list[int], lines: list[str], own: dict) -> list[Found]:
    out = []
    opened = None
    for m in _PY_DEF.finditer(masked):
        name = m[2] or m[3]
        line = line_at(begins, m.start(2) if m[2] else m.start(3))
        start = m.start() + len(m[1] or "")
        close = _close(masked, m.end() - 1)
        params = tuple(_WORD.findall(_VALUE.sub(" ", masked[m.end() : close - 1])))
        colon = close
        depth = 0
        while colon < len(masked) and (masked[colon] != ":" or depth):
            depth += (masked[colon] in "([{") - (masked[colon] in ")]}")
            colon += 1
        docs, comments = [], []
        at, pieces = colon + 1, []
        while d := _PY_DOC.match(text, at):
            if pieces and "\n" in text[at : d.start(1)]:
                break
            q = 3 if d[2][:3] in ('"""', "'''") else 1
            pieces.append(d[2][q:-q])
            at = d.end()
        if pieces and _PY_AFTER.match(text, at):
            docs.append("".join(pieces))
            comments.append(False)
        top = line
        indent = len(m[1] or "")
        while top > 1:
            up = masked[begins[top - 2] : begins[top - 1]].rstrip("\n")
            if up.lstrip().startswith("@"):
                top -= 1
            elif up.strip() and up.strip()[-1] in ")]}":
                # the end of a decorator of several lines
                if opened is None:
                    opened = _opened(masked)
                b = opened.get(begins[top - 2] + len(up.rstrip()) - 1, -1)
                k = line_at(begins, b) if b >= 0 else 0
                if k and masked[begins[k - 1] : b].lstrip().startswith("@"):
                    top = k
                else:
                    break
            else:
                break
        for first in {line, top} if m[2] else ():
            if block := _above(first, own):
                docs.append(block)
                comments.append(True)
        out.append(Found(name, line, start, _python_end(masked, begins, line, indent, colon), params, tuple(docs), tuple(comments)))
    return out


def _python_end(masked: str, begins: list[int], line: int, indent: int, colon: int) -> int:
    k, last = line_at(begins, colon), colon + 1
    n = len(begins)
    end = begins[k] if k < n else len(masked)
    if masked[colon + 1 : end].strip():
        return end
    while k < n:
        row = masked[begins[k] : begins[k + 1] if k + 1 < n else len(masked)]
        if row.strip():
            if len(row) - len(row.lstrip()) <= indent and row.lstrip()[0] not in ")]}":
                break
            last = begins[k] + len(row.rstrip())
        k += 1
    return last


def _braces(kind: str, text: str, masked: str, begins: list[int], lines: list[str], own: dict) -> list[Found]:
    out = []
    at = 0
    pattern = _GO_DEF if kind == "go" else _JS_DEF
    places = begins if kind == "go" else sorted([*begins, *(m.end() for m in _AFTER.finditer(masked))])
    for place in places:
        if place < at or not (m := pattern.match(masked, place)):
            continue
        at = m.end()
        name = next(x for x in m.groups() if x)
        if kind == "js" and m[4] and m[4] in _JS_NOT:
            at = m.start(4) + len(m[4])
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        line = line_at(begins, start)
        head = m.end() - 1
        if masked[head] == "(":
            opened = head
        else:
            opened = masked.find("(", m.end()) if m[0].rstrip().endswith("function") else -1
        close = _close(masked, opened) if opened >= 0 else m.end()
        params = tuple(_WORD.findall(_DEFAULT.sub(" ", masked[opened + 1 : close - 1]))) if opened >= 0 else ()
        if kind == "js":
            arrow = _ARROW.match(masked, close)
            if m[4] and opened >= 0 and not arrow and not _OPEN.match(masked, close):
                continue
            if (m[2] or m[3]) and not arrow and not _OPEN.match(masked, close) and "=>" not in m[0]:
                continue
            opening = _OPEN.match(masked, close)
            body = arrow.end() if arrow else opening.end() - 1 if opening else close
        else:
            brace = masked.find("{", close)
            stop = masked.find("\n", close)
            body = brace if brace >= 0 and (stop < 0 or brace < stop) else close
        if body < len(masked) and masked[body] == "{":
            end = _close(masked, body)
            if masked[end : end + 1] == ";":
                end += 1
        else:
            end = masked.find("\n", body)
            end = end if end >= 0 else len(masked)
        top = line
        while top > 1 and _AT.match(lines[top - 2]):
            top -= 1
        # a block above a line belongs to what begins the line
        alone = not masked[begins[line - 1] : start].strip()
        docs = [b for first in {line, top} if alone and (b := _above(first, own))]
        out.append(Found(name, line, start, end, params, tuple(docs), tuple(True for _ in docs)))
    return out
