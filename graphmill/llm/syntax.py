"""Syntax check of whole source files: tokens, bracket tree, packrat grammar.

``check(language, text)`` says whether a text is valid, and if not, where the
furthest failure lies and what it looks like.  Languages are ``python``,
``go``, ``javascript`` (kinds ``js``, ``mjs`` and ``cjs``) and ``json``.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

from . import grammars
from .peg import BRACE0, END, Grammar, Groups, add_list, fold, unbalanced

#: Python frames that a check may use.
FRAMES = 60_000
ERR = "\ufffe"
MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|$)")


def _within(v: "Verdict", n: int) -> "Verdict":
    return v if v[1] <= n else Verdict(v[0], n, v[2])


class Verdict(tuple):
    """(valid, offset of the furthest failure in characters, cause)"""

    __slots__ = ()

    def __new__(cls, valid: bool, at: int = -1, cause: str = "") -> "Verdict":
        return super().__new__(cls, (valid, at, cause))


VALID = Verdict(True)


def _alphabet(words: str, operators: str, first: int = 0x180) -> dict[str, str]:
    """A character for each keyword and operator; single signs stand for themselves."""
    out = {}
    for k, w in enumerate([*words.split(), *operators.split()]):
        out[w] = w if len(w) == 1 and not w.isalnum() else chr(first + k)
    return out


class _Kinds(dict):
    """Token text to its kind; identifiers are kept, literals and comments aren't."""

    def __init__(self, fixed: dict[str, str], classify, keep: int = 200_000):
        super().__init__(fixed)
        self.fixed, self.classify, self.keep = fixed, classify, keep

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(token) < 40:
            if len(self) > self.keep:
                self.clear()
                self.update(self.fixed)
            self[token] = kind
        return kind


class Language:
    """What the languages share; a subclass gives tokens and rules."""

    def __init__(self) -> None:
        self.groups = Groups()

    def tidy(self) -> None:
        if self.groups.full() or any(g.crowded() for g in self.all_grammars()):
            self.groups.clear()
            for g in self.all_grammars():
                g.forget()

    def all_grammars(self) -> list[Grammar]:
        return [self.grammar]

    # ---- where a failing text fails
    def _tree(self, chars: list[tuple[str, int]], strip: re.Pattern | None = None) -> list:
        """Nodes (character, offset, children); chars must be balanced."""
        stack: list[list] = [[]]
        opened: list[int] = []
        for c, at in chars:
            if c in "([{" and len(c):
                stack.append([])
                opened.append(at)
            elif c in ")]}":
                inner = stack.pop()
                if strip is not None:
                    inner = [n for n in inner if not strip.match(n[0])]
                kind = {")": "PAREN", "]": "BRACK", "}": "BRACE"}[c]
                stack[-1].append((self.groups.intern(kind, "".join(n[0] for n in inner)), opened.pop(), inner, at))
            else:
                stack[-1].append((c, at, None, at))
        return stack[0]

    def _locate(self, g: Grammar, rule: str, nodes: list, end: int) -> int:
        """Offset of the furthest failure of a rule over nodes."""
        while True:
            f = g.furthest(rule, "".join(n[0] for n in nodes) + END)
            if f >= len(nodes):
                return end
            c, at, inner, close = nodes[max(f, 0)]
            rules = g.failing(c) if inner is not None else []
            if not rules:
                return at
            s = self.groups.content[c]
            rule, nodes, end = max(rules, key=lambda r: g.furthest(r, s)), inner, close

    @staticmethod
    def _cause(text: str, at: int, usual: str) -> str:
        start = text.rfind("\n", 0, max(at, 0)) + 1
        for m in MARKER.finditer(text):
            if m.start() >= start - 1 or m.start() <= at:
                return "merge conflict"
        return usual


# ---------------------------------------------------------------- JSON
class Json(Language):
    tokens = re.compile(
        r"""[ \t\r\n]*([{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[A-Za-z_0-9]+|[^ \t\r\n])"""
    )
    number = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")

    def __init__(self) -> None:
        super().__init__()
        words = _alphabet("true false null", ", : ( )")
        classes = {"STR": '"', "NUM": "0"}
        self.grammar = Grammar(grammars.JSON, words, classes, self.groups)
        self.kinds = _Kinds({**words, **{c: c for c in "[]{}"}, "(": ERR, ")": ERR}, self._classify)

    def _classify(self, t: str) -> str:
        if t[0] == '"' and len(t) > 1:
            return '"'
        return "0" if self.number.fullmatch(t) else ERR

    def check(self, text: str) -> Verdict:
        self.tidy()
        text = text.rstrip(" \t\r\n")
        toks = self.tokens.findall(text)
        s = fold("".join(map(self.kinds.__getitem__, toks)), self.groups)
        if self.grammar.whole("Json", s + END):
            return VALID
        chars = [(self.kinds[m[1]], m.start(1)) for m in self.tokens.finditer(text)]
        return self._fail(text, chars, "Json", self.grammar)

    def _fail(self, text: str, chars: list, rule: str, g: Grammar, strip: re.Pattern | None = None) -> Verdict:
        broken = next((k for k, (c, _) in enumerate(chars) if c == ERR), None)
        if broken is not None:
            return Verdict(False, chars[broken][1], self._cause(text, chars[broken][1], "bad token"))
        if wrong := unbalanced("".join(c if len(c) == 1 else "x" for c, _ in chars)):
            at = chars[wrong[0]][1]
            return Verdict(False, len(text) if wrong[1] == "unclosed bracket" else at, self._cause(text, at, wrong[1]))
        at = self._locate(g, rule, self._tree(chars, strip), len(text))
        return Verdict(False, at, self._cause(text, at, "unexpected end" if at >= len(text) else "unexpected token"))


# ---------------------------------------------------------------- Go
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_OPERATORS = "... := <- ++ -- == != <= >= && || << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~"


class Go(Json):
    tokens = re.compile(
        r"""[ \t\r]*(//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|\n|[^\W\d]\w*"""
        r"""|(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?\w*"""
        r"""|"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`"""
        r"""|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"""
        r"""|&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||<<|>>|&\^|[-+*/%&|^]=|/\*|[^ \t\r])"""
    )
    _number = re.compile(
        r"(?:0[xX](?:_?[0-9a-fA-F])+|0[xX](?=[0-9a-fA-F_]*\.?[0-9a-fA-F])[0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9]+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?[0-7])*|[1-9](?:_?[0-9])*|[0-9](?:_?[0-9])*i|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*)i?"
    )

    def __init__(self) -> None:
        Language.__init__(self)
        words = _alphabet(GO_WORDS, GO_OPERATORS)
        many = lambda t: "".join(words[x] for x in t.split())
        classes = {
            "ID": "a", "STRING": '"', "LITERAL": '"0',
            "BINARY": many("|| && == != < <= > >= + - | ^ * / % << >> & &^"),
            "ASSIGN": many("= += -= *= /= %= &= |= ^= <<= >>= &^="),
        }
        self.grammar = Grammar(grammars.GO, words, classes, self.groups, grammars.MEMO["go"])
        for rule, name in (("Item", "Statements"), ("Clause", "Clauses"), ("Top", "Tops")):
            add_list(self.grammar, rule, name)
        self.kinds = _Kinds({**words, "\n": "\n"}, self._classify)
        ends = re.escape('a0")]}' + many("break continue fallthrough return ++ --"))
        self.lines = re.compile(f"(?<=[{ends}])(\n)\n*|\n+")

    def _classify(self, t: str) -> str:
        c = t[0]
        if c in "\"`":
            return '"' if len(t) > 1 else ERR
        if t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return ERR if len(t) < 4 else "\n" if "\n" in t else ""
        if c == "'":
            return "0" if len(t) > 1 else ERR
        if c.isdigit() or c == "." and len(t) > 1:
            return "0" if self._number.fullmatch(t) else ERR
        return "a" if c == "_" or c.isalpha() else ERR

    def check(self, text: str) -> Verdict:
        self.tidy()
        if text[:1] == "\ufeff":
            text = " " + text[1:]
        if "\0" in text:
            return Verdict(False, text.index("\0"), "bad token")
        text = text.rstrip(" \t\r\n") + "\n"
        s = "".join(map(self.kinds.__getitem__, self.tokens.findall(text)))
        s = fold(self.lines.sub(lambda m: ";" if m[1] else "", s), self.groups)
        if self.grammar.whole("File", s + END):
            return VALID
        chars = [(k, m.start(1)) for m in self.tokens.finditer(text) if (k := self.kinds[m[1]])]
        flat, at, out = "".join(c for c, _ in chars), 0, []
        for m in self.lines.finditer(flat):
            out += chars[at : m.start()]
            if m[1]:
                out.append((";", chars[m.start()][1]))
            at = m.end()
        return self._fail(text, out + chars[at:], "File", self.grammar)


# ---------------------------------------------------------------- ECMAScript
JS_KEYWORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch throw try typeof var void while with"
JS_VALUES = "this null true false enum"
JS_NAMES = "async as from get set of let static await yield"
JS_OPERATORS = "... => ?. ?? == != === !== <= >= && || << >> >>> ** ++ -- += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ? ~ @"
_TEMPLATE = r"""`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`'"/\\\n]*\})*`"""


class JavaScript(Json):
    _space = r"[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]"
    _ident = r"(?:[^\W\d]|[$℘℮]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d\u00b7]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
    _regex = r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/\w*"
    _rest = (
        r"""//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*+\*/|[\n\r\u2028\u2029]|#?(?:""" + _ident + r""")"""
        r"""|(?:0[xX][0-9a-fA-F_]*|0[bB][01_]*|0[oO][0-7_]*|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)n?\w*"""
        r"""|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|""" + _TEMPLATE
        + r"""|>>>=|\.\.\.|===|!==|>>>|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?![0-9])|\?\?|==|!=|<=|>=|&&|\|\||<<|>>|\*\*|\+\+|--|[-+*/%&|^]=|/\*|[\s\S]"""
    )
    #: a slash after these signs, and at most one blank, begins a regular expression
    _sure = r"(?:(?<=[(,=:\[!&|?;~^*%<>{])|(?<=[(,=:\[!&|?;~^*%<>{] ))" + _regex
    tokens = re.compile(_space + "*(" + _sure + "|" + _rest + ")")
    slow = re.compile(_space + "*(" + _rest + ")")
    regex = re.compile(_regex)
    _number = re.compile(
        r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|0|[1-9](?:_?[0-9])*)n?|0[0-9]+|(?:(?:0|[1-9](?:_?[0-9])*)\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*|(?:0|[1-9](?:_?[0-9])*))(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
    )
    _string = re.compile(r"(?:[^\\]|\\(?:[^xu0-9]|[0-7]|[89]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\}))*")
    _flags = re.compile(r"(?!.*(.).*\1)[dgimsuvy]*")

    def __init__(self) -> None:
        Language.__init__(self)
        words = _alphabet(f"{JS_KEYWORDS} {JS_VALUES} {JS_NAMES}", JS_OPERATORS)
        many = lambda t: "".join(words[x] for x in t.split())
        names = "a" + many("async as from get set of let static")
        bind = {"BIND": names + many("await yield")} | {f"BIND{c}": names + ("" if c in "MAH" else words["await"]) + ("" if c in "GH" else words["yield"]) for c in "SMFAGH"}
        classes = {
            "PROP": "a" + many(f"{JS_KEYWORDS} {JS_VALUES} {JS_NAMES}"), "NL": "\n", "STR": '"', "NUM": "0", "TEMPLATE": "`", "PRIVATE": "#",
            "VALUE": '0"/r'.replace("/", "") + many("this null true false"),
            "BINARY": many("?? == != === !== <= >= && || << >> >>> ** + - * / % & | ^ < > in instanceof"),
            "UNARY": many("delete void typeof + - ~ ! ++ --"),
            "ASSIGN": many("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??="),
            **bind,
        }
        self.words = words
        self.grammar = Grammar(grammars.javascript(), words, classes, self.groups, grammars.MEMO["javascript"])
        for c in "SMFAGH":
            for rule, name in ((f"Statement{c}", f"Statements{c}"), (f"Clause{c}", f"Clauses{c}"), (f"ClassItem{c}", f"ClassItems{c}")):
                add_list(self.grammar, rule, name)
        self.kinds = _Kinds({**words, "\n": "\n", "\r": "\n", "\u2028": "\n", "\u2029": "\n", "`": ERR, "@": ERR}, self._classify)
        self.inner: dict[str, bool] = {}
        ends = re.escape('a0"`r#)]}' + many("this null true false ++ -- async as from get set of let static await yield"))
        starts = re.escape('a0"`r#{!~@' + many("++ -- this null true false async as from get set of let static await yield break case class const continue debugger default delete do else export for function if import new return super switch throw try typeof var void while with finally"))
        held = re.escape(many("return break continue throw"))
        #: a line end matters only between a token that can end a statement and one that can begin one
        self.lines = re.compile(f"(?:(?<=[{held}])|(?<=[{ends}])(?=\n+[{starts.replace('`', '')}]))(\n)\n*|\n+")
        self.ends = set('a0"`r#)]}') | set(many("this null true false super async as from get set of let static await yield ++ --"))
        self.heads = set(many("if while for with"))

    def _classify(self, t: str) -> str:
        c = t[0]
        if c in "\"'":
            return '"' if len(t) > 1 and self._string.fullmatch(t[1:-1]) else ERR
        if c == "/":
            if t.startswith("//"):
                return ""
            if t.startswith("/*"):
                return ERR if len(t) < 4 else "\n" if re.search("[\n\r\u2028\u2029]", t) else ""
            return "r" if self._flags.fullmatch(t[t.rindex("/") + 1 :]) else ERR
        if c == "`":
            return "`" if all(map(self._expression, re.findall(r"(?<!\\)\$\{([^{}]*)\}", t))) else ERR
        if c.isdigit() or c == "." and len(t) > 1:
            return "0" if self._number.fullmatch(t) else ERR
        if c == "#":
            return "#" if len(t) > 1 and not t[1].isdigit() else ERR
        return "a" if c in "_$\\℘℮" or c.isalpha() else ERR

    def _expression(self, t: str, awaits: str = "A") -> bool:
        """Is the text between the braces of a template an expression?"""
        found = self.inner.get(t)
        if found is None:
            chars = self._slowly(t)
            s = fold(self.lines.sub(lambda m: "\n" if m[1] else "", "".join(c for c, _ in chars)), self.groups)
            found = ERR not in s and any(self.grammar.whole(r, s + END) for r in ("ExprF", "ExprA", "ExprG"))
            if len(t) < 60 and len(self.inner) < 100_000:
                self.inner[t] = found
        return found

    def _template(self, text: str, at: int) -> tuple[str, int]:
        """Kind and end of the template that begins at text[at]."""
        k, ok, n = at + 1, True, len(text)
        while k < n and text[k] != "`":
            if text[k] == "\\":
                k += 2
            elif text.startswith("${", k):
                chars = self._slowly(text, k + 2, True)
                end = chars.pop()[1]
                inner = self.lines.sub(lambda m: "\n" if m[1] else "", "".join(c for c, _ in chars))
                s = fold(inner, self.groups)
                ok = ok and ERR not in s and any(self.grammar.whole(r, s + END) for r in ("ExprF", "ExprA", "ExprG"))
                k = end + 1
            else:
                k += 1
        return ("`" if ok and k < n else ERR), min(k + 1, n)

    def _slowly(self, text: str, at: int = 0, inner: bool = False) -> list[tuple[str, int]]:
        """Kinds with offsets, each slash read by what stands before it.

        With ``inner``, up to the brace that closes a template's expression; the
        last item then gives that brace.
        """
        out: list[tuple[str, int]] = []
        depth, before, stack, after_head = 0, "", [], False
        n = len(text)
        while at < n:
            m = self.slow.match(text, at)
            if not m:
                break
            start, t = m.start(1), m[1]
            at = m.end()
            c = t[0]
            if c == "`":
                kind, at = self._template(text, start)
            elif c == "/" and t in ("/", "/=") and (before not in self.ends or before == ")" and after_head or before == "") and (r := self.regex.match(text, start)):
                kind, at = self._classify(r[0]), r.end()
            else:
                kind = self.kinds[t]
            if not kind:
                continue
            if kind in "([{" and len(kind) == 1:
                stack.append(before in self.heads and kind == "(")
                depth += 1
            elif kind in (")", "]", "}"):
                after_head = stack.pop() if stack else False
                depth -= 1
                if inner and depth < 0:
                    return [*out, ("}", start)]
            out.append((kind, start))
            if kind != "\n":
                before = kind
        return [*out, (ERR, n)] if inner else out

    def check(self, text: str, kind: str = "js") -> Verdict:
        self.tidy()
        if len(self.inner) > 90_000:
            self.inner.clear()
        if text[:1] == "\ufeff":
            text = " " + text[1:]
        if text[:2] == "#!":
            end = re.search("[\n\r\u2028\u2029]|$", text).start()
            text = " " * end + text[end:]
        text = text.rstrip(" \t\r\n")
        rules = {"js": ("Script", "Module"), "cjs": ("Script",), "mjs": ("Module",)}[kind]
        s = "".join(map(self.kinds.__getitem__, self.tokens.findall(text)))
        s = fold(self.lines.sub(lambda m: "\n" if m[1] else "", s), self.groups)
        if any(self.grammar.whole(r, s + END) for r in rules):
            return VALID
        chars = self._slowly(text)
        flat, at, out = "".join(c for c, _ in chars), 0, []
        for m in self.lines.finditer(flat):
            out += chars[at : m.start()]
            if m[1]:
                out.append(("\n", chars[m.start()][1]))
            at = m.end()
        chars = out + chars[at:]
        s = fold("".join(c for c, _ in chars), self.groups)
        if any(self.grammar.whole(r, s + END) for r in rules):
            return VALID
        return max((self._fail(text, chars, r, self.grammar) for r in rules), key=lambda v: v[1])


# ---------------------------------------------------------------- Python
PY_WORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False match case type"
PY_OPERATORS = "... -> := == != <= >= << >> ** // += -= *= /= //= %= @= &= |= ^= <<= >>= **= + - * / % @ & | ^ ~ < > = ( ) [ ] { } , ; . :"
INDENT0 = 0xE000
_F_SIMPLE = r"(?:[^{q}\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|\{{[^{{}}\"'\\\n]*\}})*"


class Python(Json):
    _fq = r"(?:[fF][rR]?|[rR][fF])"
    _sq = r"(?:[rR]|[uU]|[bB][rR]?|[rR][bB])?"
    _line = r"(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t\f]*"
    tokens = re.compile(
        r"""(?:[ \t\f]|\\\n)*("""
        + r"\#[^\n]*|\n" + _line
        + r"|" + _fq + r"\"\"\"(?:[^\\{}\"]|\\[\s\S]|\{\{|\}\}|\{[^{}\"'\\\n]*\}|\"(?!\"\"))*\"\"\"|" + _fq + r"'''(?:[^\\{}']|\\[\s\S]|\{\{|\}\}|\{[^{}\"'\\\n]*\}|'(?!''))*'''"
        + r"|" + _fq + r"\"(?!\"\")" + _F_SIMPLE.format(q='"') + r"\"|" + _fq + r"'(?!'')" + _F_SIMPLE.format(q="'") + "'"
        + r"|" + _fq + r"(?:\"\"\"|'''|\"|')"
        + r"|" + _sq + r"(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')"
        + r"|[^\W\d]\w*"
        + r"|(?:0[xX][0-9a-fA-F_]*|0[bB][0-9_]*|0[oO][0-9_]*|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?)[jJ]?(?:(?!(?:and|else|for|if|in|is|not|or)\b)\w)*"
        + r"|\.\.\.|->|:=|\*\*=|//=|<<=|>>=|==|!=|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^]=|[\s\S])"
    )
    _number = re.compile(
        r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)|[0-9](?:_?[0-9])*[jJ]|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*[jJ]?"
    )
    _heads = (("if", "IfHead", "I"), ("elif", "ElifHead", "E"), ("else", "ElseHead", "L"), ("for", "ForHead", "F"), ("while", "WhileHead", "W"), ("try", "TryHead", "T"), ("except", "ExceptHead", "X"), ("finally", "FinallyHead", "Y"), ("with", "WithHead", "H"), ("def", "DefHead", "D"), ("class", "ClassHead", "K"))
    _split = re.compile("[\ue000-\uf8ff]")

    def __init__(self) -> None:
        Language.__init__(self)
        words = _alphabet(PY_WORDS, PY_OPERATORS)
        many = lambda t: "".join(words[x] for x in t.split())
        classes = {"NAME": "a" + many("match case type"), "NUM": "0", "STR": '"f', "BYTES": "y", "AUG": many("+= -= *= /= //= %= @= &= |= ^= <<= >>= **=")}
        heads = "".join(f"{r}B <- {r} Open\n{r}T <- {r} Tail\n" for _, r, _ in (*self._heads, ("", "MatchHead", ""), ("", "CaseHead", "")))
        self.words = words
        self.grammar = Grammar(grammars.PYTHON_LINE + heads, words, classes, self.groups, grammars.MEMO["python"])
        self.blocks = Groups()
        self.layout = Grammar(grammars.PYTHON_BLOCK, {c: c for c in "sIiEeLlFfWwTtXxYyHhDdKkMmCc@"}, {}, self.blocks)
        self.kinds = _Kinds(dict(words), self._classify)
        self.heads = {words[w]: (rule, letter) for w, rule, letter in self._heads}
        self.lines: dict[str, str] = {}
        self.inner: dict[str, bool] = {}
        self.indents: dict[str, str] = {}
        self.widths: list[tuple[int, int]] = []

    def all_grammars(self) -> list[Grammar]:
        return [self.grammar, self.layout]

    def tidy(self) -> None:
        super().tidy()
        if self.blocks.full():
            self.blocks.clear()
            self.layout.forget()
        if len(self.lines) > 300_000 or not self.groups.content:
            self.lines.clear()
        if len(self.inner) > 100_000:
            self.inner.clear()
        if len(self.indents) > 4000:
            self.indents.clear()
            self.widths.clear()
            self.kinds.clear()
            self.kinds.update(self.kinds.fixed)

    def _indent(self, t: str) -> str:
        blank = t[t.rindex("\n") + 1 :]
        blank = blank[blank.rfind("\f") + 1 :]
        kind = self.indents.get(blank)
        if kind is None:
            wide = narrow = 0
            for c in blank:
                wide = (wide // 8 + 1) * 8 if c == "\t" else wide + 1
                narrow += 1
            kind = self.indents[blank] = chr(INDENT0 + len(self.indents))
            self.widths.append((wide, narrow))
        return kind

    def _classify(self, t: str) -> str:
        c = t[0]
        if c == "\n":
            return self._indent(t)
        if c == "#":
            return ""
        if t[-1] in "\"'":
            m = re.match(r"[A-Za-z]*", t)
            p = m[0].lower()
            body = t[m.end() :]
            if len(body) < 2 or "f" in p and body in ('"', "'", '"""', "'''"):
                return ERR
            if "\0" in t:
                return ERR
            if "f" in p:
                q = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
                return "f" if all(map(self._field, re.findall(r"\{\{|\}\}|\{([^{}]*)\}", body[q:-q]))) else ERR
            if "b" in p:
                return "y" if body.isascii() else ERR
            if "r" not in p and "\\" in body and not re.fullmatch(r"(?:[^\\]|\\(?:[^xuUN]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U00(?:10|0[0-9a-fA-F])[0-9a-fA-F]{4}|N\{[^}]+\}))*", body):
                return ERR
            return '"'
        if c.isdigit() or c == "." and len(t) > 1:
            return "0" if self._number.fullmatch(t) else ERR
        return "a" if t.isidentifier() else ERR

    def _field(self, t: str) -> bool:
        """Is the text between the braces of an f-string a field? Nothing stands for doubled braces."""
        if not t:
            return True
        found = self.inner.get(t)
        if found is None:
            found = self.inner[t] = self._field_ok(t)
        return found

    def _field_ok(self, t: str) -> bool:
        depth, end = 0, len(t)
        for m in re.finditer(r"[()\[\]{}]|!=|==|[!:=]|\blambda\b", t):
            c = m[0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif depth == 0 and c in (":", "!"):
                end = m.start()
                break
        e = t[:end]
        if t[end : end + 1] == "!" and not re.fullmatch(r"!\s*[rsa]\s*(?::[\s\S]*)?", t[end:]):
            return False
        e = re.sub(r"(?<![=!<>:])=\s*$", "", e)
        s = "".join(self.kinds[x] for x in self.tokens.findall(e.strip()))
        s = self._split.sub("", fold(s, self.groups, self._split))
        return any(self.grammar.whole(r, s + END) for r in ("StarExprs", "Yield"))

    def _fstring(self, text: str, at: int, token: str) -> tuple[str, int]:
        """Kind and end of an f-string with nested quotes or braces that begins at text[at]."""
        q = token.lstrip("fFrR")
        raw = "r" in token.lower()
        return self._fbody(text, at + len(token), q, raw, 0)

    def _fbody(self, text: str, k: int, q: str, raw: bool, depth: int) -> tuple[str, int]:
        n, ok = len(text), True
        while k < n:
            c = text[k]
            if depth == 0 and text.startswith(q, k):
                return ("f" if ok else ERR), k + len(q)
            if depth and c == "}":
                return ("f" if ok else ERR), k
            if c == "\n" and len(q) == 1:
                return ERR, k
            if c == "\\" and (not raw or text[k + 1 : k + 2] in (q[0], "\\", "\n")):
                if text.startswith("\\N{", k):
                    k = text.find("}", k) + 1 or n
                else:
                    k += 2
            elif c in "{}" and text[k + 1 : k + 2] == c and depth == 0:
                k += 2
            elif c == "}":
                ok = False
                k += 1
            elif c == "{":
                start, level = k + 1, 0
                k += 1
                while k < n:
                    m = self.tokens.match(text, k)
                    if not m:
                        return ERR, n
                    t, s0 = m[1], m.start(1)
                    if t[0] in "fFrR" and t.lower().rstrip("\"'") in ("f", "fr", "rf") and t[-1] in "\"'" and len(t.lstrip("fFrR")) in (1, 3):
                        kind, k = self._fbody(text, m.end(), t.lstrip("fFrR"), "r" in t.lower(), 0)
                        if kind == ERR:
                            return ERR, k
                        continue
                    if level == 0 and t in ("}", ":", "!") or level == 0 and t == ":=":
                        k = s0
                        break
                    level += (t in "([{" and len(t) == 1) - (t in ")]}" and len(t) == 1)
                    k = m.end()
                    if level < 0:
                        return ERR, n
                expr = text[start:k]
                ok = ok and bool(expr.strip()) and self._nested(expr)
                if text[k : k + 1] == "!":
                    m = re.compile(r"!\s*[rsa]\s*").match(text, k)
                    if not m:
                        return ERR, n
                    k = m.end()
                if text[k : k + 1] == ":":
                    kind, k = self._fbody(text, k + 1, q, raw, depth + 1)
                    ok = ok and kind != ERR
                if text[k : k + 1] != "}":
                    return ERR, k
                k += 1
            else:
                k += 1
        return ERR, n

    def _nested(self, e: str) -> bool:
        e = re.sub(r"(?<![=!<>:])=\s*$", "", e)
        s = "".join(c for c, _ in self._chars(e.strip()))
        s = self._split.sub("", fold(s, self.groups, self._split))
        return any(self.grammar.whole(r, s + END) for r in ("StarExprs", "Yield"))

    def _chars(self, text: str) -> list[tuple[str, int]]:
        out, at, n = [], 0, len(text)
        while at < n:
            m = self.tokens.match(text, at)
            if not m:
                break
            t, start = m[1], m.start(1)
            at = m.end()
            if t[0] in "fFrR" and t[-1] in "\"'" and t.lower().rstrip("\"'") in ("f", "fr", "rf") and len(t.lstrip("fFrR")) in (1, 3):
                kind, at = self._fstring(text, start, t)
            else:
                kind = self.kinds[t]
            if kind:
                out.append((kind, start))
        return out

    def _letter(self, s: str) -> str:
        """Class of a logical line; empty if it isn't valid."""
        known = self.lines.get(s)
        if known is not None:
            return known
        g, w = self.grammar, self.words
        t = s + END
        c = s[0]
        head = self.heads.get(s[1] if c == w["async"] and len(s) > 1 else c)
        if head and not (c == w["async"] and head[1] not in "FHD"):
            rule, letter = head
            found = letter if g.whole(rule + "B", t) else letter.lower() if g.whole(rule + "T", t) else ""
        elif c == "@":
            found = "@" if g.whole("Decorator", t) else ""
        elif g.whole("Line", t):
            found = "s"
        elif c == w["match"]:
            found = "M" if g.whole("MatchHeadB", t) else ""
        elif c == w["case"]:
            found = "C" if g.whole("CaseHeadB", t) else "c" if g.whole("CaseHeadT", t) else ""
        else:
            found = ""
        self.lines[s] = found
        return found

    def _layout(self, first: str, parts: list[str], marks: list[str]) -> tuple[bool, int, str]:
        """(valid, number of the failing line, cause); marks are the lines' indents."""
        intern, stack, widths = self.blocks.intern, [(0, 0)], self.widths
        open_: list[list[str]] = [[]]
        for k, s in enumerate(parts):
            if not s:
                continue
            here = widths[ord(marks[k]) - INDENT0]
            top = stack[-1]
            if here != top:
                if here[0] > top[0]:
                    if here[1] <= top[1] or not open_[-1] or not open_[-1][-1].isupper():
                        return False, k, "indentation"
                    stack.append(here)
                    open_.append([])
                else:
                    while stack[-1][0] > here[0]:
                        stack.pop()
                        block = open_.pop()
                        open_[-1].append(intern("BRACE", "".join(block)))
                    if stack[-1] != here:
                        return False, k, "indentation"
            letter = self._letter(s)
            if not letter:
                return False, k, ""
            if open_[-1] and open_[-1][-1] in "IELFWTXYHDKMC":
                return False, k, "missing block"
            open_[-1].append(letter)
        if open_[-1] and open_[-1][-1] in "IELFWTXYHDKMC":
            return False, len(parts), "missing block"
        while len(open_) > 1:
            block = open_.pop()
            open_[-1].append(intern("BRACE", "".join(block)))
        s = "".join(open_[0]) + END
        if self.layout.whole("Top", s):
            return True, 0, ""
        return False, -1, "statement order"

    def check(self, text: str) -> Verdict:
        self.tidy()
        if text[:1] == "\ufeff":
            text = text[1:]
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            return Verdict(False, text.index("\0"), "bad token")
        body = "\n" + text.rstrip(" \t\f\n")
        if text.endswith("\\") or body.endswith("\\"):
            return Verdict(False, len(text), "unexpected end")
        toks = self.tokens.findall(body)
        kinds = "".join(map(self.kinds.__getitem__, toks))
        if ERR in kinds:
            chars = self._chars(body)
            kinds = "".join(c for c, _ in chars)
        if (deep := _too_deep(kinds)) is not None:
            return Verdict(False, self._chars(body)[deep][1], "too many nested brackets")
        s = fold(kinds, self.groups, self._split)
        if s:
            parts = self._split.split(s)[1:]
            marks = self._split.findall(s)
            if ERR not in s:
                ok, line, cause = self._layout("", parts, marks)
                if ok:
                    return VALID
        else:
            return VALID
        # the failing place
        chars = self._chars(body)
        broken = next((at for c, at in chars if c == ERR), None)
        first_bad = unbalanced("".join(c for c, _ in chars))
        if broken is not None and (first_bad is None or broken <= chars[first_bad[0]][1]):
            return Verdict(False, broken - 1, self._cause(text, broken - 1, "bad token"))
        if first_bad:
            at = chars[first_bad[0]][1]
            return Verdict(False, (len(text) if first_bad[1] == "unclosed bracket" else at - 1), self._cause(text, at - 1, first_bad[1]))
        nodes = self._tree(chars, self._split)
        rows: list[list] = []
        for node in nodes:
            if self._split.match(node[0]):
                rows.append([])
            else:
                rows[-1].append(node)
        if not 0 <= line < len(rows) or not rows[line]:
            at = len(text) if line >= 0 else self._order(rows, marks)
        elif cause:
            at = rows[line][0][1] - 1
        else:
            first = rows[line][0][0]
            head = self.heads.get(first)
            end = rows[line][-1][3] + 1
            at = max(self._locate(self.grammar, r, rows[line], end) for r in ([head[0] + "B", head[0] + "T"] if head else ["Line"])) - 1
        return Verdict(False, at, self._cause(text, at, cause or "unexpected token"))

    def _order(self, rows: list, marks: list) -> int:
        """Offset of the first head that has nothing before it to belong to, at any depth."""
        follows = {"E": "IiEe", "L": "IiEeFfWwXx", "X": "TtXx", "Y": "TtXxLl", "C": "MCc"}
        last: dict[int, str] = {}
        for row, mark in zip(rows, marks):
            if not row:
                continue
            width = self.widths[ord(mark) - INDENT0][0]
            letter = self._letter("".join(n[0] for n in row))
            if (need := follows.get(letter.upper())) and last.get(width, "") not in need and letter.upper() != "C":
                return row[0][1] - 1
            last = {w: x for w, x in last.items() if w < width} | {width: letter or "s"}
        return rows[-1][0][1] - 1 if rows[-1] else 0


#: Fixed value: brackets that Python nests at most.
PYTHON_LEVELS = 200


def _too_deep(kinds: str) -> int | None:
    """Position of the first bracket beyond PYTHON_LEVELS."""
    if sum(map(kinds.count, "([{")) <= PYTHON_LEVELS:
        return None
    depth = 0
    for k, c in enumerate(kinds):
        depth += (c in "([{") - (c in ")]}")
        if depth > PYTHON_LEVELS:
            return k
    return None


_LANGUAGES: dict[str, Language] = {}


def language(name: str) -> Language:
    """The checker of a language; one per worker process."""
    if name not in _LANGUAGES:
        _LANGUAGES[name] = {"python": Python, "go": Go, "javascript": JavaScript, "json": Json}[name]()
    return _LANGUAGES[name]


def check(name: str, text: str) -> Verdict:
    """Verdict on a text; name is python, go, js, mjs, cjs or json."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, FRAMES))
    try:
        v = language("javascript").check(text, name) if name in ("js", "mjs", "cjs") else language(name).check(text)
    finally:
        sys.setrecursionlimit(limit)
    return _within(v, len(text))


#: Extensions (small letters) of the languages.
EXTENSIONS = {"py": "python", "pyw": "python", "pyi": "python", "go": "go", "js": "js", "mjs": "mjs", "cjs": "cjs", "json": "json"}


def kind_of(path: str | None, text: str) -> str | None:
    """The language that a file's extension stands for, without one that of its first line."""
    base = (path or "").rsplit("/", 1)[-1]
    dot = base.rfind(".")
    if dot > 0:
        return EXTENSIONS.get(base[dot + 1 :].lower())
    first = text.lstrip("\ufeff").split("\n", 1)[0]
    if first.startswith("#!"):
        if re.search(r"\bpython[\d.]*\b", first):
            return "python"
        if re.search(r"\b(?:node|nodejs|deno|bun)\b", first):
            return "js"
    return None


def line_of(text: str, at: int) -> int:
    """Number of the line, from 1, that an offset lies in."""
    return text.count("\n", 0, max(at, 0)) + 1


def starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_at(begins: list[int], at: int) -> int:
    return bisect_right(begins, at)


_ = BRACE0
