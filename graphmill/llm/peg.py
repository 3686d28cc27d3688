"""Packrat parsing expression grammars over token strings.

A source text reaches this module as a *token string*: one character per token,
ending in ``END``.  Balanced bracket groups are folded, innermost first, into
single characters whose content is interned, so a nested text becomes a tree of
short flat strings.  A grammar rule then sees a whole group as one token and asks
whether its content matches another rule.

Two memo tables make this packrat parsing in linear time, and keep its results
between files of one worker:

* ``(rule, position)`` within one string, for rules that are tried again after
  backtracking;
* ``(rule, content)`` for bracket groups and for statements.  Syntax depends on
  token kinds only, so equal token strings always have equal results.  A
  statement's result is kept under a window of the string that covers every
  position which the parse has looked at.

Notation: ``Rule <- alternative / alternative``, with ``*  +  ?  &  !  ( )``,
``'literal'`` tokens, UPPER case token classes, ``PAREN[Rule]``, ``BRACK[Rule]``
and ``BRACE[Rule]`` for groups with the given content, ``PAREN`` and so on for
any such group, and ``Rule*list`` for a memoised statement list.
"""

from __future__ import annotations

import re

END = "\0"
PAREN0, BRACK0, BRACE0, TOP = 0x10000, 0x50000, 0x90000, 0xF0000
BASES = {"PAREN": PAREN0, "BRACK": BRACK0, "BRACE": BRACE0}
LIMITS = {"PAREN": BRACK0, "BRACK": BRACE0, "BRACE": TOP}
WINDOWS = (8, 20, 48)
#: Levels of brackets that are folded by regular expression, a pass each.
DEEP = 64
_TOKEN = re.compile(r"\s*(?:(<-)|'([^']+)'|([A-Z][A-Z0-9_]*)(?:\[(\w+)\])?(?![a-z\w])|([A-Z]\w*)|([/*+?&!()]))")


class Groups:
    """Interned contents of bracket groups; one table per worker and language.

    ``maximum`` bounds each kind; when it is reached the tables are cleared
    between two files, which only costs repeated work.
    """

    def __init__(self, maximum: int = 150_000):
        self.maximum = maximum
        self.ids: dict[str, dict[str, str]] = {k: {} for k in BASES}
        self.content: dict[str, str] = {}

    def intern(self, kind: str, content: str) -> str:
        table = self.ids[kind]
        found = table.get(content)
        if found is None:
            found = table[content] = chr(BASES[kind] + len(table))
            self.content[found] = content + END
        return found

    def full(self) -> bool:
        return any(len(t) > self.maximum for t in self.ids.values())

    def clear(self) -> None:
        for t in self.ids.values():
            t.clear()
        self.content.clear()


class Grammar:
    """A grammar compiled to one Python function per rule."""

    def __init__(self, text: str, literals: dict[str, str], classes: dict[str, str], groups: Groups, memo: str = "", drop: str = ""):
        self.literals, self.classes, self.groups = literals, classes, groups
        self.memo = set(memo.split())
        self.rules: dict[str, tuple] = {}
        self._n = 0
        self._inside: dict[str, set[str]] = {k: set() for k in BASES}
        self._sets: dict[frozenset, str] = {}
        self.env: dict = {"F": -1, "M": {}, "C": groups.content, "G": {}, "W": {}}
        self._read(text)
        source = "\n".join(self._function(k, e) for k, e in self.rules.items())
        self.env |= {v: frozenset(k) for k, v in self._sets.items()}
        exec(compile(_RUNTIME + source, "<grammar>", "exec"), self.env)  # noqa: S102
        self.drop = drop

    # ---- reading the notation
    def _read(self, text: str) -> None:
        text = re.sub(r"(?m)#.*$", "", text)
        toks, pos = [], 0
        text = text.rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos : pos + 40]!r}")
            pos = m.end()
            arrow, lit, upper, arg, rule, op = m.groups()
            toks.append(("arrow",) if arrow else ("lit", lit) if lit else ("cls", upper, arg) if upper else ("rule", rule) if rule else ("op", op))
        starts = [k for k in range(len(toks) - 1) if toks[k][0] in ("rule", "cls") and toks[k + 1][0] == "arrow"]
        for a, b in zip(starts, [*starts[1:], len(toks)]):
            self._t, self._p = toks[a + 2 : b], 0
            self.rules[toks[a][1]] = self._choice()
            if self._p != len(self._t):
                raise ValueError(f"grammar: rule {toks[a][1]}")

    def _peek(self) -> tuple:
        return self._t[self._p] if self._p < len(self._t) else ("end",)

    def _choice(self) -> tuple:
        alts = [self._seq()]
        while self._peek() == ("op", "/"):
            self._p += 1
            alts.append(self._seq())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def _seq(self) -> tuple:
        items = []
        while (t := self._peek())[0] != "end" and t not in (("op", "/"), ("op", ")")):
            pre = ""
            while self._peek() in (("op", "&"), ("op", "!")):
                pre += self._peek()[1]
                self._p += 1
            t = self._peek()
            self._p += 1
            if t == ("op", "("):
                e = self._choice()
                self._p += 1
            else:
                e = t
            while self._peek()[0] == "op" and self._peek()[1] in "*+?":
                e = ("rep", e, self._peek()[1])
                self._p += 1
            for c in reversed(pre):
                e = ("pred", e, c)
            items.append(e)
        return items[0] if len(items) == 1 else ("seq", items)

    # ---- code
    def _chars(self, e: tuple) -> str | None:
        if e[0] == "lit":
            return self.literals[e[1]]
        if e[0] == "cls" and e[2] is None and e[1] not in BASES:
            return END if e[1] == "END" else self.classes[e[1]]
        if e[0] == "choice":
            parts = [self._chars(x) for x in e[1]]
            return None if None in parts else "".join(parts)
        return None

    def _name(self) -> str:
        self._n += 1
        return f"b{self._n}"

    def _set(self, chars: str) -> str:
        return self._sets.setdefault(frozenset(chars), f"S{len(self._sets)}")

    def _code(self, e: tuple, pad: str, track: bool = False) -> list[str]:
        chars = self._chars(e)
        if chars is not None:
            test = f"s[i] == {chars!r}" if len(chars) == 1 else f"s[i] in {self._set(chars)}"
            return [f"{pad}if {test}: i += 1", f"{pad}else:", f"{pad}    if i > F: F = i", f"{pad}    i = -1"]
        kind = e[0]
        if kind == "cls":
            lo, hi = chr(BASES[e[1]]), chr(LIMITS[e[1]])
            if e[2] is not None:
                self._inside[e[1]].add(e[2])
            if e[2] is None:
                return [f"{pad}if {lo!r} <= s[i] < {hi!r}: i += 1", f"{pad}else:", f"{pad}    if i > F: F = i", f"{pad}    i = -1"]
            return [f"{pad}if {lo!r} <= s[i] < {hi!r} and (G[{e[2]!r}, s[i]] if ({e[2]!r}, s[i]) in G else group({e[2]!r}, s[i])): i += 1", f"{pad}else:", f"{pad}    if i > F: F = i", f"{pad}    i = -1"]
        if kind == "rule":
            return [f"{pad}i = r_{e[1]}(s, i)"]
        if kind == "seq":
            out: list[str] = []
            for x in e[1]:
                if out:
                    out.append(f"{pad}if i >= 0:")
                    pad += "    "
                out += self._code(x, pad)
            return out or [f"{pad}pass"]
        if kind == "choice":
            b = self._name()
            out = [f"{pad}{b} = i"]
            for k, x in enumerate(e[1]):
                if k:
                    out += [f"{pad}if i < 0:", f"{pad}    i = {b}"]
                    pad += "    "
                out += self._code(x, pad)
            return out
        if kind == "rep":
            b = self._name()
            if e[2] == "?":
                return [f"{pad}{b} = i", *self._code(e[1], pad), f"{pad}if i < 0: i = {b}"]
            chars = self._chars(e[1])
            out, inner = [], pad
            if e[2] == "+":
                out += self._code(e[1], pad)
                out.append(f"{pad}if i >= 0:")
                inner = pad + "    "
            if chars is not None:
                test = f"s[i] == {chars!r}" if len(chars) == 1 else f"s[i] in {self._set(chars)}"
                return out + [f"{inner}while {test}: i += 1", f"{inner}if i > F: F = i"]
            return out + [f"{inner}while True:", f"{inner}    {b} = i", *self._code(e[1], inner + "    "), f"{inner}    if i < 0:", f"{inner}        i = {b}", f"{inner}        break", f"{inner}    if i == {b}: break"]
        if kind == "pred":
            b = self._name()
            end = f"i = {b} if i < 0 else -1" if e[2] == "!" else f"i = {b} if i >= 0 else -1"
            return [f"{pad}{b} = i", *self._code(e[1], pad), f"{pad}if i > F: F = i", f"{pad}{end}"]
        raise ValueError(kind)

    def _function(self, name: str, e: tuple) -> str:
        body = self._code(e, "    ")
        if name in self.memo:
            return "\n".join([f"def r_{name}(s, i):", "    global F", f"    k = ({name!r}, i)", "    if k in M: return M[k]", *body, "    M[k] = i", "    return i"])
        return "\n".join([f"def r_{name}(s, i):", "    global F", *body, "    return i"])

    # ---- use
    def whole(self, rule: str, s: str) -> bool:
        """Does the rule consume all of s, a string ending in END?"""
        return self._run(rule, s)[0]

    def furthest(self, rule: str, s: str) -> int:
        return self._run(rule, s)[1]

    def _run(self, rule: str, s: str) -> tuple[bool, int]:
        try:
            return self.env["run"](rule, s)
        except RecursionError:
            self.env["F"], self.env["M"] = -1, {}
            self._settle(s)
            return self.env["run"](rule, s)

    def _settle(self, s: str) -> None:
        """Results of all groups below s, innermost first, so that none recurs into another: for texts nested deeply."""
        content, known = self.groups.content, self.env["G"]
        seen, todo = set(), [c for c in s if c in content]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += [d for d in content[c] if d in content and d not in seen]
        for c in [c for c in content if c in seen]:  # a group is interned after those inside it
            kind = next(k for k in BASES if BASES[k] <= ord(c) < LIMITS[k])
            for rule in self._inside[kind]:
                if (rule, c) not in known:
                    self.env["group"](rule, c)

    def failing(self, char: str) -> list[str]:
        """Rules that the content of a group was tried with, and that failed."""
        return [r for (r, c), ok in self.env["G"].items() if c == char and not ok]

    def forget(self) -> None:
        self.env["G"].clear()
        self.env["W"].clear()

    def crowded(self) -> bool:
        return len(self.env["W"]) > 400_000 or len(self.env["G"]) > 800_000


_RUNTIME = f'''
WINDOWS = {WINDOWS}
def run(rule, s):
    """(whole input consumed, furthest position that a test failed at)"""
    global F, M
    keep = F, M
    F, M = -1, {{}}
    i = globals()["r_" + rule](s, 0)
    ok = i >= len(s) - 1
    found = max(F, i)
    F, M = keep
    return ok, found
def group(rule, c):
    ok = G[rule, c] = run(rule, C[c])[0]
    return ok
def listed(rule, s, i):
    """One statement at i, from the memo of windows where possible."""
    global F, M
    for w in WINDOWS:
        got = W.get((rule, s[i:i + w]))
        if got is not None:
            n, f = got
            if i + f > F: F = i + f
            return i + n if n >= 0 else -1
    keep = F
    F = -1
    start = i
    i = globals()["r_" + rule](s, i)
    f = max(F, i) - start
    for w in WINDOWS:
        if f < w or start + w >= len(s):
            W[rule, s[start:start + w]] = (i - start if i >= 0 else -1), f
            break
    if keep > F: F = keep
    return i
'''


def statement_list(rule: str, name: str) -> str:
    """Source of r_name: as many statements of the rule as follow, each memoised by content."""
    return f"""
def r_{name}(s, i):
    while True:
        j = listed({rule!r}, s, i)
        if j < 0 or j == i: return i
        i = j
"""


def add_list(grammar: Grammar, rule: str, name: str) -> None:
    exec(compile(statement_list(rule, name), "<grammar>", "exec"), grammar.env)  # noqa: S102


_INNER = {"(": ("PAREN", ")"), "[": ("BRACK", "]"), "{": ("BRACE", "}")}
_FOLD = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
_KINDS = (None, "PAREN", "BRACK", "BRACE")


def fold(kinds: str, groups: Groups, strip: re.Pattern | None = None) -> str:
    """Balanced bracket groups of a token string as single characters, innermost first.

    Brackets that stay are unbalanced.  ``strip`` names characters that mean
    nothing inside brackets.
    """
    intern = groups.intern

    def one(m: re.Match) -> str:
        k = m.lastindex
        c = m[k]
        return intern(_KINDS[k], strip.sub("", c) if strip else c)

    for _ in range(DEEP):
        kinds, n = _FOLD.subn(one, kinds)
        if not n:
            return kinds
    # nested more deeply: one pass with a stack
    stack: list[tuple[str, list[str]]] = [("", [])]
    for c in kinds:
        if c in _INNER:
            stack.append((c, []))
        elif c in ")]}":
            opened, inside = stack.pop()
            if not stack or _INNER[opened][1] != c:
                return kinds
            whole = "".join(inside)
            stack[-1][1].append(intern(_INNER[opened][0], strip.sub("", whole) if strip else whole))
        else:
            stack[-1][1].append(c)
    return "".join(stack[0][1]) if len(stack) == 1 else kinds


def unbalanced(kinds: str) -> tuple[int, str] | None:
    """(position, cause) of the first bracket that has no partner."""
    stack: list[int] = []
    for m in re.finditer(r"[()\[\]{}]", kinds):
        c = m[0]
        if c in "([{":
            stack.append(m.start())
        elif stack and _INNER[kinds[stack[-1]]][1] == c:
            stack.pop()
        else:
            return m.start(), "unmatched bracket"
    return (stack[-1], "unclosed bracket") if stack else None
