"""Files that nobody wrote by hand for their project.

Three kinds of evidence, each from the whole content:

* third-party code: token streams without comments are fingerprinted by
  winnowing, and a file whose fingerprints largely recur in several other
  projects is a copy, whatever its head says;
* output of a tool: a mark that it must not be edited, or a body that repeats
  one form, for which a head that speaks of a tool is one more sign;
* minified or bundled code, data and lock contents, by measures of the text:
  length of lines, blanks, names, literals and their entropy, lock keys.

Directory names alone decide nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import keyed_join
from ..session import written
from . import syntax

#: Tokens of a fingerprint, and fingerprints of a window of which the least is kept.
SHINGLE, WINDOW = 30, 16
#: Projects that must have a fingerprint, the share of a file's fingerprints that must be such (as a fraction), and the least number of them.
PROJECTS, SHARE, LEAST = 3, (2, 3), 8
#: Projects that must have the whole token stream of a file with fewer fingerprints; more, as short files repeat by chance.
SHORT_PROJECTS = 5
#: In a directory for third-party code, one other project and one fingerprint are enough.
MARKED_PROJECTS = 2
MARKED = re.compile(r"(?:^|/)(?:_?vendor|third[_-]?party|node_modules|bower_components|externs?|externals?|deps)/")

_STRING = r"""\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_TOKENS = {
    "python": re.compile(r"(\#[^\n]*|" + _STRING + r"|\w+(?:\.\d+)?|[^\w\s])"),
    "c": re.compile(r"(//[^\n]*|/\*[\s\S]*?\*/|" + _STRING + r"|`[^`]*`|\w+(?:\.\d+)?|[^\w\s])"),
    "js": re.compile(r"(//[^\n]*|/\*[\s\S]*?\*/|" + syntax.JavaScript._sure + "|" + _STRING + r"|`(?:[^`\\]|\\[\s\S])*`|\w+(?:\.\d+)?|[^\w\s])"),
}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_COMMENT = {"python": ("#",), "c": ("//", "/*"), "js": ("//", "/*")}


class _Hashes(dict):
    """A number for each token that is the same in every process; -1 for comments."""

    def __init__(self, comment: tuple[str, ...]):
        super().__init__()
        self.comment = comment

    def __missing__(self, t: str) -> int:
        if t.startswith(self.comment):
            return -1
        if t[0] in "\"'":
            t = '"' + t.strip("\"'") + '"'
        b = t.encode("utf-8", "surrogatepass")
        h = int.from_bytes(blake2b(b, digest_size=8).digest(), "little") >> 1
        if len(t) < 40:
            if len(self) > 300_000:
                self.clear()
            self[t] = h
        return h


_HASHES = {k: _Hashes(v) for k, v in _COMMENT.items()}


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Winnowed fingerprints of a token stream, each once; none if it is shorter than a shingle."""
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        t = hashes.astype(np.uint64)
        acc = t[:n].copy()
        for j in range(1, SHINGLE):
            acc *= _BASE
            acc += t[j : n + j]
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    if n > WINDOW:
        acc = np.lib.stride_tricks.sliding_window_view(acc, WINDOW).min(axis=1)
    else:
        acc = acc.min(keepdims=True)
    return np.unique(acc).view(np.int64)


#: Marks of generated files, and orders not to edit them, in several languages.
MARK = re.compile(
    r"(?i)\bcode generated\b.*\bdo not edit\b|(?:^|\W)@generated\b|<auto-generated|\bautogenerated file\b|\bdo not (?:edit|modify|change)\b|\bdon'?t edit\b|\bedits? will be (?:lost|overwritten)\b|\bchanges (?:are|will be) lost\b"
    r"|nicht von hand (?:bearbeiten|ändern)|ne pas (?:modifier|éditer)|no (?:editar|modificar)\b|non modificare|не редактировать|请勿(?:修改|编辑)|編集しないで"
)
#: Words that say a file came from a tool, which hand-written files also use when they speak of it.
SAYS = re.compile(
    r"(?i)\bauto-?generated\b|\bautomatically (?:generated|produced|created|written|built)\b|\b(?:generated|produced|created|written|built) (?:automatically|by|from|on)\b|\bmachine[- ](?:made|generated|written)\b|\b(?:file|module|code|script|source) (?:was|is|has been) (?:generated|produced|emitted)\b|\bregenerate with\b"
    r"|automatisch (?:erzeugt|generiert|erstellt)|\bwurde von \S+ erzeugt\b|généré (?:automatiquement|par)|generado (?:automáticamente|por)|gerado automaticamente|сгенерирован|自动生成|自動生成"
)
#: Share of the rows of the two most frequent forms from which a body is one form again and again, alone and under a head that says so.
REPEATED, REPEATED_SAID = 0.8, 0.6
#: Share of a file in literals from which they are its content, and bits a character from which a literal is no text.
CONTENT, BITS = 0.6, 4.8
#: Least tokens of code that density and shares of tokens are measured on, and least literals of a table.
LEAST_TOKENS, LEAST_LITERALS = 30, 20
_LEADING = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/|'use strict';|\"use strict\";)*")
_LEADING_PY = re.compile(r"(?:\s+|\#[^\n]*)*")
#: Keys of lock files.
_LOCK = re.compile(r'"(?:lockfileVersion|integrity|resolved|_resolved|checksum|dependencies-meta)"')
_HEX = re.compile(r"[0-9a-fA-F]{64,}")
#: words of which data has none
_CODE_WORDS = frozenset(("def", "func", "function", "class", "lambda", "return"))


def head(kind: str, text: str) -> str:
    """The comments before a file's first code, a shebang not counted."""
    pattern = _LEADING_PY if kind == "python" else _LEADING
    start = text.find("\n") + 1 if text.startswith("#!") else 0
    return text[start : pattern.match(text, start).end()]


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values()) if n else 0.0


def _encoded(toks: list[str], n: int) -> bool:
    """Are literals that no one could read, such as encoded bytes, most of a text of n characters?"""
    literals = [t.strip("\"'`") for t in toks if t[0] in "\"'`"]
    if sum(map(len, literals)) <= CONTENT * n:
        return False
    whole = "".join(literals)
    return whole.count(" ") < 0.02 * len(whole) and (entropy(whole) >= BITS or bool(_HEX.fullmatch(whole)))


def shape(kind: str, text: str, toks: list[str]) -> str | None:
    """lock, data or minified, where measures of a text show that no hand wrote it; toks are its tokens without comments.

    Data are literals nobody could read, or hardly anything but literals.
    Minified code has long lines with hardly a blank and many names.
    """
    lines = text.count("\n") + 1
    n, code = len(text), len(toks)
    if kind == "json" and len(_LOCK.findall(text)) >= 5:
        return "lock"
    if _encoded(toks, n):
        return "data"
    if kind == "json":
        numbers = sum(1 for t in toks if t[0].isdigit())
        return "data" if numbers >= LEAST_LITERALS and numbers > 0.4 * code else None
    if code < LEAST_TOKENS:
        return None
    literals = sum(1 for t in toks if t[0].isdigit() or t[0] in "\"'`")
    marks = sum(1 for t in toks if t in ",[](){}-+.:=")
    names = code - literals - marks
    if literals >= LEAST_LITERALS and names <= 0.06 * code + 6 and _CODE_WORDS.isdisjoint(toks):
        return "data"
    blanks = n - len("".join(text.split()))
    if n / lines > 120 and blanks < 0.12 * n and names > 0.2 * code:
        return "minified"
    return None


_NUMBER = re.compile(r"\d+")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def _repeats(text: str, share: float = REPEATED) -> bool:
    """Is at least a share of the body one or two forms of a row again and again, with other names and rising numbers?"""
    rows = [r.strip() for r in text.split("\n")]
    rows = [r for r in rows if r and r not in "{}" and not r.startswith(("#", "//", "*", "/*"))]
    forms: dict[str, int] = {}
    for r in rows:
        f = _NUMBER.sub("0", _NAME.sub(lambda m: m[0] if m[0] in _KEYWORDS else "x", r))
        forms[f] = forms.get(f, 0) + 1
        if len(rows) - (len(forms) - 2) < share * len(rows):  # each form but two has a row that isn't of the top two
            return False
    top = sorted(forms.values(), reverse=True)[:2]
    if len(top) < 2 or min(top) < 5 or sum(top) < share * len(rows):
        return False
    return any("(" in f for f, k in forms.items() if k >= min(top))


def _generated(kind: str, comments: str, text: str) -> str | None:
    """generated or repeated, by the body's repetition with the head as one more sign."""
    if MARK.search(comments):
        return "generated"
    said = bool(SAYS.search(comments))
    if kind != "json" and _repeats(text, REPEATED_SAID if said else REPEATED):
        return "generated" if said else "repeated"
    return None


_KEYWORDS = frozenset("return if else for while def func function class self this nil null None type struct switch case var let const import from try catch except".split())


def examine(project: str, path: str | None, text: str | None) -> tuple[str | None, bool, np.ndarray, int | None]:
    """(reason or None, whether the path is one for third-party code, fingerprints, hash of the whole token stream) of a file.

    Null and blank contents have no reason and no fingerprints.  Only files
    with fingerprints, but fewer than LEAST, have a hash, and markup has none.
    """
    if not text or not text.strip():
        return None, False, np.zeros(0, np.int64), None
    kind = syntax.kind_of(path, text) or ("python" if text.startswith("#") else "c")
    family = "python" if kind == "python" else "js" if kind in ("js", "mjs", "cjs") else "c"
    raw = _TOKENS[family].findall(text)
    hashes = np.fromiter(map(_HASHES[family].__getitem__, raw), np.int64, len(raw))
    marks = _COMMENT[family]
    reason = _generated(kind, head(family, text), text) or shape(kind, text, [t for t in raw if not t.startswith(marks)])
    code = hashes[hashes >= 0]
    prints = fingerprints(code)
    short = 0 < len(prints) < LEAST and raw[int((hashes >= 0).argmax())] != "<"  # a page saved under a name of code is no code
    whole = int.from_bytes(blake2b(code.tobytes(), digest_size=8).digest(), "big", signed=True) if short else None
    return reason, bool(path and MARKED.search(path)), prints, whole


def examined(files: DataFrame) -> DataFrame:
    """file_id, project_id, reason, marked, n_prints, prints and whole of each row of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, projects, paths, texts = (c.to_pylist() for c in b.columns)
            got = [examine(p or "", a, t) for p, a, t in zip(projects, paths, texts)]
            prints = [g[2] for g in got]
            counts = np.fromiter(map(len, prints), np.int64, len(prints))
            flat = np.concatenate(prints) if prints else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int64()))
            columns = [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array(counts, pa.int32()), lists, pa.array([g[3] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "project_id", "reason", "marked", "n_prints", "prints", "whole"])

    return files.select("file_id", "project_id", "file_path", "content").mapInArrow(run, "file_id long, project_id string, reason string, marked boolean, n_prints int, prints array<long>, whole long")


def shared_prints(prints: DataFrame) -> DataFrame:
    """(print, n, many): fingerprints of at least two projects, their numbers of rows, and whether PROJECTS have them."""
    by_project = prints.groupBy("print", "project_id").agg(F.count(F.lit(1)).alias("n"))
    return by_project.groupBy("print").agg(F.count(F.lit(1)).alias("projects"), F.sum("n").alias("n")).where(F.col("projects") >= MARKED_PROJECTS).select("print", "n", (F.col("projects") >= PROJECTS).alias("many"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, reason) of each file that nobody wrote by hand for its project, once per file_id.

    A file is vendored if at least two thirds of its fingerprints, LEAST of
    them at least, are those of PROJECTS projects; other reasons count where it
    isn't.  Copies within one project don't make a file a copy.  Files too
    short to have LEAST fingerprints are copies if SHORT_PROJECTS have the same
    whole token stream; those shorter than a shingle never are.  Repeated rows
    count once.
    """
    # a number for each row, as file_id may come repeatedly
    seen = written(examined(files).withColumn("row", F.monotonically_increasing_id()))
    total, short = seen.agg(F.sum("n_prints"), F.count("whole")).first()
    keys = shared_prints(seen.select("project_id", F.explode("prints").alias("print")))
    found = keyed_join(seen.where("n_prints > 0").select("row", F.explode("prints").alias("print")), keys, ["print"], ("many",), total=total or 0)
    shared = found.groupBy("row").agg(F.count(F.lit(1)).alias("two"), F.count_if("many").alias("more"))
    largely = lambda c: F.col(c) * SHARE[1] >= F.col("n_prints") * SHARE[0]
    copy = ((F.col("more") >= LEAST) & largely("more")) | (F.col("marked") & largely("two"))
    wholes = seen.where("whole is not null").groupBy("whole", "project_id").agg(F.count(F.lit(1)).alias("n")).groupBy("whole").agg(F.count(F.lit(1)).alias("projects"), F.sum("n").alias("n"))
    again = keyed_join(seen.where("whole is not null and not marked").select("file_id", "whole"), wholes.where(F.col("projects") >= SHORT_PROJECTS).select("whole", "n"), ["whole"], total=short)
    copies = seen.select("file_id", "row", "marked", "n_prints").join(shared, "row").where(copy).select("file_id").unionByName(again.select("file_id"))
    reasons = copies.select("file_id", F.lit(True).alias("copy"), F.lit(None).cast("string").alias("reason")).unionByName(seen.where("reason is not null").select("file_id", F.lit(False).alias("copy"), "reason"))
    return reasons.groupBy("file_id").agg(F.when(F.max("copy"), F.lit("vendored")).otherwise(F.max("reason")).alias("reason"))
