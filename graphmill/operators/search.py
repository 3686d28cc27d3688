"""Ranked full-text search with a small query language over a stored index.

An index is a table of postings, sorted by corpus and term, with the term's
frequency and positions in a text and the text's length: a search reads the row
groups of its own terms only.  Scores are BM25 with statistics of the whole
corpus.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import corpus_of
from ..session import own_folder

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Columns of a node that its text is made of.
FIELDS = ("name", "qualified_name", "signature", "docstring")


def _plain_letters() -> tuple[str, str]:
    """Letters with accents and the letters without them, then the accents that stand alone."""
    letters = {}
    for k in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(k))
        if len(parts) > 1 and parts[0].isalnum() and all(unicodedata.combining(c) for c in parts[1:]):
            letters[chr(k)] = parts[0]
    marks = "".join(chr(k) for k in range(0x300, 0x370) if unicodedata.combining(chr(k)))
    return "".join(letters) + marks, "".join(letters.values())


_ACCENTS = _plain_letters()


def tokens(text: Column) -> Column:
    """Tokens of a text: runs of letters and digits in small letters without accents; empty for null."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_ACCENTS)
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


@dataclass(frozen=True)
class Term:
    """A word, a phrase of words, or the beginning of a word."""

    words: tuple[str, ...]
    prefix: bool = False


class SearchError(ValueError):
    """A text that can't be searched for, with advice."""


_PIECE = re.compile(r'"([^"]*)"|(\()|(\))|(\S+?)(?=[()\s]|$)')
_REGEX = re.compile(r"\.\*|\.\+|\[[^\]]*\]|\\[wdsb]|\^\w|\w\$(?=\s|$)|\(\?")
_OPERATORS = ("AND", "OR", "NOT")


def sanitize(query: str) -> str:
    """A query whose odd tokens are quoted, so that it can be parsed; empty if nothing is left.

    Apostrophes go; operators between operands stay; words with signs other
    than a final star are quoted; operators without operands are quoted too.
    """
    query = query.replace("'", " ")
    out: list[str] = []
    for m in re.finditer(r'"[^"]*"|\S+', query):
        t = m[0]
        if t.startswith('"') and t.endswith('"') and len(t) > 1:
            if t.strip('" '):
                out.append(t)
        elif t in _OPERATORS:
            out.append(t)
        elif re.fullmatch(r"\w+\*?", t):
            out.append(t)
        else:
            inner = t.replace('"', " ").strip()
            if any(c.isalnum() for c in inner):
                out.append(f'"{inner}"')
    fixed = []
    for k, t in enumerate(out):
        lone = t in _OPERATORS and (k == 0 or k == len(out) - 1 or out[k - 1] in _OPERATORS)
        fixed.append(f'"{t}"' if lone else t)
    return " ".join(fixed)


def _words(text: str) -> tuple[str, ...]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return tuple(w for w in re.split(r"[\W_]+", plain) if w)


class _Query:
    def __init__(self, text: str):
        if _REGEX.search(text):
            raise SearchError("this looks like a regular expression; use =~ in a pattern query instead")
        self.toks: list[tuple[str, str]] = []
        for m in _PIECE.finditer(sanitize(text) if not re.search(r"[()]", text) else text):
            if m[1] is not None:
                self.toks.append(("phrase", m[1]))
            elif m[2] or m[3]:
                self.toks.append(("op", m[0]))
            elif m[4] in _OPERATORS:
                self.toks.append(("op", m[4]))
            else:
                self.toks.append(("word", m[4]))
        self.p = 0
        self.tree = self.either() if self.toks else None

    def peek(self, op: str) -> bool:
        return self.p < len(self.toks) and self.toks[self.p] == ("op", op)

    def either(self):
        parts = [self.both()]
        while self.peek("OR"):
            self.p += 1
            parts.append(self.both())
        return ("or", parts)

    def both(self):
        parts, without = [self.atom()], []
        while self.p < len(self.toks) and not self.peek("OR") and not self.peek(")"):
            if self.peek("AND"):
                self.p += 1
            if self.peek("NOT"):
                self.p += 1
                without.append(self.atom())
            elif self.p < len(self.toks) and not self.peek("OR") and not self.peek(")"):
                parts.append(self.atom())
        return ("and", parts, without)

    def atom(self):
        if self.p >= len(self.toks):
            return ("none",)
        kind, text = self.toks[self.p]
        self.p += 1
        if kind == "op" and text == "(":
            inner = self.either()
            if self.peek(")"):
                self.p += 1
            return inner
        words = _words(text)
        return ("term", Term(words, kind == "word" and text.endswith("*"))) if words else ("none",)


def _terms(tree) -> list[Term]:
    if tree is None or tree[0] == "none":
        return []
    if tree[0] == "term":
        return [tree[1]]
    return [t for part in tree[1] for t in _terms(part)]


def _all_terms(tree) -> list[Term]:
    """Terms of a query with those behind NOT."""
    if tree is None or tree[0] == "none":
        return []
    if tree[0] == "term":
        return [tree[1]]
    return [t for part in [*tree[1], *(tree[2] if tree[0] == "and" else [])] for t in _all_terms(part)]


def _holds(tree, count) -> Column | None:
    if tree is None or tree[0] == "none":
        return None
    if tree[0] == "term":
        return count(tree[1]) > 0
    parts = [h for p in tree[1] if (h := _holds(p, count)) is not None]
    if tree[0] == "or":
        return reduce(lambda a, b: a | b, parts) if parts else None
    out = reduce(lambda a, b: a & b, parts) if parts else None
    for p in tree[2]:
        h = _holds(p, count)
        if h is not None:
            out = ~h if out is None else out & ~h
    return out


@dataclass
class Index:
    """A stored index: where it lies, and its postings and corpora (corpus, docs, mean) as tables."""

    path: str
    postings: DataFrame
    corpora: DataFrame


def build_index(texts: DataFrame, fields: tuple[str, ...], corpus: Column | None = None, folder: str | None = None, keep: tuple[str, ...] = ()) -> Index:
    """Writes the index of texts (project_id, id, the fields, the columns to keep) and opens it.

    It lies in ``folder`` to be kept, or with the application's own tables.

    Fields are told apart by a gap in positions, so no phrase spans two of
    them.  Null texts have no tokens but count as documents.
    """
    spark = texts.sparkSession
    path = f"{(folder or own_folder(spark)).rstrip('/')}/index-{uuid.uuid4().hex}"
    name = F.lit("docs") if corpus is None else corpus
    lists = [tokens(F.col(f)) for f in fields]
    gap = F.lit("")  # an empty token can't be asked for
    whole = F.concat(*[x for t in lists for x in (t, F.array(gap))])
    docs = texts.select("project_id", "id", *keep, name.alias("corpus"), whole.alias("__t"), reduce(lambda x, y: x + y, (F.size(t) for t in lists)).cast("int").alias("n"))
    docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean")).write.parquet(f"{path}/corpora")
    # one row per text and term; a text's own tokens are counted where it is read
    rows = docs.select("corpus", "project_id", "id", *keep, "n", F.posexplode("__t").alias("at", "term")).where("term <> ''")
    postings = rows.groupBy("corpus", "term", "project_id", "id", *keep, "n").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    postings.withColumn("tf", F.size("positions")).repartitionByRange(*(F.col(c) for c in ("corpus", "term", "project_id", "id"))).sortWithinPartitions("corpus", "term").write.option("parquet.block.size", str(16 << 20)).parquet(f"{path}/postings")
    return open_index(spark, path)


def open_index(spark, path: str) -> Index:
    return Index(path, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpora"))


def node_index(nodes: DataFrame, folder: str | None = None) -> Index:
    """The index of nodes in their three corpora, over FIELDS; rebuilding is building a new one."""
    return build_index(nodes, FIELDS, corpus_of(F.col("language"), F.col("kind")), folder, ("kind", "language", "name", "qualified_name", "extraction_confidence"))


def text_index(docs: DataFrame, text: str = "text", key: str = "id", folder: str | None = None) -> Index:
    return build_index(docs.select(F.lit("").alias("project_id"), F.col(key).alias("id"), F.col(text).alias("text")), ("text",), None, folder)


def _matches(t: Term) -> Column:
    """Does a posting belong to a term?"""
    if t.prefix:
        return F.startswith(F.col("term"), F.lit(t.words[0]))
    return F.col("term").isin(*t.words)


def _frequency(t: Term, k: int) -> Column:
    """How often a term is in the text of a group of postings."""
    if len(t.words) == 1:
        return F.coalesce(F.sum(F.when(_matches(t), F.col("tf"))), F.lit(0)).alias(f"__{k}")
    places = [F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))) for w in t.words]
    later = lambda p: reduce(lambda x, y: x & y, [F.array_contains(places[j], p + j) for j in range(1, len(places))])
    return F.size(F.filter(places[0], later)).cast("long").alias(f"__{k}")


def search(index: Index, query: str, corpus: str = "docs", limit: int | None = 20, where: Column | None = None) -> DataFrame:
    """(project_id, id, score) of the texts that match a query, best first, ties by id.

    Words are joined by AND; OR, NOT, "phrases" and prefix* work, with
    parentheses.  Statistics cover the whole corpus; ``where`` filters afterwards
    by the columns that the index keeps.  A query without words finds nothing.
    Null texts match nothing.
    """
    tree = _Query(query).tree
    scored = set(_terms(tree))
    terms = list(dict.fromkeys(_all_terms(tree)))
    mine = index.postings.where(F.col("corpus") == corpus)
    if not scored:
        return mine.where(F.lit(False)).select("project_id", "id", F.lit(0.0).alias("score"))
    kept = [c for c in index.postings.columns if c not in ("corpus", "term", "positions", "tf")]
    hit = mine.where(reduce(lambda x, y: x | y, (_matches(t) for t in terms)))
    rows = hit.groupBy(*kept).agg(*(_frequency(t, k) for k, t in enumerate(terms)))
    seen = rows.agg(*(F.count_if(F.col(f"__{k}") > 0).alias(f"df{k}") for k in range(len(terms)))).select(F.struct("*")).scalar()
    whole = index.corpora.where(F.col("corpus") == corpus).agg(F.max("docs").alias("docs"), F.max("mean").alias("mean")).select(F.struct("*")).scalar()
    found = rows.where(_holds(tree, lambda t: F.col(f"__{terms.index(t)}"))).withColumn("__s", seen).withColumn("__c", whole)
    if where is not None:
        found = found.where(where)
    score = F.lit(0.0)
    for k, term in enumerate(terms):
        if term in scored:
            tf, df = F.col(f"__{k}"), F.col(f"__s.df{k}")
            idf = F.greatest(F.ln((F.col("__c.docs") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("__c.mean")))
    out = found.select("project_id", "id", F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), "project_id", "id").limit(limit) if limit is not None else out


def search_with_fallback(index: Index, query: str, corpus: str = "docs", limit: int = 20, where: Column | None = None) -> tuple[DataFrame, str | None]:
    """A search that is tried again if it finds nothing: several plain words with OR, one plain word as a prefix.

    Returns the results and the fallback that was used.
    """
    got = search(index, query, corpus, limit, where)
    plain = query.split()
    if any(w in _OPERATORS or '"' in w or "*" in w for w in plain) or not plain:
        return got, None
    again = ("or", " OR ".join(plain)) if len(plain) > 1 else ("prefix", plain[0] + "*") if plain[0].isidentifier() else None
    if again is None or not got.isEmpty():
        return got, None
    return search(index, again[1], corpus, limit, where), again[0]


def exact_match_hint(nodes: DataFrame, query: str, kinds: tuple[str, ...], languages: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, id, kind, language) of nodes with exactly the name asked for that a filter by kind or language leaves out."""
    inside = F.col("kind").isin(*kinds) if kinds else F.lit(True)
    if languages:
        inside = inside & F.col("language").isin(*languages)
    return nodes.where((F.col("name") == query.strip()) & ~inside).select("project_id", "id", "kind", "language")


def default_min_confidence(query: str, corpus: str = "code") -> float:
    """The floor of confidence for a search: none for one exact identifier or for documents."""
    if corpus == "docs" or re.fullmatch(r"[A-Za-z_]\w*(?:[A-Z_]\w*)", query.strip()) and (re.search(r"[a-z][A-Z]|_", query)):
        return 0.0
    return 0.71


CORPORA = ("code", "config", "docs")


def route_corpus(corpus: str | None) -> tuple[str, str | None]:
    """The corpus to search and a warning; 'all' is answered from code."""
    if corpus in (None, ""):
        return "code", None
    if corpus == "all":
        return "code", "one corpus is searched at a time; code is used"
    if corpus not in CORPORA:
        raise SearchError(f"unknown corpus {corpus!r}; it is one of {', '.join(CORPORA)}")
    return corpus, None
