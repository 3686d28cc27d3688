"""Reading level of documents by ordinal regression.

Levels are those of the graded sample: 1 beginner, 2 general reader, 3
practitioner, 4 specialist.  Markdown, code, logs, links and names of code are
taken away first.  Each sentence of what is left is measured by its vocabulary
(word length, rarity in the corpus, diversity), connectives, clauses and length;
vocabulary counts per clause, so stringing easy clauses together doesn't raise
it.  A document's features are the medians of its sentences' measures, which
single harder or easier sentences don't move, and the shares of its sentences
that a first regression over the medians puts at each level.  A regularised
proportional-odds regression over these features, fitted to graded documents,
gives the level.

Texts are parsed once: the parsed form, numbers only, is written to the shared
folder, and word counts, fitting and levels are made from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Most labelled documents that the model is fitted to; taken by hash of doc_id.
FIT_ROWS = 20_000
#: Words per language in the table of rarities; a bound on what is broadcast.  Rarer words have the rarity of the last one.
VOCABULARY = 20_000
#: Least words of prose for a document to have a level.
LEAST_WORDS = 12

#: Least words of a sentence.
SENTENCE_WORDS = 4

#: Frequent short words that tell the language.
COMMON = {
    "en": "the a an this each is are of and to in on with for by as if while because it its".split(),
    "fr": "le la les un une ce chaque des du de et dans sur avec pour par car si comme est quand".split(),
    "de": "der die das den ein eine jede jeder diese und in auf mit für durch weil wenn ist nicht als".split(),
    "es": "el la los las un una este cada del de y en sobre con para por porque si como es cuando".split(),
}
#: Connectives of formal prose.
FORMAL = (
    "notwithstanding|insofar as|inasmuch as|to the extent that|provided that|whereas|albeit|lest|thereby|whereby|wherein|whereupon|hence|consequently|analogously|characteristically|fundamentally|conversely|furthermore|moreover|nevertheless|nonetheless|accordingly|heretofore|in light of the fact that|by virtue of"
    "|nonobstant|dans la mesure où|étant entendu que|attendu que|indépendamment de[s ]|conséquemment|corrélativement|fondamentalement|néanmoins|toutefois|en dépit du fait que|quoique|pourvu que|à condition que|de surcroît|eu égard"
    "|infolgedessen|dementsprechend|erfahrungsgemäß|grundsätzlich|gleichwohl|mithin|beziehungsweise|ungeachtet|insofern|insoweit|nichtsdestotrotz|demzufolge|wohingegen|sofern|vorausgesetzt|hinsichtlich"
    "|en la medida en que|habida cuenta de que|sin perjuicio de que|toda vez que|independientemente de|consiguientemente|correlativamente|fundamentalmente|no obstante|por consiguiente|siempre que|a pesar de que|dado que|si bien"
)
#: Plain words that begin another clause.
CLAUSE = (
    "and|but|or|so|then|because|while|when|if|as|until|since|although|though|unless|that|which|who"
    "|et|mais|ou|puis|donc|car|quand|si|comme|pendant que|jusqu'à|parce que|qui|que"
    "|und|aber|oder|dann|weil|wenn|während|als|bis|da|obwohl|dass|denn|sobald|damit"
    "|y|pero|o|luego|porque|mientras|cuando|como|hasta|aunque|pues"
)
_PHRASES: dict[str, list[str]] = {}
for _p in FORMAL.replace("[s ]", "s ").split("|"):
    _PHRASES.setdefault(_p.split(" ")[0], []).append(_p.strip() + " ")
_CLAUSE = frozenset(CLAUSE.split("|"))
_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)")
_INDENTED = re.compile(r"(?m)^(?: {4}|\t)\s*\S.*[(){};=<>].*$")
_TICKS = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+|\S+@\S+\.\w+")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s|^\s*(?:=+|-{3,}|\*{3,}|_{3,})\s*$")
_ITEM = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]|\d{1,3}[.)])\s+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d|(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL)\b|at \S+\(|Traceback|\$ |>>> |[{}\[\]<|])")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"')\]»“”]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: what a word of prose doesn't contain
_CODE_NAME = re.compile(r"[_\\/#=<>{}|@\d]|[a-z][A-Z]|\w\.\w|\(\)")




class Vocabulary(dict):
    """Words of whitespace-separated pieces of text, by their numbers, with what is known of each word.

    A piece that is a name of code or no word has none.  Cleared between
    batches when it has grown large.
    """

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.facts: list[tuple] = []  # hash, length, clause, begins a formal phrase, languages
        self.table: tuple[np.ndarray, ...] | None = None

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = () if _CODE_NAME.search(piece) else tuple(self.add(w) for w in _WORD.findall(piece.lower()))
        self[piece] = found
        return found

    def add(self, word: str) -> int:
        k = self.number.get(word)
        if k is None:
            k = self.number[word] = len(self.words)
            self.words.append(word)
            h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 3 << 2
            self.facts.append((h, len(word), word in _CLAUSE, word in _PHRASES, *(word in c for c in _COMMON.values())))
            self.table = None
        return k

    def arrays(self) -> tuple[np.ndarray, ...]:
        if self.table is None:
            self.table = tuple(np.array(c) for c in zip(*self.facts)) if self.facts else tuple(np.zeros(0, np.int64) for _ in range(4 + len(_COMMON)))
        return self.table

    def tidy(self) -> None:
        if len(self) > 400_000:
            self.clear()
            self.number.clear()
            self.words.clear()
            self.facts.clear()
            self.table = None


_COMMON = {k: frozenset(v) for k, v in COMMON.items()}
_LANGS = list(COMMON)
_VOCABULARY = Vocabulary()
_BREAKS = re.compile(r"\r\n?|[\x0b\x0c\x85\u2028\u2029]")


def _prose(text: str) -> Iterator[str]:
    """Sentences of a text's prose."""
    t = _BREAKS.sub("\n", text)
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n\n", t)
    if "`" in t:
        t = _TICKS.sub(" ", t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    if "://" in t or "www." in t or "@" in t:
        t = _URL.sub(" ", t)
    pieces: list[str] = []
    running = False
    rows = t.split("\n")
    # a text is wrapped if some line goes on in small letters where the one before it ended in no mark
    wrapped = any(b.lstrip()[:1].islower() and a.strip() and a.strip()[-1] not in ".!?:|" for a, b in zip(rows, rows[1:]))
    for row in rows:
        s = row.strip()
        if not s or _HEADING.match(row) or s.count("|") >= 2 or _LOG.match(row) or row[:1] in " \t" and _INDENTED.match(row):
            running = False
            continue
        item = None if s[0].isalpha() else _ITEM.match(row)
        s = s if not item else row[item.end() :].strip()
        if running and not item:
            pieces[-1] += " " + s
        else:
            pieces.append(s)
        # in other texts a line is a sentence, unless it ends in a mark of the middle
        running = wrapped and len(row) >= 50 and s[-1:] not in ".!?…:" or s[-1:] in ",;"
    for p in pieces:
        yield from _SENTENCE.split(p)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of a text's prose that has four or more, in small letters."""
    v = Vocabulary()
    words = [[v.words[k] for x in s.split() for k in v[x]] for s in _prose(text)]
    return [w for w in words if len(w) >= SENTENCE_WORDS]


class Parsed(NamedTuple):
    """Texts as numbers: per document language, sentences and words; per sentence words and measures; per word a hash."""

    lang: np.ndarray
    sentences: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    measures: np.ndarray
    hashes: np.ndarray


#: Measures of a sentence that need its text only, and those of its words' rarities.
MEASURES = ("log words", "log words a clause", "word length", "long share", "long a clause", "log long", "diversity", "formal connectives", "clauses", "commas", "long share with formal connectives", "long share above a quarter", "long a clause squared")
RARITIES = ("rarity", "rarity of the rarest third")
#: A word as long as this is long, by language: compounds make German words longer.
_LONG = np.array([14 if k == "de" else 11 for k in COMMON])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that end at ends."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, total.dtype)


def parse(texts: Iterable[str | None]) -> Parsed:
    """The parsed form of texts; a null or empty one has no sentences."""
    v = _VOCABULARY
    v.tidy()
    flat: list[int] = []
    sizes: list[int] = []
    commas: list[int] = []
    marks: list[int] = []
    counts: list[int] = []
    for t in texts:
        before = len(sizes)
        for s in _prose(t) if t else ():
            ids = [k for x in s.split() for k in v[x]]
            if len(ids) >= SENTENCE_WORDS:
                flat += ids
                sizes.append(len(ids))
                semis = s.count(";")
                commas.append(s.count(",") + semis)
                marks.append(semis + s.count(":"))
        counts.append(len(sizes) - before)
    hashes, length, clause, formal, *common = v.arrays()
    ids, n = np.array(flat, np.int64), np.array(sizes, np.int64)
    per_doc = np.array(counts, np.int64)
    ends, doc_ends = np.cumsum(n), np.cumsum(per_doc)
    doc_words = _sums(n, doc_ends)
    votes = np.array([_sums(_sums(c[ids].astype(np.int64), ends), doc_ends) for c in common]).reshape(len(common), len(per_doc))
    lang = votes.argmax(0) if len(per_doc) else np.zeros(0, np.int64)
    sentence = np.repeat(np.arange(len(n)), n)
    of = np.repeat(lang, per_doc)  # language by sentence
    long_words = _sums((length[ids] >= _LONG[of[sentence]]).astype(np.int64), ends)
    phrases = np.zeros(len(n), np.int64)
    for at in np.flatnonzero(formal[ids]) if len(ids) else ():
        k = sentence[at]
        here = " ".join([v.words[x] for x in flat[at : min(at + 8, ends[k])]]) + " "
        phrases[k] += any(here.startswith(p) for p in _PHRASES[v.words[flat[at]]])
    clauses = 1 + _sums(clause[ids].astype(np.int64), ends) + np.array(marks, np.int64) + phrases
    order = np.lexsort((ids, sentence))
    fresh = np.ones(len(ids), np.int64)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (sentence[order][1:] != sentence[order][:-1])
    distinct = _sums(fresh, ends)
    m = np.maximum(n, 1)
    share, each = long_words / m, np.minimum(long_words / clauses, 6.0)
    columns = [
        np.log(m), np.log(np.minimum(n / clauses, 30.0) + 1e-9), _sums(length[ids], ends) / m, share, each, np.log1p(long_words), distinct / m, np.minimum(phrases, 3) / 2.0,
        np.minimum(clauses, 8) / 4.0, np.minimum(np.array(commas), 6) / 3.0, share * np.minimum(phrases, 2), np.maximum(share - 0.25, 0.0), each**2 / 6.0,
    ]
    measures = np.stack(columns, 1).astype(np.float32) if len(n) else np.zeros((0, len(MEASURES)), np.float32)
    return Parsed(lang, per_doc, doc_words, n, measures, hashes[ids] | np.repeat(lang, doc_words) if len(ids) else np.zeros(0, np.int64))


_PARSED = "doc_id long, lang int, words int, sizes array<int>, measures array<float>, hashes array<long>"


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def parsed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The parsed form of docs (doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = parse(b.column(1).to_pylist())
            columns = [b.column(0), pa.array(p.lang, pa.int32()), pa.array(p.words, pa.int32()), _lists(p.sizes, p.sentences, pa.int32()), _lists(p.measures.ravel(), p.sentences * len(MEASURES), pa.float32()), _lists(p.hashes, p.words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PARSED.split(", ")])

    return written(docs.select("doc_id", text).mapInArrow(run, _PARSED))


class Rarities(NamedTuple):
    """Rarity in [0, 1] of frequent words by their hashes, and of all others by language."""

    keys: np.ndarray
    values: np.ndarray
    others: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.others[hashes & 3]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], self.others[hashes & 3])


def rarities(counts: Iterable[tuple[int, int]]) -> Rarities:
    """From (key, documents that have it); the key below 4 of a language has its number of documents."""
    rows = sorted(counts)
    total = np.ones(4)
    for k, n in rows:
        if k < 4:
            total[k] = n
    total = np.maximum(total, 2)
    keys = np.array([k for k, _ in rows if k >= 4], np.int64)
    n = np.array([c for k, c in rows if k >= 4], float)
    values = np.minimum(1.0, np.log(total[keys & 3] / n) / np.log(total[keys & 3])) if len(keys) else np.zeros(0)
    others = np.array([values[keys & 3 == k].max() if (keys & 3 == k).any() else 1.0 for k in range(4)])
    return Rarities(keys, np.maximum(values, 0.0), others)


def word_rarities(parsed: DataFrame) -> Rarities:
    """Rarities of the VOCABULARY most frequent words of each language, by the documents that have them.

    Counts cover all documents; each task sends its words with their counts.
    Words beyond VOCABULARY are rarer than all others and have the rarity of the
    last of these.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, doc))
            h, d = flat[order], doc[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            keys, n = np.unique(np.concatenate([h[once], b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    counts = written(parsed.select("lang", "hashes").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    top = counts.where("key < 4")
    for k in range(4):  # each a top-k, without a sort of all words
        top = top.unionAll(counts.where((F.col("key") >= 4) & (F.col("key").bitwiseAND(F.lit(3)) == k)).orderBy(F.desc("n"), "key").limit(VOCABULARY))
    return rarities([(r.key, r.n) for r in top.collect()])  # at most 4 * (VOCABULARY + 1) rows


def sentence_features(p: Parsed, rare: Rarities) -> np.ndarray:
    """MEASURES and RARITIES of each sentence."""
    if not len(p.sizes):
        return np.zeros((0, len(MEASURES) + 2))
    r = rare.of(p.hashes)
    ends = np.cumsum(p.sizes)
    sentence = np.repeat(np.arange(len(p.sizes)), p.sizes)
    third = np.maximum(1, p.sizes // 3)
    ranked = r[np.lexsort((r, sentence))]
    rarest = np.arange(len(r)) >= np.repeat(ends - third, p.sizes)
    return np.column_stack([p.measures, _sums(r, ends) / p.sizes, _sums(ranked * rarest, ends) / third])


def medians(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Medians of the columns of consecutive runs of rows; zeros for an empty run."""
    out = np.zeros((len(counts), x.shape[1]))
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    low, high = starts + (counts[some] - 1) // 2, starts + counts[some] // 2
    run = np.repeat(np.arange(len(counts)), counts)
    for j in range(x.shape[1]):
        c = x[np.lexsort((x[:, j], run)), j]
        out[some, j] = (c[low] + c[high]) / 2
    return out


class Ordinal:
    """Proportional-odds regression with a quadratic penalty, fitted by Fisher scoring with halved steps."""

    def __init__(self, penalty: float = 1e-3):
        self.penalty = penalty

    def _probabilities(self, z: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the four levels, and slopes at the three cuts between zero slopes at both ends."""
        s = 1 / (1 + np.exp(-np.clip(p[-3:][None, :] - (z @ p[:-3])[:, None], -40, 40)))
        full = np.column_stack([np.zeros(len(z)), s, np.ones(len(z))])
        return np.maximum(np.diff(full, axis=1), 1e-12), full * (1 - full)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> "Ordinal":
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        k = z.shape[1]
        w = weight / weight.sum()
        below = np.clip([w[y <= j].sum() for j in (1, 2, 3)], 0.01, 0.99)
        p = np.concatenate([np.zeros(k), np.maximum.accumulate(np.log(below / (1 - below))) + [0.0, 1e-2, 2e-2]])
        ridge = np.concatenate([np.full(k, self.penalty), np.full(3, 1e-6)])
        loss = lambda q: -(w * np.log(self._probabilities(z, q)[0][np.arange(len(y)), y - 1])).sum() + (ridge * q * q).sum() / 2
        best = loss(p)
        for _ in range(rounds):
            chance, slope = self._probabilities(z, p)
            score, info = -ridge * p, np.diag(ridge)
            for j in range(4):
                d = np.column_stack([-(slope[:, j + 1] - slope[:, j])[:, None] * z, np.zeros((len(z), 3))])
                if j < 3:
                    d[:, k + j] += slope[:, j + 1]
                if j:
                    d[:, k + j - 1] -= slope[:, j]
                d *= (np.sqrt(w / chance[:, j]))[:, None]
                info += d.T @ d
                own = y == j + 1
                score += (d[own] * np.sqrt(w[own] / chance[own, j])[:, None]).sum(0)
            step, size = np.linalg.lstsq(info, score, rcond=None)[0], 1.0
            while size > 1e-4:
                q = p + size * step
                if np.all(np.diff(q[-3:]) > 1e-4) and (now := loss(q)) <= best:
                    break
                size /= 2
            else:
                break
            p, gain, best = q, best - now, now
            if gain < 1e-7:
                break
        self.weights, self.cuts = p[:-3], p[-3:]
        return self

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the four levels, by row."""
        return self._probabilities((x - self.mean) / self.scale, np.concatenate([self.weights, self.cuts]))[0]

    def levels(self, x: np.ndarray) -> np.ndarray:
        """The most probable level of each row."""
        return self.chances(x).argmax(1) + 1


class NoLabels(ValueError):
    """No model can be fitted to the labels."""


def fit_graded(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Ordinal:
    """A model from features and levels given; rows that a first model puts at another level, such as wrong labels, are left out of a second."""
    if len(set(y.tolist())) < 2:
        raise NoLabels("labels of two levels at least are needed")
    model = Ordinal().fit(x, y, weight)
    for _ in range(2):
        sure = model.levels(x) == y
        if sure.sum() < 50 or len(set(y[sure].tolist())) < len(set(y.tolist())):
            break
        model = Ordinal().fit(x[sure], y[sure], weight[sure])
    return model


def reached(first: Ordinal, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected shares of each document's sentences that reach levels 2, 3 and 4."""
    chance = first.chances(x)[:, ::-1].cumsum(1)[:, ::-1][:, 1:] if len(x) else np.zeros((0, 3))
    ends = np.cumsum(counts)
    return np.column_stack([_sums(chance[:, j], ends) for j in range(3)]) / np.maximum(counts, 1)[:, None]


def _read(b: pa.RecordBatch) -> Parsed:
    lang, words, sizes, measures, hashes = (b.column(k) for k in range(1, 6))
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
    return Parsed(lang.to_numpy(), np.diff(sizes.offsets.to_numpy()), words.to_numpy().astype(np.int64), flat(sizes).astype(np.int64), flat(measures).reshape(-1, len(MEASURES)), flat(hashes))


def _features(parsed: DataFrame, rare: Rarities, first: Ordinal | None) -> DataFrame:
    """doc_id and features of documents with enough prose."""
    shared = parsed.sparkSession.sparkContext.broadcast((rare, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, m = shared.value
        for b in batches:
            p = _read(b)
            x = document_features(p, r, m)
            ok = p.words >= LEAST_WORDS
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), _lists(x[ok].ravel(), np.full(ok.sum(), x.shape[1]), pa.float64())], names=["doc_id", "x"])

    return parsed.select(*(f.split()[0] for f in _PARSED.split(", "))).mapInArrow(run, "doc_id long, x array<double>")


def document_features(p: Parsed, rare: Rarities, first: Ordinal | None) -> np.ndarray:
    """Medians of the sentences' features, and with a first model the shares that reach each level."""
    x = sentence_features(p, rare)
    middle = medians(x, p.sentences)
    return middle if first is None else np.column_stack([middle, reached(first, x, p.sentences)])


def fit(parsed: DataFrame, labels: DataFrame, rare: Rarities) -> tuple[Ordinal, Ordinal]:
    """The first model and the model, from at most FIT_ROWS labelled documents.

    Null labels and documents without enough prose don't count.  Features are
    made in the tasks; the driver gets one row of them per document.
    """
    given = labels.where("reading_level between 1 and 4").groupBy("doc_id").agg(F.collect_list("reading_level").alias("levels"))  # a few raters a document
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    levels = {r.doc_id: list(r.levels) for r in chosen.collect()}  # at most FIT_ROWS rows
    ids = labels.sparkSession.createDataFrame([(k,) for k in levels], "doc_id long")
    graded = written(parsed.join(F.broadcast(ids), "doc_id", "left_semi"))

    def model(first: Ordinal | None) -> Ordinal:
        rows = _features(graded, rare, first).orderBy("doc_id").collect()
        flat = [(r.x, v, 1.0 / len(levels[r.doc_id])) for r in rows for v in levels[r.doc_id]]
        if not flat:
            raise NoLabels("no labelled document has prose")
        return fit_graded(np.array([f[0] for f in flat]), np.array([f[1] for f in flat]), np.array([f[2] for f in flat]))

    first = model(None)
    return first, model(first)


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level, hard_share, prose_words) of each row of docs.

    level is null for texts that are null, empty or have hardly any prose, and
    for all documents if the labels have fewer than two levels.  hard_share is
    the expected share of sentences that reach level 4.
    """
    parsed = parsed_documents(docs)
    rare = word_rarities(parsed)
    try:
        models = fit(parsed, labels, rare)
    except NoLabels:
        return docs.select("doc_id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("hard_share"), F.lit(None).cast("int").alias("prose_words"))
    shared = docs.sparkSession.sparkContext.broadcast((rare, *models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, first, second = shared.value
        for b in batches:
            p = _read(b)
            x = document_features(p, r, first)
            none = p.words < LEAST_WORDS
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(second.levels(x) if len(x) else [], pa.int32(), mask=none), pa.array(x[:, -1], pa.float64(), mask=none), pa.array(p.words, pa.int32())], names=["doc_id", "level", "hard_share", "prose_words"])

    return parsed.mapInArrow(run, "doc_id long, level int, hard_share double, prose_words int")
