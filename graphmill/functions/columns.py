"""Scalar helpers as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Baseline confidence by kind of node.
KIND_BASELINE = {
    **dict.fromkeys("Function Method Class Interface Type Enum".split(), 1.0),
    **dict.fromkeys("Module Variable Setting Resource DataSource Output Provider Local".split(), 0.95),
    **dict.fromkeys("Block".split(), 0.85),
    **dict.fromkeys("Section Heading".split(), 0.8),
    **dict.fromkeys("Document CodeSnippet".split(), 0.7),
}
#: What paths take off confidence, by file name or by directory; the first that holds counts.
PATH_PENALTIES = ((".terraform.lock.hcl", -0.4, False), *((x, -0.3, True) for x in ("vendor", "node_modules", "third_party")), *((x, -0.2, True) for x in ("dist", "build", "out")), *((x, -0.2, False) for x in ("README.md", "CHANGELOG.md", "CONTRIBUTING.md")))
#: The head of a file that is searched, and what marks it as generated.
HEAD_BYTES, GENERATED_MARK = 1024, "Code generated"
#: Paths that tests, fixtures and copies live under.
TEST_PATH = r"(?i:(?:^|/)(?:tests?|__tests__|specs?|e2e|it)/)|(?i:_test\.(?:go|py|rs|rb)$|_spec\.rb$|\.(?:test|spec)\.[cm]?[jt]sx?$|(?:^|/)(?:test_[^/]*|conftest)\.py$)|(?:Tests?|Spec|IT)\.(?:java|kt|swift|cs|php|scala)$"
#: The same in SQL, of a column's name.
TEST_SQL = "regexp_matches({0}, '" + TEST_PATH + "')"
FIXTURE_PATH = r"(?i)(?:^|/)(?:testdata|test-fixtures|test_fixtures|__fixtures__|fixtures)/"
COMPLEXITY_WORDS = ("if ", "for ", "while ", "case ", "catch ", "&&", "||", "elif ", "except ")


def token_estimate(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up; null for null."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_fixture(path: Column) -> Column:
    return path.rlike(FIXTURE_PATH)


def complexity(text: Column) -> Column:
    """One more than the number of branch words of a text; 1 for null."""
    t = F.coalesce(text, F.lit(""))
    total = F.lit(1)
    for w in COMPLEXITY_WORDS:
        total = total + ((F.length(t) - F.length(F.replace(t, F.lit(w)))) / len(w)).cast("int")
    return total.cast("int")


def confidence(base: Column, kind: Column, path_penalty: Column, ident_bonus: Column, generated: Column) -> Column:
    """Extraction confidence: the mean of extractor and kind with bonus and penalties, between 0 and 1; nulls count 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base + kind) / 2 + z(path_penalty) + z(ident_bonus) + z(generated)))


def kind_baseline(kind: Column, otherwise: Column) -> Column:
    """The baseline of a kind; of other kinds that of the extractor."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in KIND_BASELINE.items() for x in p])[kind], otherwise)


def path_penalty(path: Column) -> Column:
    """What a path takes off confidence; 0 for most."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")), F.lit(0)))
    out = F.lit(0.0)
    for name, penalty, folder in reversed(PATH_PENALTIES):
        out = F.when(F.array_contains(folders, name) if folder else F.substring_index(path, "/", -1) == name, F.lit(penalty)).otherwise(out)
    return out


def identifier_bonus(name: Column) -> Column:
    """A little more for a name that is an identifier, less for a blank one."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), 0.05).when(F.trim(name) == "", -0.1).otherwise(0.0)


def generated_penalty(content: Column) -> Column:
    """What a mark of generated code in the head of a file takes off."""
    head = F.substring(F.encode(content, "UTF-8"), 1, HEAD_BYTES)
    return F.when(F.contains(head, F.encode(F.lit(GENERATED_MARK), "UTF-8")), -0.3).otherwise(0.0)


def package_of(path: Column) -> Column:
    """The last directory of a path; empty for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def directory_of(path: Column) -> Column:
    """The directories of a path; a dot for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def slug(text: Column) -> Column:
    """A heading as an anchor: small letters, digits and single dashes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s_-]", ""), r"[\s-]+", "-"), F.lit("-"))


def staleness(seconds: Column) -> Column:
    """An age in words: 45s, 12m, 5h or 3d."""
    s = seconds.cast("bigint")
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat((s / 60).cast("bigint"), F.lit("m"))).when(s < 86400, F.concat((s / 3600).cast("bigint"), F.lit("h"))).otherwise(F.concat((s / 86400).cast("bigint"), F.lit("d")))


def version_key(version: Column) -> Column:
    """An array by which versions of up to four numbers sort; dev and others sort lowest."""
    nums = F.transform(F.split(F.regexp_replace(version, "^v", ""), r"[.+-]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    return F.when(version.rlike(r"^v?\d"), F.slice(F.concat(nums, F.array(*[F.lit(0)] * 4)), 1, 4)).otherwise(F.array(*[F.lit(-1)] * 4))


def line_range_text(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text's UTF-8 form."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), start + 1, end - start), "UTF-8")


def corpus_of(language: Column, kind: Column) -> Column:
    """The text corpus of a node: docs, config or code."""
    return F.when((kind == "Document") | language.isin("Markdown", "HTML"), "docs").when(language.isin("YAML", "JSON", "HCL", "TOML", "XML"), "config").otherwise("code")


def snippet(text: Column, word: str, width: int = 80) -> Column:
    """The part of a text around a word, of at most 2 * width characters and the word, in one line; its beginning without the word."""
    at = F.greatest(F.locate(word.lower(), F.lower(text)) - width, F.lit(1))
    return F.regexp_replace(F.substring(text, at, F.lit(2 * width + len(word))), r"\s+", " ")


def compact(text: Column, most: int = 120) -> Column:
    """The first line of a text, cut with an ellipsis."""
    line = F.substring_index(text, "\n", 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def dotted(parts: Column) -> Column:
    """Parts of a path joined by dots, with dots inside a part told apart by a backslash; null parts are left out."""
    return F.array_join(F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: F.replace(x, F.lit("."), F.lit("\\."))), ".")


def undotted(path: Column) -> Column:
    """The parts that dotted() joined."""
    return F.transform(F.split(path, r"(?<!\\)\."), lambda x: F.replace(x, F.lit("\\."), F.lit(".")))
