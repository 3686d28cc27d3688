"""Language of a file by its name, its extension or its first line."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by whole file name, extension and interpreter.
NAMES = {"Makefile": "Makefile", "GNUmakefile": "Makefile", "Dockerfile": "Dockerfile", "Rakefile": "Ruby", "Gemfile": "Ruby", "Jenkinsfile": "Groovy", "BUILD": "Starlark"}
EXTENSIONS = {
    "go": "Go", "py": "Python", "pyi": "Python", "pyw": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "rs": "Rust", "java": "Java", "rb": "Ruby", "php": "PHP", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++", "cs": "CSharp", "kt": "Kotlin", "kts": "Kotlin",
    "swift": "Swift", "lua": "Lua", "zig": "Zig", "scala": "Scala", "dart": "Dart", "r": "R", "ex": "Elixir", "exs": "Elixir", "sh": "Bash", "bash": "Bash", "zsh": "Bash", "mk": "Makefile", "sql": "SQL", "j2": "Jinja", "jinja": "Jinja", "jinja2": "Jinja", "yaml": "YAML", "yml": "YAML", "json": "JSON", "toml": "TOML", "tf": "HCL", "hcl": "HCL", "tfvars": "HCL",
    "md": "Markdown", "markdown": "Markdown", "html": "HTML", "htm": "HTML", "xml": "XML",
}
INTERPRETERS = {"python": "Python", "node": "JavaScript", "bash": "Bash", "sh": "Bash", "zsh": "Bash", "ruby": "Ruby", "php": "PHP", "lua": "Lua", "Rscript": "R", "elixir": "Elixir", "deno": "TypeScript"}


def detect(path: str, first_line: str = "") -> str:
    """The language's name, Unknown if nothing tells it."""
    base = path.rsplit("/", 1)[-1]
    if base in NAMES:
        return NAMES[base]
    if "." in base[1:]:
        return EXTENSIONS.get(base.rsplit(".", 1)[-1].lower(), "Unknown")
    m = re.match(r"#!\s*\S*?(?:env\s+(?:-S\s+)?)?([A-Za-z]+)[\d.]*(?:\s|$)", first_line)
    return INTERPRETERS.get(m[1].rsplit("/", 1)[-1], "Unknown") if m else "Unknown"


def language_of(path: Column, content: Column) -> Column:
    """The same as a column expression."""
    base = F.substring_index(path, "/", -1)
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    ext = F.when(base.rlike(r"^.+\."), F.lower(F.substring_index(base, ".", -1)))
    line = F.regexp_extract(F.substring_index(content, "\n", 1), r"^#!\s*\S*?(?:env\s+(?:-S\s+)?)?([A-Za-z]+)[\d.]*(?:\s|$)", 1)
    return F.coalesce(table(NAMES)[base], F.when(ext.isNotNull(), F.coalesce(table(EXTENSIONS)[ext], F.lit("Unknown"))), table(INTERPRETERS)[line], F.lit("Unknown"))
