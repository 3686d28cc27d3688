"""The extractors as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .core import extract, module_name
from ..sources.languages import detect

ROWS = "language string, what string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, docstring string, parent string, complexity int, is_exported boolean, confidence double"


class ExtractSource:
    """extract_source(path, content): symbols and references of one file; null contents give none."""

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        if path is None or content is None:
            return
        language = detect(path, content.split("\n", 1)[0])
        try:
            for r in extract(language, path, content):
                yield (language, *r)
        except (ValueError, RecursionError, SyntaxError) as e:
            yield language, "failure", type(e).__name__, str(e), module_name(path), 1, 1, None, None, None, 0, False, 0.0


def register_extract(spark: SparkSession, name: str = "extract_source") -> None:
    """Makes the table function known: SELECT ... FROM files, LATERAL extract_source(file_path, content)."""
    spark.udtf.register(name, udtf(ExtractSource, returnType=ROWS))
