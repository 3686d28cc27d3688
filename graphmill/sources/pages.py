"""Pages of the web as documents."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import map_rows

#: Bytes of a page that are read and kept; the feature's own bounds.
READ, KEPT = 512 * 1024, 32 * 1024
_PAGE = "url string, status int, content string, error string"


def _fetch(url: str | None, seconds: float) -> tuple:
    if not url or not url.startswith(("http://", "https://")):
        return url, None, None, "not a web address"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "graphmill"}), timeout=seconds) as r:  # noqa: S310
            return url, r.status, r.read(READ).decode("utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return url, e.code, None, str(e)
    except (OSError, ValueError) as e:
        return url, None, None, str(e)


def pages(urls: DataFrame, seconds: float = 20.0) -> DataFrame:
    """(url, status, content, error) of each distinct url, fetched in the tasks; a failure is a row with an error."""
    return map_rows(urls.select("url").distinct(), lambda u: [_fetch(u, seconds)], _PAGE, batch=16)


def documents(fetched: DataFrame, project_id: str) -> DataFrame:
    """Document nodes of pages that were fetched, with the beginning of their text."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    name = F.coalesce(F.nullif(F.regexp_extract("content", r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1), F.lit("")), F.col("url"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("content", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " "), r"\s+", " "))
    n = fetched.where("content is not null")
    return n.select(F.lit(project_id).alias("project_id"), F.concat("url", F.lit("::"), "url", F.lit("#Document")).alias("id"), F.concat(F.lit("@web/"), host).alias("file_path"), name.alias("name"), F.col("url").alias("qualified_name"), F.lit("Document").alias("kind"), F.lit("HTML").alias("language"), F.substring(plain, 1, KEPT).alias("docstring"))
