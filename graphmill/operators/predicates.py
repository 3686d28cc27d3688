"""Conditions of queries as columns, in two dialects.

Scans and joins follow SQL: text comparisons ignore letter case in CONTAINS,
STARTS WITH and ENDS WITH, and null makes a condition null.  Paths evaluate
conditions in memory (``memory``): letter case counts, and order comparisons of
text need numbers.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRUE = frozenset(("true", "TRUE", "True", "1", 1, True))


def _bool(value: Any) -> bool:
    return value in _TRUE


def condition(c: Column, op: str, value: Any = None, boolean: bool = False, numeric: bool = False, memory: bool = False) -> Column:
    """One condition on a column; null in the column counts as the empty value.

    Equality with '' or false also holds for null; inequality with anything else
    does too.
    """
    if op == "TRUE":
        return c if boolean else c.cast("string").isin("true", "1")
    text = c if not (boolean or numeric) else c.cast("string")
    if op == "NULL":
        return c.isNull() if boolean or numeric else c.isNull() | (c == "")
    if op == "NOTNULL":
        return c.isNotNull() if boolean or numeric else c.isNotNull() & (c != "")
    if op == "IN":
        if boolean:
            inside = c.isin([_bool(v) for v in value])
        elif numeric:
            inside = c.cast("double").isin([float(v) for v in value if _is_number(v)])
        else:
            inside = c.isin([str(v) for v in value])
        return F.coalesce(inside, F.lit(False))
    if op == "=~":
        return text.rlike(value)
    if op in ("CONTAINS", "STARTS", "ENDS"):
        a, b = (text, F.lit(value)) if memory else (F.lower(text), F.lower(F.lit(value)))
        return {"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith}[op](a, b)
    if op in ("=", "<>"):
        if boolean:
            v: Any = _bool(value)
            zero = v is False
            same = c == F.lit(v)
        elif numeric:
            zero = False
            same = c == F.lit(float(value)) if _is_number(value) else F.lit(False)
        else:
            zero = value == ""
            same = c == F.lit(str(value))
        if op == "=":
            return c.isNull() | same if zero else same
        return c.isNotNull() & ~same if zero else c.isNull() | ~same
    if numeric:
        if not _is_number(value):
            return F.lit(False)
        a, b = c.cast("double"), F.lit(float(value))
    elif memory:
        if not _is_number(value):
            return F.lit(False)
        a, b = c.try_cast("double"), F.lit(float(value))
    else:
        a, b = text, F.lit(str(value))
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def _is_number(v: Any) -> bool:
    try:
        float(v)
    except (TypeError, ValueError):
        return False
    return not isinstance(v, bool)
