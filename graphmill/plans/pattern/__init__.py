"""A read-only pattern query language compiled to DataFrames."""

from .compile import QueryResult, empty_hints, run
from .parser import QueryError, parse

__all__ = ["QueryError", "QueryResult", "empty_hints", "parse", "run"]
