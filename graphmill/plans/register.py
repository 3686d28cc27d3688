"""Queries with the SQL of the same result, by name."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    """A decorator that keeps query functions; its argument is their SQL, if there is one."""

    def __init__(self) -> None:
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            self._queries[fn.__name__] = fn
            if sql:
                self._sql[fn.__name__] = sql
            return fn

        return add

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
