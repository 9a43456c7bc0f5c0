"""A register of queries: each has a name, a function of (spark, sf_dir) and, where SQL can express it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Register:
    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(function: Callable) -> Callable:
            self.functions[name] = function
            if sql:
                self.sql[name] = sql
            return function

        return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Floats that are sums or quotients, to so many digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def round_sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
