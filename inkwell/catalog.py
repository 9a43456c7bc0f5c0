"""All queries of the evaluation engine, and the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

from inkwell.plans import files, live, records, runs, scores

REGISTERS = [scores.Q, runs.Q, records.Q, files.Q, live.Q]


def queries() -> dict[str, Callable]:
    return {name: f for q in REGISTERS for name, f in q.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for q in REGISTERS for name, s in q.sql.items()}
