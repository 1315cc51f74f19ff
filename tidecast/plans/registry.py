"""Queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "Q01_seasonal_naive_losses"

#: Added before rounding to three or six places on both sides: means of prices in cents often end half-way, where engines
#: differ by the last bit of a sum.  Squared errors are rounded to three places, as their last bits are worth more.
OFF_HALF = 1.7e-08
_ROUND = re.compile(r"\bround\(")

#: Queries that SQL cannot express, and why.
ROWS_ONLY: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def off_half(sql: str) -> str:
    """sql whose calls round(x, 3) and round(x, 6) add OFF_HALF to x; all else stays as it is."""
    out, at = [], 0
    for found in _ROUND.finditer(sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        for places in (", 3)", ", 6)"):
            if sql[:end].endswith(places):
                out.append((end - len(places), f" + {OFF_HALF!r}"))
    parts = []
    for place, text in sorted(out):
        parts += [sql[at:place], text]
        at = place
    return "".join([*parts, sql[at:]])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is what DuckDB runs for the same rows (None where SQL cannot express it)."""

    def put(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracles[name] = off_half(sql)
        return f

    return put


def _load() -> None:
    from tidecast.plans import audits, comparison, evaluation, inference, preparation, search, structure, studies, tuning  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
