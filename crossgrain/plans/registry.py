"""Named queries over the given tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _rounds_alike(sql: str) -> str:
    """``round(x, n)`` as the same binary arithmetic that the queries use."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        if i and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            out.append(sql[at : i + 6])
            at = i + 6
            continue
        depth, j, comma = 1, i + 6, None
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = j
            j += 1
        scale = f"1e{int(sql[comma + 1 : j - 1])}"
        out.append(f"{sql[at:i]}(floor(CAST({_rounds_alike(sql[i + 6 : comma])} AS DOUBLE) * {scale} + 0.5) / {scale})")
        at = j
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; ``sql`` is its DuckDB equivalent."""

    def add(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = _rounds_alike(sql)
        return run

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
