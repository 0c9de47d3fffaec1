"""Named queries: a DataFrame builder over (spark, folder) and, where SQL can
say the same, the SQL that a second engine runs on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the definitions of the views a statement names as ``@view``."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"@(\w+)", text):
            if name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    strip = lambda text: re.sub(r"@(\w+)", r"v_\1", text)
    if not need:
        return sql.strip()
    ctes = ",\n".join(f"v_{n} AS ({strip(VIEWS[n]).strip()})" for n in need)
    body = strip(sql).strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
