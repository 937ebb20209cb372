"""Named queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.expr import nudge
from panelspark.plans.view_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Put the view definitions that ``body`` needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def spell_rounding(sql: str) -> str:
    """Write ``rnd(x, digits)`` out as the rounding that ``functions.expr.rnd`` does."""
    while (hit := re.search(r"\brnd\(", sql)) is not None:
        depth, comma, end = 1, 0, hit.end()
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        x, digits = sql[hit.end():comma], int(sql[comma + 1:end - 1])
        sql = f"{sql[:hit.start()]}(round(({x}) + {nudge(digits):.1e}, {digits}) + 0.0){sql[end:]}"
    return sql


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = spell_rounding(with_views(oracle))
        return fn
    return add
