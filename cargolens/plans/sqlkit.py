"""Composition of DuckDB oracle SQL from named common table expressions.

Each oracle query names the CTEs it uses; ``with_ctes`` adds their
dependencies in order.  The adapter views and fixed dims come from the same
source as the Spark side (``sources.views`` / ``sources.dims``).
"""

from __future__ import annotations

import re

from cargolens.sources import dims, views

_CTES: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    _CTES[name] = sql


for _name in views.VIEW_SQL:
    register(_name, views.VIEW_SQL[_name])
for _name in dims.SCHEMAS:
    register(_name, dims.dim_sql(_name))


def _deps(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [n for n in _CTES if n in words]


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every registered CTE it (transitively) references."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(name: str, stack: tuple[str, ...]) -> None:
        if name in seen or name in stack:
            return
        for dep in _deps(_CTES[name]):
            if dep != name:
                visit(dep, stack + (name,))
        seen.add(name)
        order.append(name)

    for dep in _deps(body):
        visit(dep, ())
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{_CTES[n]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH " and not stripped[5:].lstrip().upper().startswith("RECURSIVE"):
        return f"WITH {parts},\n{stripped[5:]}"
    return f"WITH {parts}\n{body}"
