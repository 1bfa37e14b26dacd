"""Registry of named queries: name -> (Spark builder, DuckDB oracle SQL).

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle is ANSI SQL over the
driver's tables; binding views it reads (``posts``, ``engagement``, ...) are
prefixed as CTEs automatically from ``ORACLE_VIEWS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.bindings import ORACLE_VIEWS, Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
EXTRA_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}

_TABLES: dict[tuple[int, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (id(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def oracle_view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    """Declare an extra oracle CTE (e.g. a raw-items view) usable by oracle SQL."""
    EXTRA_VIEWS[name] = (sql, deps)


def _views() -> dict[str, tuple[str, tuple[str, ...]]]:
    v = dict(ORACLE_VIEWS)
    v.update(EXTRA_VIEWS)
    return v


def with_views(sql: str) -> str:
    """Prefix the binding CTEs referenced (``from``/``join`` name) by ``sql``."""
    views = _views()
    used: list[str] = []

    def visit(name: str) -> None:
        if name in used:
            return
        for dep in views[name][1]:
            visit(dep)
        used.append(name)

    def scan(text: str) -> None:
        for m in re.finditer(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)", text, re.IGNORECASE):
            n = m.group(1).lower()
            if n in views:
                visit(n)

    scan(sql)
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({views[n][0]})" for n in used)
    body = sql.strip()
    if re.match(r"(?is)^with\s+recursive\s", body):
        return "with recursive " + ctes + ",\n" + body[len("with recursive"):].lstrip()
    if re.match(r"(?is)^with\s", body):
        return "with " + ctes + ",\n" + body[4:].lstrip()
    return "with " + ctes + "\n" + body


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(tables(spark, sf_dir))

        run.__name__ = name
        if fn.__doc__:
            run.__doc__ = fn.__doc__
        else:
            from .catalog.descriptions import DESCRIPTIONS
            run.__doc__ = DESCRIPTIONS.get(name)
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every catalog module so their queries register."""
    from . import catalog  # noqa: F401


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: with_views(v) for k, v in ORACLES.items()}
