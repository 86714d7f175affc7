"""Registered queries: an operator run over the given tables, next to the SQL
that states its result independently."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textbench.plans.fixtures import Tables, with_tables

_RUN: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: Sequence[str] = ()):
    """Register a query; `tables` are the derived tables its SQL reads."""

    def register(run):
        _RUN[name] = run
        if sql is not None:
            _SQL[name] = with_tables([f"fx_{t}" for t in tables], sql)
        return run

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Flags as 0/1 and reals to six places, as both engines can state them."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, Ty.BooleanType):
            c = c.cast("int")
        elif isinstance(field.dataType, Ty.DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(field.name))
    return df.select(*out)


def _load() -> None:
    from textbench.plans import (  # noqa: F401
        answer_queries,
        curate_queries,
        flow_queries,
        report_queries,
        response_queries,
        score_queries,
        source_queries,
        text_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(run):
        return lambda spark, folder: tidy(run(Tables(spark, folder)))

    return {name: bind(run) for name, run in _RUN.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
