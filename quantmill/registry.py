"""All registered queries of the pairs library, with the SQL that gives the same rows.

``register`` takes the result's columns once for both sides: ``name`` as it is, ``name:6`` rounded to 6 digits,
``name:i`` as a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _spark_column(spec: str):
    name, _, kind = spec.partition(":")
    if not kind:
        return F.col(name)
    return F.col(name).cast("long").alias(name) if kind == "i" else (F.round(F.col(name).cast("double"), int(kind)) + 0.0).alias(name)


def _sql_column(spec: str) -> str:
    name, _, kind = spec.partition(":")
    if not kind:
        return name
    return f"CAST({name} AS BIGINT) AS {name}" if kind == "i" else f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}"


def register(name: str, columns: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under ``name``."""

    def put(f):
        specs = columns.split()
        _QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*map(_spark_column, specs))
        if sql is not None:
            from quantmill.plans.panels import with_ctes

            _SQL[name] = with_ctes(f"SELECT {', '.join(map(_sql_column, specs))} FROM ({sql}) AS result")
        return f

    return put


def _load() -> None:
    from quantmill.plans import catalog_accounts, catalog_core, catalog_research  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["W01_zscore"](spark, sf_dir)
