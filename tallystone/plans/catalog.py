"""Every query of the library by name, with the SQL that DuckDB runs for the same rows. A query's prefix is the inventory's operator it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 6) -> None:
    """doubles: the result's double columns; both sides round them once, at the very end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        return df.select(*[(F.round(c, digits) + 0.0).alias(c) if isinstance(df.schema[c].dataType, DoubleType) else F.col(c) for c in df.columns])

    QUERIES[name] = run
    if sql is not None:
        replaced = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
        SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql.strip()}) AS result" if replaced else sql.strip()


def _load() -> None:
    from tallystone.plans import queries_bars, queries_engine, queries_joins, queries_metrics, queries_signals  # noqa: F401  each registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
