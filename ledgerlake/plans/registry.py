"""Where queries and their SQL are registered, and SQL for the hex forms that the logs carry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register the function below under its name, with the SQL that it must equal."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


ADDRESS = "('0x' || format('{{:040x}}', CAST({} AS BIGINT)))".format
TOPIC = "('0x' || format('{{:064x}}', CAST({} AS BIGINT)))".format
CENTS = "CAST(round({} * 100) AS BIGINT)".format


def huge(n: str) -> str:
    """Decimal text of n * 2^128, in two parts that fit DuckDB's integers: 2^128 is 340282366920938463463 * 10^18 + 374607431768211456."""
    m, low = f"abs({n})::HUGEINT", "374607431768211456::HUGEINT"
    digits = f"CAST({m} * 340282366920938463463::HUGEINT + ({m} * {low}) // 1000000000000000000::HUGEINT AS VARCHAR) || lpad(CAST({m} * {low} % 1000000000000000000::HUGEINT AS VARCHAR), 18, '0')"
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || CASE WHEN {n} = 0 THEN '0' ELSE {digits} END)"
