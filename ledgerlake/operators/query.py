"""Get, filter, order, limit: the list and get queries over typed tables."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.hexwords import number

DEFAULT_LIMIT, DAILY_LIMIT, HOURLY_LIMIT, MOST = 100, 30, 24, 1000
_SUFFIXES = ("_gte", "_lte", "_gt", "_lt")


def compare(a: Column, b: Any, op: str) -> Column:
    """Numeric where both sides read as floats, else by text; ``op`` is eq, gt, gte, lt or lte."""
    right = b if isinstance(b, Column) else F.lit(b)
    tests = {"eq": lambda x, y: x == y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}
    test = tests[op]
    x, y = number(a), number(right)
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(a.cast("string"), right.cast("string")))


def suffix_of(key: str) -> str:
    """The comparison that a condition's key ends with; empty for equality."""
    return next((s for s in _SUFFIXES if key.endswith(s)), "")


def where(rows: DataFrame, conditions: Mapping[str, Any] | None) -> DataFrame:
    """AND of conditions; a suffix _gte _lte _gt _lt compares, anything else is a field that must be equal.

    A row without the field is dropped, so an unknown field keeps nothing; no conditions keep all.
    """
    out = []
    for key, value in (conditions or {}).items():
        suffix = suffix_of(key)
        name = key[: len(key) - len(suffix)]
        out.append(F.coalesce(compare(F.col(name), value, suffix[1:] or "eq"), F.lit(False)) if name in rows.columns else F.lit(False))
    return rows.where(reduce(lambda a, b: a & b, out)) if out else rows


def order_by(rows: DataFrame, column: str | None, direction: str = "asc") -> DataFrame:
    """Numbers first by value, then text; ``desc`` in any case descends, anything else ascends; ties by id.

    A missing column leaves the order as it is.
    """
    if column is None or column not in rows.columns:
        return rows
    keys = [number(F.col(column)), F.col(column)]
    down = str(direction).lower() == "desc"
    sorts = [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]
    return rows.orderBy(*sorts, *([F.col("id")] if "id" in rows.columns and column != "id" else []))


def clamp(first: Any, default: int = DEFAULT_LIMIT) -> int:
    """1 to 1000; the default for what does not begin with a whole number of 64 bits.

    Text counts as far as its leading digits go (2.9 is 2, 7abc is 7), a float by its whole part.
    """
    if isinstance(first, bool) or not isinstance(first, (int, float, str)) or (isinstance(first, float) and not math.isfinite(first)):
        return default
    digits = re.match(r"\s*([+-]?[0-9]+)", first if isinstance(first, str) else str(int(first)))
    n = int(digits[1]) if digits else default
    return max(1, min(MOST, n if -(2**63) <= n < 2**63 else default))


def get(rows: DataFrame, ident: Any, key: str = "id") -> DataFrame:
    """One row or none."""
    return rows.where(F.col(key) == ident).limit(1)


def get_factory(factories: DataFrame, ident: str = "1") -> DataFrame:
    return get(factories, ident)


def get_bundle(bundles: DataFrame) -> DataFrame:
    """The native price, also under its older name."""
    return get(bundles, "1").withColumn("ethPrice", F.col("ethPriceUSD"))


def list_rows(rows: DataFrame, first: Any = None, order: str | None = None, direction: str = "asc", conditions: Mapping[str, Any] | None = None, default: int = DEFAULT_LIMIT) -> DataFrame:
    """Filter, then sort, then limit: planned as one top-k without a full sort."""
    return order_by(where(rows, conditions), order, direction).limit(clamp(first, default))


def recent_swaps(swaps: DataFrame, first: Any = None, order: str = "timestamp", direction: str = "desc", conditions: Mapping[str, Any] | None = None) -> DataFrame:
    return list_rows(swaps, first, order, direction, conditions)


def select_as(rows: DataFrame, **names: str) -> DataFrame:
    """Column selection and rename: ``select_as(t, id="id", tvl="totalValueLockedUSD")``."""
    return rows.select(*[F.col(c).alias(n) for n, c in names.items()])


def list_all(rows: DataFrame) -> DataFrame:
    """Factories, pool managers (which are the factories' rows) and bundles: every row, whatever limit is asked for, in no order."""
    return rows


def latest_block(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.max_by(F.struct(*blocks.columns), "number").alias("b")).where("b IS NOT NULL").select("b.*")


def get_block(blocks: DataFrame, number: int | None = None, block_hash: str | None = None) -> DataFrame:
    """By number, else by hash; one row or none."""
    return get(blocks, number, "number") if number is not None else get(blocks, block_hash, "hash")


def list_blocks(blocks: DataFrame, first: Any = None) -> DataFrame:
    """Newest first: 25 by default, 1000 at most."""
    return blocks.orderBy(F.desc("number")).limit(clamp(first, 25))


def list_transactions(transactions: DataFrame, first: Any = None) -> DataFrame:
    """Newest first, ties by hash: 25 by default, 1000 at most."""
    return transactions.orderBy(F.desc("block_number"), "hash").limit(clamp(first, 25))


def get_transaction(transactions: DataFrame, tx_hash: str) -> DataFrame:
    return get(transactions, tx_hash, "hash")
