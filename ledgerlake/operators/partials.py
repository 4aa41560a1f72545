"""Rollups from mergeable states, so that new blocks cost what they hold.

A state is what swaps of one key, hour and span of blocks amount to: counts, sums in limbs, the first and last
price with their place in the log, the highest and the lowest. Merging states is associative and does not
depend on order, so spans merge to hours, hours to days, days to totals, and none of them reads swaps again.
``streaming.index`` keeps a table of states beside the swaps, partition for partition (by ``block_number``, a state's first block): a span that is new or
comes again has its own states computed again, and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.hexwords import limb_sums, render
from ledgerlake.operators.rollups import DAY, HOUR, _magnitude, _total, _usd_total, bucket, by_token, price, with_fees

_LIMBS = range(5)


def state_columns(amounts: Sequence[str]) -> list[Column]:
    """The aggregates that make a state of rows with a ``price``."""
    place = F.when(F.col("price").isNotNull(), F.struct("block_number", "log_order", "id", "price"))
    limbs = [x.alias(f"{a}_{j}") for a in amounts for j, x in enumerate(limb_sums(_magnitude(a)))]
    return [F.count("*").alias("txCount"), _usd_total("amountUSD").alias("volumeUSD"), F.min(place).alias("first"), F.max(place).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.min("block_number").alias("block_number"), *limbs]


def merged_columns(states: DataFrame) -> list[Column]:
    """The aggregates that make one state of several."""
    limbs = [F.sum(c).cast("decimal(38,0)").alias(c) for c in states.columns if c.rsplit("_", 1)[-1].isdigit()]
    return [F.sum("txCount").alias("txCount"), _total(F.col("volumeUSD"), F.col("volumeUSD").isNull()).alias("volumeUSD"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.min("block_number").alias("block_number"), *limbs]


def _states(rows: DataFrame, keys: Sequence[str], amounts: Sequence[str], priced_at: Column, span: int | None) -> DataFrame:
    spans = [F.floor(F.col("block_number") / span).alias("span")] if span else []
    return rows.withColumn("hour", bucket(HOUR)).withColumn("price", priced_at).groupBy(*keys, "hour", *spans).agg(*state_columns(amounts)).drop("span")


def pool_states(swaps: DataFrame, span: int | None = None, amounts: Sequence[str] = ("amount0", "amount1")) -> DataFrame:
    """A state for every pool and hour of ``swaps``, which have unix seconds in ``timestamp`` and text in ``amountUSD``.

    Give ``span`` where the states are kept by spans of so many blocks: an hour's states then never hold blocks of two spans.
    ``amounts`` are those whose sums are kept, five decimals each; totals read them, hours and days none.
    """
    return _states(swaps, ["pool"], amounts, price(), span)


def token_states(swaps: DataFrame, pools: DataFrame, span: int | None = None, amounts: Sequence[str] = ("amount",)) -> DataFrame:
    """A state for every token and hour; a swap counts for both of its tokens. ``span`` and ``amounts`` as above."""
    return _states(by_token(swaps, pools), ["token"], amounts, price("amount", "other"), span)


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """One state for each value of ``by``, in the same columns; merging merged states gives what merging all of them would."""
    return states.groupBy(*by).agg(*merged_columns(states))


def merge_periods(states: DataFrame, key: str, seconds: int = DAY, label: str = "date") -> DataFrame:
    """States of hours (of any number of spans) to those of longer periods."""
    return merge_states(states.withColumn(label, bucket(seconds, "hour")), key, label)


def with_prices(states: DataFrame) -> DataFrame:
    return states.withColumns({"open": F.col("first.price"), "close": F.col("last.price")})


def pool_period(states: DataFrame, pools: DataFrame, seconds: int = DAY, label: str = "date") -> DataFrame:
    """What ``rollups.pool_period`` gives over the swaps of all states."""
    merged = with_fees(with_prices(merge_periods(states, "pool", seconds, label)), pools)
    return merged.select("pool", label, "txCount", "volumeUSD", "open", "high", "low", "close", "feesUSD", F.concat_ws("-", "pool", F.col(label).cast("string")).alias("id"))


def token_period(states: DataFrame, seconds: int = DAY, label: str = "date") -> DataFrame:
    """What ``rollups.token_period`` gives over the swaps of all states."""
    merged = with_prices(merge_periods(states, "token", seconds, label))
    return merged.select("token", label, "txCount", "volumeUSD", "open", "high", "low", "close", F.concat_ws("-", "token", F.col(label).cast("string")).alias("id"))


def _amount(name: str) -> Column:
    return F.expr(render("array(" + ", ".join(f"{name}_{j}" for j in _LIMBS) + ")"))


def pool_totals(states: DataFrame, pools: DataFrame) -> DataFrame:
    """What ``rollups.pool_totals`` gives over the swaps of all states, which may be of hours or of longer periods."""
    merged = with_fees(merge_states(states, "pool"), pools)
    return merged.select(F.col("pool").alias("id"), "txCount", _amount("amount0").alias("volumeToken0"), _amount("amount1").alias("volumeToken1"), "volumeUSD", "feesUSD")
