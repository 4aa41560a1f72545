"""Exchange events: swaps, pools, tokens, liquidity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode.base import address, net, sint, small_int, swap_id, take, topic, topic_int, topic_uint, uint, where_event, word, word_address
from ledgerlake.functions import hexwords as hx

DEFAULT_FEE = 3000


def _swap(logs: DataFrame, pool, sender, amount0, amount1, *more) -> DataFrame:
    return take(logs, swap_id().alias("id"), F.col("block_number").alias("timestamp"), pool.alias("pool"), amount0.alias("amount0"), amount1.alias("amount1"), F.lit("0").alias("amountUSD"), sender.alias("sender"), "block_number", "log_order", *more)


def swaps_v2(logs: DataFrame) -> DataFrame:
    """amounts are what came in less what went out; ``timestamp`` is the block number until blocks are joined."""
    return _swap(where_event(logs, t.SWAP_V2), F.col("address"), F.coalesce(address(1), F.lit("")), net(0, 2), net(1, 3))


def swaps_v3(logs: DataFrame, signed: bool = True) -> DataFrame:
    """``signed=False`` reads the amounts as unsigned words, under which a negative one is close to 2^256."""
    amount = sint if signed else uint
    return _swap(where_event(logs, t.SWAP_V3), F.col("address"), F.coalesce(address(1), F.lit("")), amount(0), amount(1))


def swaps_v4(logs: DataFrame) -> DataFrame:
    more = (uint(2).alias("sqrtPriceX96"), uint(3).alias("liquidity"), small_int(4).alias("tick"))
    return _swap(where_event(logs, t.SWAP_V4, 3), topic(1), address(2), sint(0), sint(1), *more)


def all_swaps(logs: DataFrame) -> DataFrame:
    """Swaps of all three generations in one table."""
    return swaps_v2(logs).unionByName(swaps_v3(logs)).unionByName(swaps_v4(logs), allowMissingColumns=True)


def pools(logs: DataFrame) -> DataFrame:
    """Pools announced by pair and pool factories: id, token0, token1, feeTier, created_block; none from data of under a word."""
    pairs = where_event(logs, t.PAIR_CREATED, 3).where(F.length(hx.strip0x(F.col("data"))) >= 64)
    pair = take(pairs, word_address(0).alias("id"), address(1).alias("token0"), address(2).alias("token1"), F.lit(DEFAULT_FEE).cast("long").alias("feeTier"), "block_number", "log_order")
    created = where_event(logs, t.POOL_CREATED, 4).where(F.length(hx.strip0x(F.col("data"))) >= 64)
    pool = take(created, F.concat(F.lit("0x"), F.substring("data", -40, 40)).alias("id"), address(1).alias("token0"), address(2).alias("token1"), F.coalesce(topic_int(3), F.lit(0).cast("long")).alias("feeTier"), "block_number", "log_order")
    return pair.unionByName(pool).withColumn("created_block", F.col("block_number"))


def tokens(logs: DataFrame) -> DataFrame:
    """Distinct tokens seen in pool creations and transfers; names are placeholders from the address."""
    seen = pools(logs).select(F.explode(F.array("token0", "token1")).alias("id"))
    moved = where_event(logs, t.TRANSFER, 3).select(F.col("address").alias("id"))
    # distinct before the rows are built: transfers are many, emitting addresses few
    return seen.unionByName(moved).distinct().select("id", F.substring("id", 1, 8).alias("symbol"), F.col("id").alias("name"), F.lit(18).cast("long").alias("decimals"))


def _liquidity(logs: DataFrame, **columns) -> DataFrame:
    return take(logs, swap_id().alias("id"), F.col("address").alias("pool"), *(c.alias(n) for n, c in columns.items()), "block_number", "log_order")


def mints(logs: DataFrame) -> DataFrame:
    none, tick = F.lit(None).cast("string"), F.lit(None).cast("long")
    v2 = _liquidity(where_event(logs, t.MINT_V2, 2), owner=none, sender=address(1), tickLower=tick, tickUpper=tick, amount=none, amount0=uint(0), amount1=uint(1))
    v3 = _liquidity(where_event(logs, t.MINT_V3, 4), owner=address(1), sender=word_address(0), tickLower=topic_int(2), tickUpper=topic_int(3), amount=uint(1), amount0=uint(2), amount1=uint(3))
    return v2.unionByName(v3)


def burns(logs: DataFrame) -> DataFrame:
    none, tick = F.lit(None).cast("string"), F.lit(None).cast("long")
    v2 = _liquidity(where_event(logs, t.BURN_V2, 3), owner=none, sender=address(1), to=address(2), tickLower=tick, tickUpper=tick, amount=none, amount0=uint(0), amount1=uint(1))
    v3 = _liquidity(where_event(logs, t.BURN_V3, 4), owner=address(1), sender=none, to=none, tickLower=topic_int(2), tickUpper=topic_int(3), amount=uint(0), amount0=uint(1), amount1=uint(2))
    return v2.unionByName(v3)


def syncs(logs: DataFrame) -> DataFrame:
    return _liquidity(where_event(logs, t.SYNC), reserve0=uint(0), reserve1=uint(1))


def collects(logs: DataFrame) -> DataFrame:
    return _liquidity(where_event(logs, t.COLLECT, 4), owner=address(1), tickLower=topic_int(2), tickUpper=topic_int(3), recipient=word_address(0), amount0=uint(1), amount1=uint(2))


def flashes(logs: DataFrame) -> DataFrame:
    return _liquidity(where_event(logs, t.FLASH, 3), sender=address(1), recipient=address(2), amount0=uint(0), amount1=uint(1), paid0=uint(2), paid1=uint(3))


def initializations(logs: DataFrame) -> DataFrame:
    """Price state that pools start with, of both generations; the newer one names the pool by a topic."""
    old = take(where_event(logs, t.INITIALIZE), F.col("address").alias("pool"), uint(0).alias("sqrtPriceX96"), small_int(1).alias("tick"), "block_number", "log_order")
    new = take(where_event(logs, t.INITIALIZE_V4, 4), topic(1).alias("pool"), address(2).alias("currency0"), address(3).alias("currency1"), uint(0).alias("fee"), small_int(1).alias("tickSpacing"), word_address(2).alias("hooks"), uint(3).alias("sqrtPriceX96"), small_int(4).alias("tick"), "block_number", "log_order")
    return old.unionByName(new, allowMissingColumns=True)


def liquidity_changes(logs: DataFrame) -> DataFrame:
    """Singleton-pool liquidity: a positive delta is a mint, a negative one a burn."""
    return take(where_event(logs, t.MODIFY_LIQUIDITY, 3), swap_id().alias("id"), topic(1).alias("pool"), address(2).alias("sender"), small_int(0).alias("tickLower"), small_int(1).alias("tickUpper"), sint(2).alias("liquidityDelta"), F.concat(F.lit("0x"), F.col(word(3))).alias("salt"), "block_number", "log_order")


def subscriptions(logs: DataFrame) -> DataFrame:
    kinds = (t.SUBSCRIPTION, t.UNSUBSCRIPTION)
    return take(where_event(logs, kinds, 3), swap_id().alias("id"), F.when(F.col("topic0") == t.SUBSCRIPTION, "subscribed").otherwise("unsubscribed").alias("kind"), topic_uint(1).alias("tokenId"), address(2).alias("address"), "block_number", "log_order")


def transfers(logs: DataFrame) -> DataFrame:
    """Three topics: a fungible transfer with a value; four: a token id."""
    unique = F.size("topics") >= 4
    return take(where_event(logs, t.TRANSFER, 3), swap_id().alias("id"), F.col("address").alias("token"), address(1).alias("from"), address(2).alias("to"), F.when(~unique, uint(0)).alias("value"), F.when(unique, topic_uint(3)).alias("tokenId"), "block_number", "log_order")


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


