"""Joins: pools with tokens, swaps with pools, logs with blocks and with routing rules, values in USD."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.hexwords import limb_array, times
from ledgerlake.sources.logs import read_by_address

_TOKEN = ("id", "symbol", "name", "decimals")


def with_tokens(pools: DataFrame, tokens: DataFrame) -> DataFrame:
    """token0 and token1 as structs of id, symbol, name, decimals; null where the token is unknown.

    Plain left joins: Spark broadcasts the tokens where their size allows it, and shuffles otherwise.
    """
    out = pools
    for side in ("token0", "token1"):
        other = tokens.select(F.col("id").alias(f"{side}_id"), F.struct(*_TOKEN).alias(f"{side}_row"))
        out = out.join(other, F.col(side) == F.col(f"{side}_id"), "left").drop(side, f"{side}_id").withColumnRenamed(f"{side}_row", side)
    return out


def with_pools(swaps: DataFrame, pools: DataFrame, tokens: DataFrame) -> DataFrame:
    """swaps with ``pool_id`` (always) and ``pool`` (a struct with both tokens; null where unknown)."""
    full = with_tokens(pools, tokens)
    full = full.select(F.col("id").alias("found_id"), F.struct(*full.columns).alias("pool"))
    named = swaps.withColumnRenamed("pool", "pool_id")
    return named.join(full, F.col("pool_id") == F.col("found_id"), "left").drop("found_id")


def with_block_time(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Unix seconds from the blocks table, null where the block is unknown; the block number stays."""
    times = blocks.select(F.col("number").alias("block_number"), F.col("timestamp").alias("block_time"))
    return logs.join(times, "block_number", "left").drop("timestamp").withColumnRenamed("block_time", "timestamp")


def route(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Logs with the handlers that a manifest names for them.

    ``rules``: source, handler, topic0, address (null: any), start_block. The signature is the join
    key, address and block range are conditions; the rules come from a manifest, and Spark decides by
    their size whether to broadcast them.
    """
    r = rules.select("source", "handler", F.col("topic0").alias("r_topic"), F.col("address").alias("r_address"), "start_block")
    on = (F.col("topic0") == F.col("r_topic")) & (F.col("r_address").isNull() | (F.col("r_address") == F.col("address"))) & (F.col("block_number") >= F.col("start_block"))
    return logs.join(r, on).drop("r_topic", "r_address", "start_block")


def route_stored(spark: SparkSession, path: str, rules: DataFrame) -> DataFrame:
    """``route`` over logs that ``sources.logs.write_logs_by_address`` stored, reading the folders that some rule can match.

    Rules with an address read that address's share of their signature, those without all of it. Only
    signatures, addresses and first blocks of the rules come to the driver: a manifest's worth.
    """
    listed = rules.select("topic0", "address", "start_block").distinct().collect()
    open_to_all = {r["topic0"] for r in listed if r["address"] is None}
    named = {r["topic0"] for r in listed} - open_to_all
    first = {kind: min((r["start_block"] for r in listed if r["topic0"] in kind), default=None) for kind in (frozenset(open_to_all), frozenset(named))}
    parts = [read_by_address(spark, path, open_to_all, None, first[frozenset(open_to_all)])] if open_to_all else []
    parts += [read_by_address(spark, path, named, {r["address"] for r in listed if r["topic0"] in named}, first[frozenset(named)])] if named else []
    logs = parts[0].unionByName(parts[1]) if len(parts) == 2 else (parts or [read_by_address(spark, path, [])])[0]
    return route(logs, rules)


def from_announced_pools(logs: DataFrame, pools: DataFrame) -> DataFrame:
    """Logs of pools that were announced at or before the log's block."""
    first = pools.groupBy(F.col("id").alias("p_id")).agg(F.min("created_block").alias("p_block"))
    return logs.join(first, (F.col("address") == F.col("p_id")) & (F.col("block_number") >= F.col("p_block")), "left_semi")


def value_in_usd(swaps: DataFrame, pools: DataFrame, tokens: DataFrame, bundles: DataFrame) -> DataFrame:
    """amountUSD = |amount0| / 10^decimals * derivedETH of token0 * ethPriceUSD, exact, rounded half up to DECIMAL(38, 6) as text.

    Amounts have up to 78 digits and prices 18 places, so the product is made of limbs and the point is set
    at its end. Null where pool, token or price is unknown or negative, a price is beyond DECIMAL(38, 18), or the
    value is 10^31 or more. The bundle is the one row with id "1".
    """
    digits = "coalesce(nullif(trim(LEADING '0' FROM replace(CAST({} AS STRING), '.', '')), ''), '0')".format
    prices = tokens.select(F.col("id").alias("t_id"), F.col("decimals").alias("t_dec"), F.col("derivedETH").try_cast("decimal(38,18)").alias("t_eth"))
    first = pools.select(F.col("id").alias("p_id"), F.col("token0").alias("p_token0"))
    price = bundles.where("id = '1'").select(F.col("ethPriceUSD").try_cast("decimal(38,18)").alias("b_usd")).limit(1)
    # pools and tokens meet first, so that the large side is joined once; the price of a pool's token is made there
    valued = first.join(prices, F.col("p_token0") == F.col("t_id"), "left").crossJoin(F.broadcast(price)).where("t_eth >= 0 AND b_usd >= 0 AND t_dec BETWEEN 0 AND 255")  # one row by limit(1)
    limbs = valued.select("p_id", "t_dec", limb_array(digits("t_eth")).alias("p_a"), limb_array(digits("b_usd")).alias("p_b"))
    priced = limbs.select("p_id", "t_dec", F.expr(times(("p_a", "p_b"))).alias("p_digits")).select("p_id", "t_dec", limb_array("p_digits").alias("p_price"))
    out = swaps.join(priced, F.col("pool") == F.col("p_id"), "left").withColumn("p_amount", limb_array("trim(LEADING '-' FROM amount0)"))
    places = "(t_dec + 36)"  # 18 of either price
    product = out.withColumn("p_value", F.expr(f"lpad({times(('p_amount', 'p_price'))}, greatest(160, CAST({places} AS INT) + 1), '0')"))
    whole = f"trim(LEADING '0' FROM left(p_value, length(p_value) - CAST({places} AS INT)))"
    text = f"concat('0', {whole}, '.', substring(p_value, length(p_value) - CAST({places} AS INT) + 1, 7))"
    usd = F.expr(f"CASE WHEN length({whole}) <= 31 AND amount0 IS NOT NULL THEN CAST(CAST({text} AS DECIMAL(38,7)) AS DECIMAL(38,6)) END")
    return product.withColumn("amountUSD", usd.cast("string")).drop("p_id", "t_dec", "p_price", "p_amount", "p_value")
