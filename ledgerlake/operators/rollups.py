"""Totals and time series over decoded tables.

Amounts are decimal text of up to 256 bits and are summed exactly, in limbs of 10^18; totals are text
too. Values in USD are DECIMAL(38, 18), null where a total does not fit. First and last values come from min_by and max_by, which
combine before the shuffle, not from sorted windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.hexwords import fixed_point, number, sum_digits, with_point

DAY, HOUR = 86_400, 3_600


def _magnitude(amount: str) -> str:
    return f"trim(LEADING '-' FROM {amount})"


def _total(fits: Column, misfit: Column) -> Column:
    """Sum of DECIMAL(38, 18), 0 for no rows; null where a value or the sum does not fit, instead of an error or less than the sum."""
    return F.when(F.bool_or(misfit), None).when(F.count(fits) == 0, 0).otherwise(F.try_sum(fits)).cast("decimal(38,18)")


def _usd_total(c: str) -> Column:
    """Sum of magnitudes of text: null where one is a number beyond DECIMAL(38, 18), which any log can say; what is no number counts nothing."""
    fits = F.col(c).try_cast("decimal(38,18)")
    return _total(F.abs(fits), fits.isNull() & number(F.col(c)).isNotNull())


def _usd_sum() -> Column:
    return _usd_total("amountUSD").alias("volumeUSD")


def _fees_usd() -> Column:
    """volumeUSD * feeTier / 10^6; null for an unknown tier and for one of 10^12 or more, which no pool can have but any log can say."""
    share = F.when(F.abs("feeTier") < 10**12, F.col("feeTier") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(12,6)")
    return F.try_multiply("volumeUSD", share).alias("feesUSD")


def bucket(seconds: int, column: str = "timestamp") -> Column:
    return (F.floor(F.col(column) / seconds) * seconds).cast("long")


def _fees(pools: DataFrame) -> DataFrame:
    return pools.select(F.col("id").alias("pool"), "feeTier")


def pool_totals(swaps: DataFrame, pools: DataFrame) -> DataFrame:
    """id, txCount, volumeToken0, volumeToken1, volumeUSD, feesUSD (volume * feeTier / 10^6)."""
    sums = swaps.groupBy("pool").agg(F.count("*").alias("txCount"), sum_digits(_magnitude("amount0")).alias("volumeToken0"), sum_digits(_magnitude("amount1")).alias("volumeToken1"), _usd_sum())
    return sums.join(_fees(pools), "pool", "left").select(F.col("pool").alias("id"), "txCount", "volumeToken0", "volumeToken1", "volumeUSD", _fees_usd())


def by_token(swaps: DataFrame, pools: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per swap, one for either token: token, amount, what the swap carries, and the columns to ``keep``."""
    sides = pools.select(F.col("id").alias("pool"), "token0", "token1")
    rows = swaps.select("id", "pool", "timestamp", "amount0", "amount1", "amountUSD", "block_number", "log_order", *keep).join(sides, "pool")
    side = F.explode(F.array(F.struct(F.col("token0").alias("token"), F.col("amount0").alias("amount"), F.col("amount1").alias("other")), F.struct(F.col("token1").alias("token"), F.col("amount1").alias("amount"), F.col("amount0").alias("other"))))
    return rows.select("id", "pool", "timestamp", "amountUSD", "block_number", "log_order", *keep, side.alias("s")).select("*", "s.token", "s.amount", "s.other").drop("s")


def token_totals(swaps: DataFrame, pools: DataFrame) -> DataFrame:
    """id, txCount, volume, volumeUSD, poolCount; a swap counts for both of its tokens."""
    traded = by_token(swaps, pools).groupBy("token").agg(F.count("*").alias("txCount"), sum_digits(_magnitude("amount")).alias("volume"), _usd_sum())
    listed = pools.select(F.explode(F.array_distinct(F.array("token0", "token1"))).alias("token"), "id").distinct().groupBy("token").agg(F.count("*").alias("poolCount"))
    return listed.join(traded, "token", "full").select(F.col("token").alias("id"), F.coalesce("txCount", F.lit(0)).alias("txCount"), F.coalesce("volume", F.lit("0")).alias("volume"), F.when(F.col("txCount").isNull(), F.lit(0)).otherwise(F.col("volumeUSD")).cast("decimal(38,18)").alias("volumeUSD"), F.coalesce("poolCount", F.lit(0)).alias("poolCount"))


def factory_totals(pools: DataFrame, totals: DataFrame) -> DataFrame:
    """One row over all pools; ``totals`` from pool_totals, locked values from the pools."""
    locked = pools.agg(F.count("*").alias("poolCount"), _usd_total("totalValueLockedUSD").alias("totalValueLockedUSD"))
    traded = totals.agg(F.coalesce(F.sum("txCount"), F.lit(0)).alias("txCount"), _total(F.col("volumeUSD"), F.col("volumeUSD").isNull()).alias("totalVolumeUSD"))
    return locked.crossJoin(traded).select(F.lit("1").alias("id"), "poolCount", "txCount", "totalVolumeUSD", "totalValueLockedUSD")  # one row with one row


def price(base: str = "amount0", quote: str = "amount1") -> Column:
    """|quote| / |base|; null where the base is 0."""
    b = F.abs(F.col(base).try_cast("double"))
    return F.when(b > 0, F.abs(F.col(quote).try_cast("double")) / b)


def ohlc(rows: DataFrame, keys: list[str], priced_at: Column) -> DataFrame:
    """Per key: txCount, volumeUSD, and the first, highest, lowest and last price in log order."""
    priced = rows.withColumn("price", priced_at)
    seen = F.when(F.col("price").isNotNull(), F.struct("block_number", "log_order", "id"))
    return priced.groupBy(*keys).agg(F.count("*").alias("txCount"), _usd_sum(), F.min_by("price", seen).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seen).alias("close"))


def with_fees(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """feesUSD by the fee tier of ``pool``; null where the pool is unknown."""
    return rows.join(_fees(pools), "pool", "left").withColumn("feesUSD", _fees_usd()).drop("feeTier")


def pool_period(swaps: DataFrame, pools: DataFrame, seconds: int = DAY, label: str = "date") -> DataFrame:
    """Per pool and day (or hour): txCount, volumeUSD, feesUSD, open, high, low, close."""
    out = with_fees(ohlc(swaps.withColumn(label, bucket(seconds)), ["pool", label], price()), pools)
    return out.withColumn("id", F.concat_ws("-", "pool", F.col(label).cast("string")))


def token_period(swaps: DataFrame, pools: DataFrame, seconds: int = DAY, label: str = "date") -> DataFrame:
    """Per token and day (or hour), over swaps unpivoted to their two tokens."""
    out = ohlc(by_token(swaps, pools).withColumn(label, bucket(seconds)), ["token", label], price("amount", "other"))
    return out.withColumn("id", F.concat_ws("-", "token", F.col(label).cast("string")))


def pair_period(swaps: DataFrame, syncs: DataFrame, seconds: int = DAY, label: str = "date") -> DataFrame:
    """Per pair and day (or hour): volumeUSD, txns, and the reserves of the period's last sync."""
    traded = swaps.withColumn(label, bucket(seconds)).groupBy(F.col("pool").alias("pair"), label).agg(F.count("*").alias("txns"), _usd_sum())
    at = F.struct("block_number", "log_order")
    closing = syncs.withColumn(label, bucket(seconds)).groupBy(F.col("pool").alias("pair"), label).agg(F.max_by("reserve0", at).alias("reserve0"), F.max_by("reserve1", at).alias("reserve1"))
    return traded.join(closing, ["pair", label], "left")


def factory_period(pool_rows: DataFrame, label: str = "date") -> DataFrame:
    """All pools of a period, from the pools' own rows (hours and pools are added up, swaps are not read again)."""
    return pool_rows.groupBy(label).agg(*factory_columns())


def factory_columns() -> list[Column]:
    return [F.sum("txCount").alias("txCount"), _total(F.col("volumeUSD"), F.col("volumeUSD").isNull()).alias("volumeUSD"), F.try_sum("feesUSD").alias("feesUSD")]


def tick_liquidity(mints: DataFrame, burns: DataFrame) -> DataFrame:
    """Per pool and tick: liquidityGross, liquidityNet (plus at the lower end, minus at the upper; reversed for burns), price0."""
    columns = ["pool", "tickLower", "tickUpper", "amount"]
    both = mints.select(*columns, F.lit(1).alias("sign")).unionByName(burns.select(*columns, F.lit(-1).alias("sign"))).where("tickLower IS NOT NULL AND tickUpper IS NOT NULL")
    # a position's liquidity is summed once, and its sum goes to its two ends
    positions = both.groupBy("pool", "tickLower", "tickUpper", "sign").agg(sum_digits("amount").alias("amount"))
    ends = positions.select("pool", "sign", "amount", F.explode(F.array(F.struct(F.col("tickLower").alias("tick"), F.lit(1).alias("end")), F.struct(F.col("tickUpper").alias("tick"), F.lit(-1).alias("end")))).alias("e"))
    return ends.groupBy("pool", F.col("e.tick").alias("tick")).agg(sum_digits("amount").alias("liquidityGross"), sum_digits("IF(sign * e.end < 0, concat('-', amount), amount)").alias("liquidityNet")).withColumn("price0", F.pow(F.lit(1.0001), F.col("tick").cast("double")))


def pool_extras(collects: DataFrame, mints: DataFrame) -> DataFrame:
    """Collected fees and the number of liquidity providers of every pool (exact, in two steps)."""
    fees = collects.groupBy("pool").agg(sum_digits("amount0").alias("collectedFees0"), sum_digits("amount1").alias("collectedFees1"))
    providers = mints.select("pool", F.coalesce("owner", "sender").alias("lp")).distinct().groupBy("pool").agg(F.count("*").alias("liquidityProviderCount"))
    return providers.join(fees, "pool", "full")


def provider_sketches(mints: DataFrame, log_k: int = 12) -> DataFrame:
    """A theta sketch of the liquidity providers of every pool and day, of at most 2^(log_k + 3) bytes or so.

    Days that come anew are sketched alone; sketches are merged over any span by ``merge_providers``.
    """
    return mints.withColumn("date", bucket(DAY)).groupBy("pool", "date").agg(F.theta_sketch_agg(F.coalesce("owner", "sender"), log_k).alias("sketch"))


def merge_providers(sketches: DataFrame, *by: str, log_k: int = 12) -> DataFrame:
    """One sketch for each value of ``by``, and the number of distinct ``providers`` it stands for.

    Exact up to 2^log_k of them; beyond, the standard error is 1 / sqrt(2^log_k), 1.6 % at 12.
    """
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", log_k).alias("sketch")).withColumn("providers", F.theta_sketch_estimate("sketch"))


def shared_providers(a: str, b: str) -> Column:
    """Providers that two sketches have in common, estimated; exact where both are."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def proposal_tally(votes: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Per (contract, proposal): againstVotes, forVotes, abstainVotes, votes, and the latest status."""
    def weight(k: int) -> Column:
        return sum_digits(f"IF(support = {k}, weight, '0')")

    tally = votes.groupBy("contract", "proposal").agg(weight(0).alias("againstVotes"), weight(1).alias("forVotes"), weight(2).alias("abstainVotes"), F.count("*").alias("votes"))
    if proposals is None:
        return tally
    status = proposals.groupBy("contract", "proposal").agg(F.max_by("event", F.struct("block_number", "log_order")).alias("status"))
    return status.join(tally, ["contract", "proposal"], "full")


def _one_of(events: tuple[str, ...]) -> str:
    return "event IN (" + ", ".join(f"'{e}'" for e in events) + ")"


def balances(events: DataFrame, account: str, plus: tuple[str, ...], minus: tuple[str, ...]) -> DataFrame:
    """Per (contract, account): sum of amounts of ``plus`` events less ``minus`` events, as text."""
    signed = f"CASE WHEN {_one_of(plus)} THEN amount WHEN {_one_of(minus)} THEN concat('-', amount) END"
    return events.where(F.col("event").isin(*plus, *minus)).groupBy("contract", F.col(account).alias("account")).agg(sum_digits(signed).alias("balance"), F.count("*").alias("events"))


def karma_balances(karma: DataFrame) -> DataFrame:
    return balances(karma, "account", ("minted",), ("slashed", "decayed"))


def stake_balances(stakes: DataFrame) -> DataFrame:
    return balances(stakes, "user", ("staked",), ("unstaked",))


def locked_balances(locks: DataFrame) -> DataFrame:
    return balances(locks, "user", ("deposit",), ("withdraw",))


def treasury_flows(vaults: DataFrame) -> DataFrame:
    """Per contract and chain: received, flushed, and what is left, as text."""
    received, flushed = (sum_digits(f"CASE WHEN event = '{e}' THEN amount END").alias(n) for e, n in (("receive", "received"), ("flush", "flushed")))
    net = sum_digits("CASE event WHEN 'receive' THEN amount WHEN 'flush' THEN concat('-', amount) END").alias("net")
    return vaults.groupBy("contract", "chain").agg(received, flushed, net)


def router_shares(routers: DataFrame) -> DataFrame:
    """Per contract and recipient: the latest weight, its share of all weights, and the sum of claims; amounts are text."""
    at = F.struct("block_number", "log_order")
    rows = routers.where("recipient IS NOT NULL").groupBy("contract", "recipient").agg(F.max_by("weight", F.when(F.col("event") == "weight", at)).alias("weight"), sum_digits("CASE WHEN event = 'claim' THEN amount END").alias("claimed"))
    total = rows.groupBy("contract").agg(sum_digits("weight").cast("double").alias("all"))
    return rows.join(total, "contract").withColumn("share", F.when(F.col("all") > 0, F.col("weight").cast("double") / F.col("all"))).drop("all")


def liquid_totals(events: DataFrame) -> DataFrame:
    """Per contract and fee type (null for events without one): sums of every amount column by event, as text."""
    def total(event: str, column: str) -> Column:
        return sum_digits(f"CASE WHEN event = '{event}' THEN {column} END")

    return events.groupBy("contract", "feeType").agg(total("fees_received", "amount").alias("fees"), total("fees_received", "perfFee").alias("perfFee"), total("fees_received", "toReserve").alias("toReserve"), total("validator_rewards", "amount").alias("rewards"), total("slashing", "amount").alias("slashed"), total("slashing", "socialized").alias("socialized"))


def order_book_depth(orders: DataFrame) -> DataFrame:
    """Open orders of every market: bids (buy side) and asks (sell side)."""
    is_open = orders.where("status = 'open'")
    return is_open.groupBy("market").agg(F.count_if(F.col("side") == "buy").alias("bids"), F.count_if(F.col("side") == "sell").alias("asks"))


def market_rollup(fills: DataFrame, orders: DataFrame, now: int | None = None) -> DataFrame:
    """Per market: price of the last fill, and the volume of the 24 hours up to ``now`` (default: the latest fill anywhere)."""
    rows = fills.select("id", "order", "timestamp", "price", "amount").join(orders.select(F.col("id").alias("order"), "market"), "order")
    latest = F.lit(now) if now is not None else F.col("latest")
    if now is None:
        rows = rows.crossJoin(F.broadcast(fills.agg(F.max("timestamp").alias("latest"))))  # one row
    recent = rows.withColumn("recent", F.when(F.col("timestamp") > latest - DAY, fixed_point("amount")))
    totals = recent.groupBy("market").agg(F.max_by("price", F.struct("timestamp", "id")).alias("lastPrice"), sum_digits("recent").alias("volume24h"), F.count("*").alias("fills"))
    return totals.withColumn("volume24h", with_point("volume24h"))


def market_days(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Per market and day: open, high, low, close of the price, and the exact volume as text."""
    rows = fills.select("id", "order", "timestamp", "price", "amount").join(orders.select(F.col("id").alias("order"), "market"), "order").withColumn("date", bucket(DAY))
    price, at = F.col("price").try_cast("double"), F.struct("timestamp", "id")
    days = rows.withColumn("exact", fixed_point("amount")).groupBy("market", "date").agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), sum_digits("exact").alias("volume"))
    return days.withColumn("volume", with_point("volume"))


def utxo_balances(utxos: DataFrame, spent: DataFrame) -> DataFrame:
    """Per address: the sum of amounts of outputs that ``spent`` does not name."""
    left = utxos.join(spent.select("id").distinct(), "id", "left_anti")
    return left.groupBy("address").agg(sum_digits("amount").alias("balance"), F.count("*").alias("outputs"))


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    """Counts with sub-totals over a list of columns, outermost first (null: all)."""
    return events.rollup(*by).agg(F.count("*").alias("events"), F.grouping_id().alias("level"))


def activity(swaps: DataFrame, mints: DataFrame, burns: DataFrame, first: int) -> DataFrame:
    """Newest first: swaps, mints and burns as one feed."""
    columns = ["id", "pool", "amount0", "amount1", "sender", "block_number", "log_order"]
    parts = [x.select(F.lit(kind).alias("kind"), *columns) for kind, x in (("swap", swaps), ("mint", mints), ("burn", burns))]
    feed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return feed.orderBy(F.desc("block_number"), F.desc("log_order"), "kind", "id").limit(first)
