"""The library's queries over the order tables, each with the SQL that says what it must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode import amm, defi, securities
from ledgerlake.functions import hexwords as hx
from ledgerlake.operators import enrich, entities, feeds, query, rollups, snapshots
from ledgerlake.operators.upsert import latest_by_key, upsert, upsert_all, upsert_entities
from ledgerlake.plans.registry import ADDRESS as _A
from ledgerlake.plans.registry import CENTS as _CENTS
from ledgerlake.plans.registry import TOPIC as _T
from ledgerlake.plans.registry import huge as _huge
from ledgerlake.plans.registry import query as _query
from ledgerlake.sources import logs as lg
from ledgerlake.sources import synth

_SWAP_ID = f"{_T('l_orderkey')} || '#0x' || format('{{:x}}', l_linenumber)"
#: All decoded swaps, and u: the last of each id.
_SWAPS = f"""s AS (
  SELECT {_SWAP_ID} AS id, l_partkey, l_suppkey, l_orderkey, l_linenumber, {_A('l_partkey')} AS pool, {_A('l_suppkey')} AS sender,
    CAST(l_quantity AS BIGINT) AS q, {_CENTS('l_extendedprice')} AS c FROM lineitem
), u AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY pool DESC, CAST(q AS VARCHAR) DESC, '-' || CAST(c AS VARCHAR) DESC, sender DESC) = 1
), tm AS (
  SELECT u.*, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM u JOIN orders ON l_orderkey = o_orderkey
), pl AS (
  SELECT p_partkey, {_A('p_partkey')} AS pool, p_partkey % 100 + 1 AS t0, (p_partkey + 1) % 100 + 1 AS t1,
    CASE WHEN p_partkey % 2 = 1 THEN 3000 WHEN p_partkey % 3 = 0 THEN 500 WHEN p_partkey % 3 = 1 THEN 3000 ELSE 10000 END AS fee FROM part
)"""


def _swaps(spark: SparkSession, sf: str) -> DataFrame:
    return upsert(None, amm.swaps_v2(synth.swap_v2_logs(spark, sf)), hot=False)


def _timed(spark: SparkSession, sf: str, upserted: bool = True) -> DataFrame:
    """Swaps with unix time from the blocks and a value in USD; ``upserted=False`` leaves it to the reader to keep the last of each id."""
    usd = (F.regexp_replace("amount1", "-", "").cast("decimal(28,0)") / 100).cast("decimal(28,2)").cast("string")
    # what a rollup reads; the columns left out come last or follow from the block in settling equal orders, so the same rows win
    swaps = amm.swaps_v2(synth.swap_v2_logs(spark, sf)).select("id", "pool", "amount0", "amount1", "block_number", "log_order")
    return enrich.with_block_time(upsert(None, swaps, hot=False) if upserted else swaps, synth.blocks(spark, sf)).withColumn("amountUSD", usd)


def _pools(spark: SparkSession, sf: str) -> DataFrame:
    return latest_by_key(amm.pools(synth.pool_logs(spark, sf)), ("id",))


def _valued_pools(spark: SparkSession, sf: str) -> DataFrame:
    return _pools(spark, sf).withColumn("totalValueLockedUSD", (F.col("created_block") * 7919 % 100003).cast("string"))


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@_query(f"""WITH {_SWAPS}, top AS (SELECT * FROM u ORDER BY l_orderkey DESC, id LIMIT 200)
SELECT id, l_orderkey AS timestamp, CAST(q AS VARCHAR) AS amount0, CAST(-c AS VARCHAR) AS amount1, sender, top.pool AS pool_id, CAST(fee AS BIGINT) AS fee_tier, 'T' || t0 AS symbol0, 'T' || t1 AS symbol1
FROM top LEFT JOIN (SELECT pool, fee, a.s_suppkey AS t0, b.s_suppkey AS t1 FROM pl LEFT JOIN supplier a ON t0 = a.s_suppkey LEFT JOIN supplier b ON t1 = b.s_suppkey) x ON top.pool = x.pool""")
def latest_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 200 swaps with their pool and its tokens: limit first, then enrich."""
    recent = query.recent_swaps(_swaps(spark, sf), 200)
    full = enrich.with_pools(recent, _pools(spark, sf), synth.tokens(spark, sf))
    return full.select("id", "timestamp", "amount0", "amount1", "sender", "pool_id", F.col("pool.feeTier").alias("fee_tier"), F.col("pool.token0.symbol").alias("symbol0"), F.col("pool.token1.symbol").alias("symbol1"))


@_query(f"WITH {_SWAPS} SELECT id, l_orderkey AS timestamp, pool, CAST(q AS VARCHAR) AS amount0, CAST(-c AS VARCHAR) AS amount1, '0' AS \"amountUSD\", sender FROM s")
def decode_swaps_v2(spark: SparkSession, sf: str) -> DataFrame:
    return amm.swaps_v2(synth.swap_v2_logs(spark, sf)).select("id", "timestamp", "pool", "amount0", "amount1", "amountUSD", "sender")


@_query(f"WITH {_SWAPS} SELECT id, pool, CAST(-q AS VARCHAR) AS amount0, CAST(c::HUGEINT * 18446744073709551616::HUGEINT + l_partkey AS VARCHAR) AS amount1 FROM s")
def decode_swaps_v3(spark: SparkSession, sf: str) -> DataFrame:
    return amm.swaps_v3(synth.swap_v3_logs(spark, sf)).select("id", "pool", "amount0", "amount1")


@_query(f"WITH {_SWAPS} SELECT id, {_T('l_partkey')} AS pool, CAST(-q AS VARCHAR) AS amount0, CAST(c AS VARCHAR) AS amount1, CAST(l_suppkey::HUGEINT * 18446744073709551616::HUGEINT + l_partkey AS VARCHAR) AS sqrt_price, CAST(l_orderkey AS VARCHAR) AS liquidity, CAST(l_linenumber - 4 AS BIGINT) AS tick FROM s")
def decode_swaps_v4(spark: SparkSession, sf: str) -> DataFrame:
    return amm.swaps_v4(synth.swap_v4_logs(spark, sf)).select("id", "pool", "amount0", "amount1", F.col("sqrtPriceX96").alias("sqrt_price"), "liquidity", "tick")


@_query(f"WITH {_SWAPS} SELECT id, pool, CAST(q AS VARCHAR) AS amount0, CAST(-c AS VARCHAR) AS amount1, sender FROM u")
def upsert_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, the second replayed: the last row of each id remains."""
    rows = amm.swaps_v2(synth.swap_v2_logs(spark, sf))
    first, second = (rows.where(F.col("block_number") % 2 == k) for k in (0, 1))
    return upsert_all(None, [first, second, second]).select("id", "pool", "amount0", "amount1", "sender")


@_query(f"WITH {_SWAPS} SELECT pool AS id, {_A('t0')} AS token0, {_A('t1')} AS token1, CAST(fee AS BIGINT) AS fee_tier, CAST(p_partkey AS BIGINT) AS created_block FROM pl")
def decode_pools(spark: SparkSession, sf: str) -> DataFrame:
    return amm.pools(synth.pool_logs(spark, sf)).select("id", "token0", "token1", F.col("feeTier").alias("fee_tier"), "created_block")


@_query(f"""WITH {_SWAPS}, x AS (SELECT {_A('t0')} AS id FROM pl UNION SELECT {_A('t1')} FROM pl UNION SELECT {_A('user_id % 10')} FROM events WHERE event_type = 'purchase')
SELECT id, substr(id, 1, 8) AS symbol, id AS name, CAST(18 AS BIGINT) AS decimals FROM x""")
def distinct_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return amm.tokens(synth.pool_logs(spark, sf).unionByName(synth.agent_logs(spark, sf)))


@_query(f"""WITH {_SWAPS} SELECT pool AS id, CAST(fee AS BIGINT) AS fee_tier, 'T' || a.s_suppkey AS symbol0, b.s_name AS name1 FROM pl LEFT JOIN supplier a ON t0 = a.s_suppkey LEFT JOIN supplier b ON t1 = b.s_suppkey""")
def pools_with_tokens(spark: SparkSession, sf: str) -> DataFrame:
    full = enrich.with_tokens(_pools(spark, sf), synth.tokens(spark, sf))
    return full.select("id", F.col("feeTier").alias("fee_tier"), F.col("token0.symbol").alias("symbol0"), F.col("token1.name").alias("name1"))


@_query(f"SELECT {_A('s_suppkey')} AS id, CAST(s_suppkey * 7919 % 1000 AS VARCHAR) AS tvl FROM supplier ORDER BY s_suppkey * 7919 % 1000 DESC, id LIMIT 50")
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return query.select_as(query.list_rows(synth.tokens(spark, sf), 50, "totalValueLockedUSD", "desc"), id="id", tvl="totalValueLockedUSD")


@_query(f"WITH {_SWAPS} SELECT id, CAST(q AS VARCHAR) AS amount0, CAST(-c AS VARCHAR) AS amount1 FROM u WHERE q >= 10 AND q < 40 AND -c <= -90000.5 AND pool <> '' ORDER BY q, CAST(q AS VARCHAR), id LIMIT 1000")
def filtered_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Text amounts compared as numbers."""
    conditions = {"amount0_gte": "10", "amount0_lt": "4.0e1", "amount1_lte": "-90000.5", "pool_gt": ""}
    return query.list_rows(_swaps(spark, sf), 5000, "amount0", "asc", conditions).select("id", "amount0", "amount1")


@_query(f"""WITH {_SWAPS} SELECT 'bundle' AS part, CAST(r_regionkey AS VARCHAR) AS id, CAST(r_regionkey * 100 + 2400 AS VARCHAR) AS value FROM region WHERE r_regionkey = 1
UNION ALL SELECT 'factory', CAST(n_nationkey AS VARCHAR), CAST(length(n_name) AS VARCHAR) FROM nation
UNION ALL SELECT 'token', id, CAST(v AS VARCHAR) FROM (SELECT {_A('s_suppkey')} AS id, s_suppkey * 7919 % 1000 AS v FROM supplier ORDER BY v DESC, id LIMIT 50)
UNION ALL SELECT 'pool', id, CAST(v AS VARCHAR) FROM (SELECT pool AS id, p_partkey * 7919 % 100003 AS v FROM pl ORDER BY v DESC, pool LIMIT 50)""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """The exchange dashboard in one result: the bundle, all factories, the 50 tokens and 50 pools of most locked value."""
    locked = {"factory": query.list_all(synth.factories(spark, sf)), "token": query.list_rows(synth.tokens(spark, sf), 50, "totalValueLockedUSD", "desc"), "pool": query.list_rows(_valued_pools(spark, sf), 50, "totalValueLockedUSD", "desc")}
    bundle = query.get_bundle(synth.bundles(spark, sf)).select(F.lit("bundle").alias("part"), "id", F.col("ethPrice").alias("value"))
    return amm.union_all(bundle, *[rows.select(F.lit(part).alias("part"), "id", F.col("totalValueLockedUSD").alias("value")) for part, rows in locked.items()])


@_query("SELECT 'factory' AS part, CAST(n_nationkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'pool manager', CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'bundle', CAST(r_regionkey AS VARCHAR), CAST(r_regionkey * 100 + 2400 AS VARCHAR) FROM region")
def exchange_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every factory, pool manager and bundle: these lists have no limit."""
    factories = query.list_all(synth.factories(spark, sf))
    parts = [factories.select(F.lit(part).alias("part"), "id", F.col("poolCount").cast("string").alias("value")) for part in ("factory", "pool manager")]
    return amm.union_all(*parts, query.list_all(synth.bundles(spark, sf)).select(F.lit("bundle").alias("part"), "id", F.col("ethPriceUSD").alias("value")))


@_query(f"""SELECT {_T('l_orderkey')} || '#0x' || format('{{:x}}', l_linenumber) AS id, CASE WHEN l_returnflag = 'R' THEN 'burn' ELSE 'mint' END AS kind, {_A('l_suppkey')} AS owner, CAST(l_linenumber * 60 - 180 AS BIGINT) AS tick_lower, CAST(l_linenumber * 60 - 120 AS BIGINT) AS tick_upper,
CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS amount, CAST(2 * CAST(l_quantity AS BIGINT) AS VARCHAR) AS amount0, CAST({_CENTS('l_extendedprice')} AS VARCHAR) AS amount1 FROM lineitem""")
def decode_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.liquidity_logs(spark, sf)
    parts = [x.select("id", F.lit(k).alias("kind"), "owner", F.col("tickLower").alias("tick_lower"), F.col("tickUpper").alias("tick_upper"), "amount", "amount0", "amount1") for k, x in (("mint", amm.mints(logs)), ("burn", amm.burns(logs)))]
    return parts[0].unionByName(parts[1])


@_query("""SELECT pool, tick, CAST(sum(q) AS VARCHAR) AS gross, CAST(sum(q * s * e) AS VARCHAR) AS net FROM (
  SELECT '0x' || format('{:040x}', l_partkey) AS pool, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s, unnest([1, -1]) AS e, CAST(l_linenumber * 60 - unnest([180, 120]) AS BIGINT) AS tick FROM lineitem) GROUP BY pool, tick""")
def tick_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.liquidity_logs(spark, sf)
    ticks = rollups.tick_liquidity(amm.mints(logs), amm.burns(logs))
    return ticks.select("pool", "tick", F.col("liquidityGross").cast("string").alias("gross"), F.col("liquidityNet").cast("string").alias("net"))


@_query("""SELECT '0x' || format('{:040x}', l_partkey) AS pool, count(DISTINCT l_suppkey) AS providers FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def liquidity_providers(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.liquidity_logs(spark, sf)
    return rollups.pool_extras(amm.collects(logs), amm.mints(logs)).select("pool", F.col("liquidityProviderCount").alias("providers"))


@_query(f"""SELECT {_A('l_partkey')} AS pool, CAST(year(o_orderdate) AS BIGINT) AS year, count(DISTINCT l_suppkey) AS providers FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1, 2""")
def provider_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sketches of providers, merged to years; below 4,096 providers a sketch counts exactly."""
    mints = enrich.with_block_time(amm.mints(synth.liquidity_logs(spark, sf)), synth.blocks(spark, sf))
    years = rollups.provider_sketches(mints).withColumn("year", F.year(F.timestamp_seconds("date")).cast("bigint"))
    return rollups.merge_providers(years, "pool", "year").select("pool", "year", F.col("providers").cast("bigint").alias("providers"))


@_query(f"""SELECT CAST(o_custkey % 50 AS VARCHAR) AS proposal, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c ELSE 0 END) AS VARCHAR) AS against_votes, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN c ELSE 0 END) AS VARCHAR) AS for_votes,
CAST(sum(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN c ELSE 0 END) AS VARCHAR) AS abstain_votes, count(*) AS votes FROM (SELECT *, {_CENTS('o_totalprice')} AS c FROM orders) GROUP BY 1""")
def proposal_tally(spark: SparkSession, sf: str) -> DataFrame:
    tally = rollups.proposal_tally(defi.votes(synth.vote_logs(spark, sf)))
    return tally.select("proposal", F.col("againstVotes").alias("against_votes"), F.col("forVotes").alias("for_votes"), F.col("abstainVotes").alias("abstain_votes"), "votes")


_AGENT = f"""a AS (SELECT event_id, {_A('user_id % 10')} AS token, {_A('user_id')} AS usr, event_type, {_CENTS('value')} AS c FROM events)"""


@_query(f"""WITH {_AGENT} SELECT token || ':' || {_T('event_id')} || ':0x0' AS id, CASE event_type WHEN 'click' THEN 'TokensFrozen' WHEN 'view' THEN 'TokensUnfrozen' ELSE 'AddressFrozen' END AS kind, token, usr AS "user",
CASE WHEN event_type IN ('error', 'signup') THEN event_type = 'error' END AS is_frozen, CASE WHEN event_type IN ('click', 'view') THEN CAST(c AS VARCHAR) END AS amount FROM a WHERE event_type <> 'purchase'""")
def transfer_agent_actions(spark: SparkSession, sf: str) -> DataFrame:
    return securities.transfer_agent_actions(synth.agent_logs(spark, sf)).select("id", "kind", "token", "user", F.col("isFrozen").alias("is_frozen"), "amount")


@_query(f"""WITH {_AGENT} SELECT token || ':' || usr AS id, arg_max(event_type, event_id) = 'error' AS frozen, max(event_id) AS updated FROM a WHERE event_type IN ('error', 'signup') GROUP BY token, usr""")
def frozen_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.frozen_accounts(securities.transfer_agent_actions(synth.agent_logs(spark, sf))).select("id", "frozen", "updated")


@_query(f"""WITH {_AGENT} SELECT token || ':' || usr AS id, CAST(arg_max(c, event_id) AS VARCHAR) AS delta, CASE arg_max(event_type, event_id) WHEN 'click' THEN 'TokensFrozen' ELSE 'TokensUnfrozen' END AS kind FROM a WHERE event_type IN ('click', 'view') GROUP BY token, usr""")
def frozen_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.frozen_tokens(securities.transfer_agent_actions(synth.agent_logs(spark, sf))).select("id", "delta", "kind")


@_query(f"""WITH {_AGENT} SELECT event_id AS block_number, CAST(sum(CASE WHEN event_type = 'click' THEN c ELSE -c END) OVER (PARTITION BY token, usr ORDER BY event_id) AS VARCHAR) AS total FROM a WHERE event_type IN ('click', 'view')""")
def frozen_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _text(snapshots.frozen_totals(securities.transfer_agent_actions(synth.agent_logs(spark, sf))).select("block_number", "total"), "total")


@_query(f"""WITH {_AGENT} SELECT event_id AS block_number, token, CAST(NULL AS VARCHAR) AS token_id, CAST(c AS VARCHAR) AS value FROM a WHERE event_type = 'purchase'""")
def decode_transfers(spark: SparkSession, sf: str) -> DataFrame:
    return amm.transfers(synth.agent_logs(spark, sf)).select("block_number", "token", F.col("tokenId").alias("token_id"), "value")


@_query("""SELECT c_custkey::VARCHAR AS id, CAST(round(c_acctbal * 100) AS BIGINT)::VARCHAR AS stake, c_mktsegment AS segment FROM customer ORDER BY 1 LIMIT 1000""")
def entity_list(spark: SparkSession, sf: str) -> DataFrame:
    """Upserted documents of one type, listed by id up to the clamp."""
    rows = synth.entities(spark, sf)
    kept = upsert_entities(rows, rows.where("entity_type = 'Validator'"))
    return entities.typed(entities.list_entities(kept, "Validator", 5000), "Validator", "id string, stake string, segment string")


@_query("""SELECT '1' AS id, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS VARCHAR) || '.000000' AS total_stake, count(*) AS validators, (SELECT count(*) FROM supplier) AS delegators FROM customer""")
def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = entities.domain_statistics(synth.entities(spark, sf), "NetworkStats")
    return s.select("id", F.col("totalStake").cast("decimal(38,6)").cast("string").alias("total_stake"), F.col("validatorCount").alias("validators"), F.col("delegatorCount").alias("delegators"))


@_query(f"""WITH {_SWAPS} SELECT tm.pool AS id, count(*) AS tx_count, CAST(sum(q) AS VARCHAR) AS volume0, CAST(sum(c) AS VARCHAR) AS volume1, CAST(sum(c)::HUGEINT AS VARCHAR) AS volume_cents, CAST((sum(c)::HUGEINT * any_value(fee) + 50) // 100 AS VARCHAR) AS fee_micros FROM tm LEFT JOIN pl ON tm.pool = pl.pool GROUP BY 1""")
def pool_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals_as_text(rollups.pool_totals(_timed(spark, sf), _pools(spark, sf)))


def totals_as_text(x: DataFrame) -> DataFrame:
    return x.select("id", F.col("txCount").alias("tx_count"), F.col("volumeToken0").alias("volume0"), F.col("volumeToken1").alias("volume1"), (F.col("volumeUSD") * 100).cast("decimal(38,0)").cast("string").alias("volume_cents"), (F.col("feesUSD") * 1_000_000).cast("decimal(38,0)").cast("string").alias("fee_micros"))


@_query(f"""WITH {_SWAPS}, b AS (SELECT unnest([t0, t1]) AS t, unnest([q, c]) AS amount, c FROM tm JOIN pl ON tm.pool = pl.pool), n AS (SELECT t, count(DISTINCT pool) AS pools FROM (SELECT pool, unnest([t0, t1]) AS t FROM pl) GROUP BY t)
SELECT {_A('n.t')} AS id, count(b.t) AS tx_count, CAST(coalesce(sum(amount), 0) AS VARCHAR) AS volume, CAST(coalesce(sum(c), 0) AS VARCHAR) AS volume_cents, any_value(pools) AS pool_count FROM n LEFT JOIN b ON n.t = b.t GROUP BY n.t""")
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    x = rollups.token_totals(_timed(spark, sf), _pools(spark, sf))
    return x.select("id", F.col("txCount").alias("tx_count"), "volume", (F.col("volumeUSD") * 100).cast("decimal(38,0)").cast("string").alias("volume_cents"), F.col("poolCount").alias("pool_count"))


@_query(f"""WITH {_SWAPS} SELECT '1' AS id, (SELECT count(*) FROM part) AS pool_count, count(*) AS tx_count, CAST(sum(c) AS VARCHAR) AS volume_cents, (SELECT CAST(sum(p_partkey * 7919 % 100003) AS VARCHAR) FROM part) AS locked FROM tm""")
def factory_totals(spark: SparkSession, sf: str) -> DataFrame:
    pools = _valued_pools(spark, sf)
    x = rollups.factory_totals(pools, rollups.pool_totals(_timed(spark, sf), pools))
    return x.select("id", F.col("poolCount").alias("pool_count"), F.col("txCount").cast("bigint").alias("tx_count"), (F.col("totalVolumeUSD") * 100).cast("decimal(38,0)").cast("string").alias("volume_cents"), F.col("totalValueLockedUSD").cast("decimal(38,0)").cast("string").alias("locked"))


def _period_sql(seconds: int) -> str:
    return f"""WITH {_SWAPS}, p AS (SELECT *, ts // {seconds} * {seconds} AS b, c::DOUBLE / q::DOUBLE AS price, l_orderkey * 100 + l_linenumber AS o FROM tm)
SELECT pool, b AS period, count(*) AS tx_count, CAST(sum(c) AS VARCHAR) AS volume_cents, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS "close" FROM p GROUP BY 1, 2"""


def _period(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.select(key, F.col(label).alias("period"), F.col("txCount").alias("tx_count"), (F.col("volumeUSD") * 100).cast("decimal(38,0)").cast("string").alias("volume_cents"), "open", "high", "low", "close")


@_query(_period_sql(rollups.DAY))
def pool_days(spark: SparkSession, sf: str) -> DataFrame:
    return _period(rollups.pool_period(_timed(spark, sf), _pools(spark, sf)), "pool", "date")


@_query(_period_sql(rollups.HOUR))
def pool_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _period(rollups.pool_period(_timed(spark, sf), _pools(spark, sf), rollups.HOUR, "periodStartUnix"), "pool", "periodStartUnix")


@_query(f"""WITH {_SWAPS}, x AS (SELECT unnest([t0, t1]) AS t, unnest([q, c]) AS a, unnest([c, q]) AS b, c, ts // 86400 * 86400 AS d, l_orderkey * 100 + l_linenumber AS o FROM tm JOIN pl ON tm.pool = pl.pool), p AS (SELECT *, b::DOUBLE / a::DOUBLE AS price FROM x)
SELECT {_A('t')} AS token, d AS period, count(*) AS tx_count, CAST(sum(c) AS VARCHAR) AS volume_cents, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS "close" FROM p GROUP BY 1, 2""")
def token_days(spark: SparkSession, sf: str) -> DataFrame:
    return _period(rollups.token_period(_timed(spark, sf), _pools(spark, sf)), "token", "date")


def _pairs_sql(seconds: int) -> str:
    return f"""WITH {_SWAPS}, x AS (SELECT {_SWAP_ID} AS id, {_A('l_partkey')} AS pool, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS r0, {_CENTS('l_extendedprice')} AS r1 FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY pool DESC, CAST(r0 AS VARCHAR) DESC, CAST(r1 AS VARCHAR) DESC) = 1
), y AS (SELECT pool, CAST(epoch(o_orderdate) AS BIGINT) // {seconds} * {seconds} AS period, arg_max(r0, l_orderkey * 100 + l_linenumber) AS r0, arg_max(r1, l_orderkey * 100 + l_linenumber) AS r1 FROM x JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
), z AS (SELECT pool, ts // {seconds} * {seconds} AS period, count(*) AS txns, CAST(sum(c) AS VARCHAR) AS volume_cents FROM tm GROUP BY 1, 2)
SELECT z.pool AS pair, z.period, txns, volume_cents, CAST(r0 AS VARCHAR) AS reserve0, CAST(r1 AS VARCHAR) AS reserve1 FROM z LEFT JOIN y ON z.pool = y.pool AND z.period = y.period"""


def _pairs(spark: SparkSession, sf: str, seconds: int, label: str) -> DataFrame:
    syncs = enrich.with_block_time(upsert(None, amm.syncs(synth.sync_logs(spark, sf)), hot=False), synth.blocks(spark, sf))
    x = rollups.pair_period(_timed(spark, sf), syncs, seconds, label)
    return x.select("pair", F.col(label).alias("period"), "txns", (F.col("volumeUSD") * 100).cast("decimal(38,0)").cast("string").alias("volume_cents"), "reserve0", "reserve1")


@_query(_pairs_sql(rollups.DAY))
def pair_days(spark: SparkSession, sf: str) -> DataFrame:
    """Volume by swap logs, closing reserves by sync logs."""
    return _pairs(spark, sf, rollups.DAY, "date")


@_query(_pairs_sql(rollups.HOUR))
def pair_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, rollups.HOUR, "hourStartUnix")


@_query(f"WITH {_SWAPS} SELECT ts // 86400 * 86400 AS date, count(*) AS tx_count, CAST(sum(c) AS VARCHAR) AS volume_cents, CAST((sum(c::HUGEINT * fee) + 50) // 100 AS VARCHAR) AS fee_micros FROM tm LEFT JOIN pl ON tm.pool = pl.pool GROUP BY 1")
def factory_days(spark: SparkSession, sf: str) -> DataFrame:
    days = rollups.factory_period(rollups.pool_period(_timed(spark, sf), _pools(spark, sf)))
    return days.select("date", F.col("txCount").cast("bigint").alias("tx_count"), (F.col("volumeUSD") * 100).cast("decimal(38,0)").cast("string").alias("volume_cents"), (F.col("feesUSD") * 1_000_000).cast("decimal(38,0)").cast("string").alias("fee_micros"))


@_query(f"""WITH {_SWAPS}, d AS (SELECT pool, ts // 86400 * 86400 AS date, sum(c) AS v FROM tm GROUP BY 1, 2) SELECT pool, date, row_number() OVER (PARTITION BY date ORDER BY v DESC, pool || '-' || date) AS rank FROM d QUALIFY rank <= 3""")
def top_pools_by_day(spark: SparkSession, sf: str) -> DataFrame:
    days = rollups.pool_period(_timed(spark, sf), _pools(spark, sf))
    return snapshots.top_per_group(days, "date", "volumeUSD", 3).select("pool", "date", F.col("rank").cast("bigint").alias("rank"))


@_query("SELECT o_orderpriority AS market, count_if(o_custkey % 2 = 0) AS bids, count_if(o_custkey % 2 = 1) AS asks FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def order_book_depth(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.order_book_depth(synth.market_orders(spark, sf))


_FILLS = f"""f AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || {_CENTS('l_extendedprice')} AS id, o_orderpriority AS market, CAST(epoch(l_shipdate) AS BIGINT) AS ts, {_CENTS('l_extendedprice')} AS price, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@_query(f"""WITH {_FILLS} SELECT market, CAST(arg_max(price, (ts, id)) AS VARCHAR) AS last_price, CAST(coalesce(sum(q) FILTER (ts > (SELECT max(ts) FROM f) - 86400), 0) AS VARCHAR) || '.000000' AS volume_24h, count(*) AS fills FROM f GROUP BY 1""")
def market_rollup(spark: SparkSession, sf: str) -> DataFrame:
    m = rollups.market_rollup(synth.market_fills(spark, sf), synth.market_orders(spark, sf))
    return m.select("market", F.col("lastPrice").alias("last_price"), F.col("volume24h").cast("decimal(38,6)").cast("string").alias("volume_24h"), "fills")


@_query(f"""WITH {_FILLS} SELECT market, ts // 86400 * 86400 AS date, arg_min(price, (ts, id))::DOUBLE AS open, max(price)::DOUBLE AS high, min(price)::DOUBLE AS low, arg_max(price, (ts, id))::DOUBLE AS "close", CAST(sum(q) AS VARCHAR) || '.000000' AS volume FROM f GROUP BY 1, 2""")
def market_days(spark: SparkSession, sf: str) -> DataFrame:
    days = rollups.market_days(synth.market_fills(spark, sf), synth.market_orders(spark, sf))
    return days.select("market", "date", "open", "high", "low", "close", F.col("volume").cast("decimal(38,6)").cast("string").alias("volume"))


@_query(f"""WITH x AS (SELECT 'swap' AS kind, {_SWAP_ID} AS id, l_orderkey AS b, l_linenumber AS o FROM lineitem UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'burn' ELSE 'mint' END, {_SWAP_ID}, l_orderkey, l_linenumber FROM lineitem) SELECT kind, id, b AS block_number FROM x ORDER BY b DESC, o DESC, kind, id LIMIT 300""")
def activity_feed(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.swap_v2_logs(spark, sf).unionByName(synth.liquidity_logs(spark, sf))
    return feeds.newest_activity(logs, 300).select("kind", "id", "block_number")


@_query(f"""WITH {_AGENT} SELECT kind, token, count(*) AS events FROM (SELECT token, CASE event_type WHEN 'click' THEN 'TokensFrozen' WHEN 'view' THEN 'TokensUnfrozen' ELSE 'AddressFrozen' END AS kind FROM a WHERE event_type <> 'purchase') GROUP BY ROLLUP (kind, token)""")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.event_counts(securities.transfer_agent_actions(synth.agent_logs(spark, sf)), "kind", "token").drop("level")


@_query("SELECT topic0, count(*) AS logs FROM (SELECT CASE WHEN event_type = 'click' THEN '" + t.TOKENS_FROZEN + "' WHEN event_type = 'view' THEN '" + t.TOKENS_UNFROZEN + "' WHEN event_type IN ('error', 'signup') THEN '" + t.ADDRESS_FROZEN + "' ELSE '" + t.TRANSFER + "' END AS topic0 FROM events WHERE event_id BETWEEN 1001 AND 3001) GROUP BY 1")
def index_step(spark: SparkSession, sf: str) -> DataFrame:
    """Known signatures in the next range of blocks, votes among the logs being unknown to the indexer."""
    logs = synth.agent_logs(spark, sf).unionByName(synth.vote_logs(spark, sf))
    first, last = lg.next_step(1000, 9_000_000)
    return lg.block_slice(lg.known_events(logs), first, last).groupBy("topic0").agg(F.count("*").alias("logs"))


@_query("SELECT CAST(o_orderkey AS BIGINT) AS number, CAST(epoch(o_orderdate) AS BIGINT) AS timestamp FROM orders ORDER BY 1 DESC LIMIT 25")
def latest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return query.list_blocks(synth.blocks(spark, sf)).select("number", "timestamp")


@_query(f"""WITH {_SWAPS} SELECT u.id, CAST(CAST(q * 2500 * s_suppkey AS DECIMAL(38,0)) AS VARCHAR) AS usd_micros FROM u LEFT JOIN pl ON u.pool = pl.pool LEFT JOIN supplier ON t0 = s_suppkey""")
def swap_values(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity / 10^2 tokens at 0.000x per token and 2500 USD."""
    bundle = synth.table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("1").alias("id"), F.lit("2500").alias("ethPriceUSD"))
    x = enrich.value_in_usd(_swaps(spark, sf), _pools(spark, sf), synth.tokens(spark, sf), bundle)
    return x.select("id", (F.col("amountUSD").cast("decimal(38,6)") * 1_000_000).cast("decimal(38,0)").cast("string").alias("usd_micros"))


@_query(f"""SELECT handler, count(*) AS logs FROM (SELECT CASE WHEN event_type = 'click' THEN 'onFreeze' ELSE 'onUnfreeze' END AS handler FROM events WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 10 = 3 AND event_id >= 500)) GROUP BY 1""")
def routed_logs(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.route(synth.agent_logs(spark, sf), manifest(spark, sf)).groupBy("handler").agg(F.count("*").alias("logs"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Two rules: one for any address, one for an address from a block on."""
    region = synth.table(spark, sf, "region").where("r_regionkey < 2").select("r_regionkey")
    one = F.col("r_regionkey") == 0
    return region.select(F.lit("tokens").alias("source"), F.when(one, "onFreeze").otherwise("onUnfreeze").alias("handler"), F.when(one, t.TOKENS_FROZEN).otherwise(t.TOKENS_UNFROZEN).alias("topic0"), F.when(~one, synth.addr(F.lit(3))).alias("address"), F.when(one, 0).otherwise(500).alias("start_block"))


@_query(f"WITH {_SWAPS} SELECT id, pool FROM s JOIN part ON l_partkey = p_partkey WHERE l_orderkey >= p_partkey")
def swaps_of_announced_pools(spark: SparkSession, sf: str) -> DataFrame:
    logs = enrich.from_announced_pools(synth.swap_v2_logs(spark, sf), amm.pools(synth.pool_logs(spark, sf)))
    return amm.swaps_v2(logs).select("id", "pool")


def _dao_sql(plus: int, minus: int) -> str:
    return f"SELECT {_A('o_custkey % 100')} AS account, CAST(sum(CASE o_orderkey % 10 WHEN {plus} THEN 1 ELSE -1 END * {_CENTS('o_totalprice')}) AS VARCHAR) AS balance FROM orders WHERE o_orderkey % 10 IN ({plus}, {minus}) GROUP BY 1"


@_query(_dao_sql(0, 1))
def karma_balances(spark: SparkSession, sf: str) -> DataFrame:
    return _text(rollups.karma_balances(defi.karma(synth.dao_logs(spark, sf))).select("account", "balance"), "balance")


@_query(_dao_sql(2, 3))
def stake_balances(spark: SparkSession, sf: str) -> DataFrame:
    return _text(rollups.stake_balances(defi.stakes(synth.dao_logs(spark, sf))).select("account", "balance"), "balance")


@_query(_dao_sql(4, 5))
def locked_balances(spark: SparkSession, sf: str) -> DataFrame:
    return _text(rollups.locked_balances(defi.vote_locks(synth.dao_logs(spark, sf))).select("account", "balance"), "balance")


@_query(f"""SELECT {_T('o_custkey % 7')} AS chain, CAST(sum(CASE WHEN o_orderkey % 10 = 6 THEN {_CENTS('o_totalprice')} ELSE 0 END) AS VARCHAR) AS received, CAST(sum(CASE o_orderkey % 10 WHEN 6 THEN 1 ELSE -1 END * {_CENTS('o_totalprice')}) AS VARCHAR) AS net FROM orders WHERE o_orderkey % 10 IN (6, 7) GROUP BY 1""")
def treasury_flows(spark: SparkSession, sf: str) -> DataFrame:
    return _text(rollups.treasury_flows(defi.vaults(synth.dao_logs(spark, sf))).select("chain", "received", "net"), "received", "net")


@_query(f"SELECT {_A('o_custkey % 100')} AS recipient, CAST(sum({_CENTS('o_totalprice')}) AS VARCHAR) AS claimed FROM orders WHERE o_orderkey % 10 = 8 GROUP BY 1")
def router_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _text(rollups.router_shares(defi.routers(synth.dao_logs(spark, sf))).select("recipient", "claimed"), "claimed")


@_query(f"SELECT {_T('o_custkey % 3')} AS fee_type, CAST(sum({_CENTS('o_totalprice')}) AS VARCHAR) AS fees, CAST(sum(o_custkey % 5) AS VARCHAR) AS perf_fee, CAST(3 * count(*) AS VARCHAR) AS to_reserve FROM orders WHERE o_orderkey % 10 = 9 GROUP BY 1")
def liquid_totals(spark: SparkSession, sf: str) -> DataFrame:
    x = rollups.liquid_totals(defi.liquid(synth.dao_logs(spark, sf)))
    return x.select(F.col("feeType").alias("fee_type"), F.col("fees").cast("string").alias("fees"), F.col("perfFee").cast("string").alias("perf_fee"), F.col("toReserve").cast("string").alias("to_reserve"))


@_query(f"SELECT {_A('o_custkey % 20')} AS address, CAST(sum({_CENTS('o_totalprice')}) AS VARCHAR) AS balance, count(*) AS outputs FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def utxo_balances(spark: SparkSession, sf: str) -> DataFrame:
    orders = synth.table(spark, sf, "orders")
    utxos = orders.select(F.col("o_orderkey").cast("string").alias("id"), synth.addr(F.col("o_custkey") % 20).alias("address"), synth.cents(F.col("o_totalprice")).cast("string").alias("amount"))
    return rollups.utxo_balances(utxos, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")))


@_query(f"SELECT CAST({_CENTS('o_totalprice')}::HUGEINT * 18446744073709551616::HUGEINT + o_orderkey AS VARCHAR) AS value, CAST(o_orderkey AS BIGINT) AS order_key FROM orders")
def uint256_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Words over 64 bits through the path for values of any size."""
    rows = synth.table(spark, sf, "orders").withColumn("w", synth.wide_word(synth.cents(F.col("o_totalprice")), F.col("o_orderkey")))
    return hx.with_digits(rows, {"value": "w"}, small_path=False).select("value", F.col("o_orderkey").cast("bigint").alias("order_key"))


# Amounts of over 38 digits


def _huge_dao_sql(plus: int, minus: int) -> str:
    return f"SELECT account, {_huge('s')} AS balance FROM (SELECT {_A('o_custkey % 100')} AS account, sum(CASE o_orderkey % 10 WHEN {plus} THEN 1 ELSE -1 END * {_CENTS('o_totalprice')}) AS s FROM orders WHERE o_orderkey % 10 IN ({plus}, {minus}) GROUP BY 1)"


@_query(_huge_dao_sql(2, 3))
def huge_stake_balances(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.stake_balances(defi.stakes(synth.dao_logs(spark, sf, synth.huge_word))).select("account", "balance")


@_query(f"""SELECT chain, {_huge('r')} AS received, {_huge('n')} AS net FROM (SELECT {_T('o_custkey % 7')} AS chain, sum(CASE WHEN o_orderkey % 10 = 6 THEN {_CENTS('o_totalprice')} ELSE 0 END) AS r, sum(CASE o_orderkey % 10 WHEN 6 THEN 1 ELSE -1 END * {_CENTS('o_totalprice')}) AS n FROM orders WHERE o_orderkey % 10 IN (6, 7) GROUP BY 1)""")
def huge_treasury_flows(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.treasury_flows(defi.vaults(synth.dao_logs(spark, sf, synth.huge_word))).select("chain", "received", "net")


@_query(f"SELECT fee_type, {_huge('s')} AS fees FROM (SELECT {_T('o_custkey % 3')} AS fee_type, sum({_CENTS('o_totalprice')}) AS s FROM orders WHERE o_orderkey % 10 = 9 GROUP BY 1)")
def huge_liquid_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.liquid_totals(defi.liquid(synth.dao_logs(spark, sf, synth.huge_word))).select(F.col("feeType").alias("fee_type"), "fees")


@_query(f"""SELECT pool, tick, {_huge('g')} AS gross, {_huge('n')} AS net FROM (SELECT pool, tick, sum(q) AS g, sum(q * s * e) AS n FROM (
  SELECT {_A('l_partkey')} AS pool, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s, unnest([1, -1]) AS e, CAST(l_linenumber * 60 - unnest([180, 120]) AS BIGINT) AS tick FROM lineitem) GROUP BY pool, tick)""")
def huge_tick_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.liquidity_logs(spark, sf, synth.huge_word)
    return rollups.tick_liquidity(amm.mints(logs), amm.burns(logs)).select("pool", "tick", F.col("liquidityGross").alias("gross"), F.col("liquidityNet").alias("net"))


@_query(f"""WITH {_AGENT}, r AS (SELECT event_id, sum(CASE WHEN event_type = 'click' THEN c ELSE -c END) OVER (PARTITION BY token, usr ORDER BY event_id) AS s FROM a WHERE event_type IN ('click', 'view')) SELECT event_id AS block_number, {_huge('s')} AS total FROM r""")
def huge_frozen_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals, over spans of blocks short enough that users have many."""
    return snapshots.frozen_totals(securities.transfer_agent_actions(synth.agent_logs(spark, sf, synth.huge_word)), span=500).select("block_number", "total")
