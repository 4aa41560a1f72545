"""Logs derived from the order tables: every row becomes one log, encoded with built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.sources.logs import normalise, read_stored, write_logs


#: HotSpot interprets methods of more bytes of code than this, and Spark compiles a stage of many columns to a single one.
_LONGEST_METHOD = 8_000


def short_methods(spark: SparkSession) -> None:
    """Let Spark split the code of stages whose one method the JVM would not compile.

    This sets the session's own setting, and leaves it so: plans read it when they run, not when they are built.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(_LONGEST_METHOD))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_methods(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan in fewer partitions than the session has cores, dealt to all of them.

    Encoding and decoding cost far more than reading, and a small file may be a single row group. A
    scan that fills the cores by itself, as any large one does, is left as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Folder of logs that ``store`` has written, and the names of the functions that read them from there.
_STORED: dict[str, str] = {}


def stored(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Logs that are read from where ``store`` has put them, if it has, and are encoded from their table otherwise."""

    @wraps(make)
    def read(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
        at = _STORED.get(f"{make.__name__} {sf_dir}") if not more else None
        return read_stored(spark, at).drop("block_bucket") if at else make(spark, sf_dir, *more)

    return read


def store(spark: SparkSession, sf_dir: str, folder: str, *makers: Callable[..., DataFrame]) -> None:
    """Encode logs once, store them by signature and block, and let the queries of this session read them there."""
    for make in makers:
        path = f"{folder}/{make.__name__}"
        write_logs(make(spark, sf_dir), path)
        _STORED[f"{make.__name__} {sf_dir}"] = path


def sixteen(x: Column) -> Column:
    """16 hex digits of a BIGINT, of its two's complement where negative. Padding text digit by digit costs as much as all else here."""
    x = x.cast("bigint")
    # one more bit in front makes sixteen digits, the first of which goes again
    padded = F.substring(F.hex(x.bitwiseOR(F.lit(1 << 60))).cast("binary"), 2, 15).cast("string")
    return F.lower(F.when((x >= 0) & (x < 1 << 60), F.concat(F.lit("0"), padded)).otherwise(F.hex(x)))


def word(x: Column) -> Column:
    """64 hex digits of a BIGINT, in two's complement where negative."""
    return F.concat(F.when(x < 0, F.lit("f" * 48)).otherwise(F.lit("0" * 48)), sixteen(x))


def wide_word(high: Column, low: Column) -> Column:
    """64 hex digits of high * 2^64 + low."""
    return F.concat(F.lit("0" * 32), sixteen(high), sixteen(low))


def huge_word(x: Column) -> Column:
    """64 hex digits of x * 2^128."""
    return F.concat(F.lit("0" * 16), sixteen(x), F.lit("0" * 32))


def addr(x: Column) -> Column:
    return F.concat(F.lit("0x" + "0" * 24), sixteen(x))


def topic(x: Column) -> Column:
    return F.concat(F.lit("0x"), word(x))


def hex_text(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(x.cast("bigint"))))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def raw(rows: DataFrame, address: Column, topics: list[Column], data: list[Column], block: Column, tx: Column, index: Column) -> DataFrame:
    return rows.select(address.alias("address"), F.array(*topics).alias("topics"), F.concat(F.lit("0x"), *data).alias("data"), hex_text(block).alias("blockNumber"), tx.alias("transactionHash"), hex_text(index).alias("logIndex"), F.lit("0x0").alias("transactionIndex"))


def _line(rows: DataFrame, signature: Column | str, topics: list[Column], data: list[Column]) -> DataFrame:
    first = F.lit(signature) if isinstance(signature, str) else signature
    return normalise(raw(rows, addr(F.col("l_partkey")), [first, *topics], data, F.col("l_orderkey"), topic(F.col("l_orderkey")), F.col("l_linenumber")))


@stored
def swap_v2_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = word(F.lit(0))
    return _line(spread(table(spark, sf_dir, "lineitem")), t.SWAP_V2, [topic(F.col("l_suppkey"))] * 2, [word(F.col("l_quantity").cast("bigint")), zero, zero, word(cents(F.col("l_extendedprice")))])


def swap_v3_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amount0 is negative, amount1 over 64 bits."""
    return _line(spread(table(spark, sf_dir, "lineitem")), t.SWAP_V3, [topic(F.col("l_suppkey"))] * 2, [word(-F.col("l_quantity").cast("bigint")), wide_word(cents(F.col("l_extendedprice")), F.col("l_partkey"))])


def swap_v4_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = [word(-F.col("l_quantity").cast("bigint")), word(cents(F.col("l_extendedprice"))), wide_word(F.col("l_suppkey"), F.col("l_partkey")), word(F.col("l_orderkey")), word(F.col("l_linenumber") - 4)]
    return _line(spread(table(spark, sf_dir, "lineitem")), t.SWAP_V4, [topic(F.col("l_partkey")), topic(F.col("l_suppkey"))], data)


@stored
def liquidity_logs(spark: SparkSession, sf_dir: str, amount: Callable[[Column], Column] = word) -> DataFrame:
    """Returned lines burn, all others mint, between two ticks; ``amount`` encodes the liquidity."""
    qty, low = F.col("l_quantity").cast("bigint"), F.col("l_linenumber") * 60 - 180
    ticks = [topic(F.col("l_suppkey")), topic(low), topic(low + 60)]
    rows = spread(table(spark, sf_dir, "lineitem"))
    mints = _line(rows.where("l_returnflag <> 'R'"), t.MINT_V3, ticks, [word(F.col("l_suppkey")), amount(qty), word(qty * 2), word(cents(F.col("l_extendedprice")))])
    burns = _line(rows.where("l_returnflag = 'R'"), t.BURN_V3, ticks, [amount(qty), word(qty * 2), word(cents(F.col("l_extendedprice")))])
    return mints.unionByName(burns)


def liquidity_v2_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines burn, all others mint, in pair pools: two amounts and no ticks."""
    who, amounts = topic(F.col("l_suppkey")), [word(F.col("l_quantity").cast("bigint")), word(cents(F.col("l_extendedprice")))]
    rows = spread(table(spark, sf_dir, "lineitem"))
    return _line(rows.where("l_returnflag <> 'R'"), t.MINT_V2, [who], amounts).unionByName(_line(rows.where("l_returnflag = 'R'"), t.BURN_V2, [who, topic(F.col("l_partkey"))], amounts))


def sync_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spread(table(spark, sf_dir, "lineitem")), t.SYNC, [], [word(F.col("l_quantity").cast("bigint")), word(cents(F.col("l_extendedprice")))])


@stored
def pool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd parts come from a pair factory, even ones from a pool factory."""
    key = F.col("p_partkey")
    sides = [topic(key % 100 + 1), topic((key + 1) % 100 + 1)]
    fee = F.element_at(F.array(F.lit(500), F.lit(3000), F.lit(10000)), (key % 3 + 1).cast("int"))
    parts = table(spark, sf_dir, "part")
    place = (key, topic(key), F.lit(1))
    pairs = raw(parts.where("p_partkey % 2 = 1"), addr(F.lit(7)), [F.lit(t.PAIR_CREATED), *sides], [word(key), word(F.lit(1))], *place)
    pools = raw(parts.where("p_partkey % 2 = 0"), addr(F.lit(8)), [F.lit(t.POOL_CREATED), *sides, topic(fee)], [word(F.lit(60)), word(key)], *place)
    return normalise(pairs.unionByName(pools))


@stored
def vote_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = spread(table(spark, sf_dir, "orders"))
    return normalise(raw(rows, addr(F.lit(9)), [F.lit(t.VOTE_CAST), topic(F.col("o_custkey"))], [word(F.col("o_custkey") % 50), word(support), word(cents(F.col("o_totalprice")))], F.col("o_orderkey"), topic(F.col("o_orderkey")), F.lit(0)))


@stored
def agent_logs(spark: SparkSession, sf_dir: str, amount: Callable[[Column], Column] = word) -> DataFrame:
    """Clicks freeze tokens, views unfreeze them, errors freeze accounts, signups free them, purchases transfer."""
    kind = F.col("event_type")
    user = topic(F.col("user_id"))
    signature = F.when(kind == "click", t.TOKENS_FROZEN).when(kind == "view", t.TOKENS_UNFROZEN).when(kind.isin("error", "signup"), t.ADDRESS_FROZEN).otherwise(t.TRANSFER)
    more = F.when(kind.isin("error", "signup"), F.array(topic((kind == "error").cast("int")), user)).when(kind == "purchase", F.array(user)).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "events")
    return normalise(rows.select(addr(F.col("user_id") % 10).alias("address"), F.concat(F.array(signature, user), more).alias("topics"), F.concat(F.lit("0x"), amount(cents(F.col("value")))).alias("data"), hex_text(F.col("event_id")).alias("blockNumber"), topic(F.col("event_id")).alias("transactionHash"), F.lit("0x0").alias("logIndex"), F.lit("0x0").alias("transactionIndex")))


def dao_logs(spark: SparkSession, sf_dir: str, amount: Callable[[Column], Column] = word) -> DataFrame:
    """Orders as karma, staking, lock, vault, router and fee events, by the order key's remainder."""
    k = F.col("o_orderkey") % 10
    names = [t.KARMA_MINTED, t.KARMA_SLASHED, t.STAKED, t.UNSTAKED, t.LOCK_DEPOSIT, t.LOCK_WITHDRAW, t.VAULT_RECEIVE, t.VAULT_FLUSH, t.ROUTER_CLAIM, t.FEES_RECEIVED]
    signature = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    who = F.when(k.isin(6, 7), F.col("o_custkey") % 7).otherwise(F.col("o_custkey") % 100)
    rows = table(spark, sf_dir, "orders")
    price = cents(F.col("o_totalprice"))
    return normalise(raw(rows, addr(F.lit(11)), [signature, topic(who), topic(F.col("o_custkey") % 3)], [amount(price), word(F.col("o_custkey") % 5), word(F.lit(3))], F.col("o_orderkey"), topic(F.col("o_orderkey")), F.lit(0)))


def order_logs(spark: SparkSession, sf_dir: str, *signatures: str, contract: Column | int = 12) -> DataFrame:
    """Orders as events of the given signatures, dealt by the order key's remainder.

    All have the same layout, which covers what every decoder reads: three topics and seven words, of
    which the fourth is over 64 bits and the fifth negative.
    """
    key, customer, price = F.col("o_orderkey"), F.col("o_custkey"), cents(F.col("o_totalprice"))
    signature = F.element_at(F.array(*map(F.lit, signatures)), (key % len(signatures) + 1).cast("int"))
    topics = [signature, topic(customer % 100), topic(customer % 7), topic(key % 3)]
    data = [word(customer % 50), word(price), word(key), wide_word(price, key), word(-(key % 50)), word(customer), word(customer + 10)]
    return normalise(raw(table(spark, sf_dir, "orders"), addr(contract if isinstance(contract, Column) else F.lit(contract)), topics, data, key, topic(key), F.lit(0)))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.unix_timestamp("o_orderdate").alias("timestamp"), topic(F.col("o_orderkey")).alias("hash"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(topic(F.col("o_orderkey")).alias("hash"), F.col("o_orderkey").cast("bigint").alias("block_number"), addr(F.col("o_custkey")).alias("from"), cents(F.col("o_totalprice")).cast("string").alias("value"))


def factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as factories, of which the second has the id 1."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("bigint").alias("poolCount"), F.lit(0).cast("bigint").alias("txCount"), F.lit("0").alias("totalVolumeUSD"), F.length("n_name").cast("string").alias("totalValueLockedUSD"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("string").alias("id"), (F.col("r_regionkey") * 100 + 2400).cast("string").alias("ethPriceUSD"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a token, with a price and a locked value, as text."""
    rows, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    locked = (key * 7919 % 1000).cast("string")
    price = F.concat((key / 10000).cast("bigint").cast("string"), F.lit("."), F.lpad((key % 10000).cast("string"), 4, "0"))
    return rows.select(addr(key).alias("id"), F.concat(F.lit("T"), key.cast("string")).alias("symbol"), F.col("s_name").alias("name"), F.lit(2).cast("bigint").alias("decimals"), F.lit("0").alias("volumeUSD"), locked.alias("totalValueLockedUSD"), price.alias("derivedETH"), F.lit(0).cast("bigint").alias("txCount"))


def domain_entities(spark: SparkSession, sf_dir: str, types: Sequence[str]) -> DataFrame:
    """Orders as documents of the given types, dealt by the order key's remainder: an amount and an uptime."""
    key = F.col("o_orderkey")
    data = F.to_json(F.struct(key.cast("string").alias("id"), cents(F.col("o_totalprice")).cast("string").alias("amount"), (F.col("o_custkey") % 101).alias("uptime")))
    kind = F.element_at(F.array(*map(F.lit, types)), (key % len(types) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(kind.alias("entity_type"), key.cast("string").alias("id"), data.alias("data"), key.cast("bigint").alias("block_number"), F.lit(0).cast("bigint").alias("log_order"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as validators, suppliers as delegators, nations as subnets."""
    from ledgerlake.operators.upsert import as_entities

    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    validators = as_entities(c.select(F.col("c_custkey").cast("string").alias("id"), cents(F.col("c_acctbal")).cast("string").alias("stake"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("block_number")), "Validator")
    delegators = as_entities(s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("nodeID"), F.col("s_suppkey").alias("block_number")), "Delegator")
    subnets = as_entities(n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").alias("threshold"), F.col("n_nationkey").alias("block_number")), "Subnet")
    return validators.unionByName(delegators).unionByName(subnets)


def market_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("market"), F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("filled").alias("status"))


def market_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = cents(F.col("l_extendedprice"))
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], price.cast("string"))
    return table(spark, sf_dir, "lineitem").select(ident.alias("id"), F.col("l_orderkey").cast("string").alias("order"), F.unix_timestamp("l_shipdate").alias("timestamp"), price.cast("string").alias("price"), F.col("l_quantity").cast("bigint").cast("string").alias("amount"))
