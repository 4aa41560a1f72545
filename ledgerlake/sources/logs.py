"""Reading raw logs and bringing them into the form that the decoders take."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.functions import hexwords as hx
from ledgerlake.topics import KNOWN

BLOCKS_PER_STEP = 2000


def read_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw logs from JSON lines or Parquet, by the declared schema."""
    return spark.read.schema(schemas.RAW_LOG).format(fmt).load(path)


def stream_logs(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.RAW_LOG).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def normalise(raw: DataFrame) -> DataFrame:
    """Text numbers become BIGINT (0 where they cannot be read); topic0 and the order of logs get columns.

    Logs without topics are dropped. ``log_index`` stays raw hex for ids, ``log_order`` sorts.
    """
    return raw.where(hx.has_topics(1)).select(
        "address",
        "topics",
        F.coalesce("data", F.lit("")).alias("data"),
        hx.hex_number(F.col("blockNumber")).alias("block_number"),
        F.col("transactionHash").alias("tx_hash"),
        F.col("logIndex").alias("log_index"),
        hx.hex_number(F.col("transactionIndex")).alias("tx_index"),
        F.get("topics", 0).alias("topic0"),
        hx.hex_number(F.col("logIndex")).alias("log_order"),
    )


def known_events(logs: DataFrame, topics: Iterable[str] = KNOWN) -> DataFrame:
    return logs.where(F.col("topic0").isin(*topics))


def block_slice(logs: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks ``first`` to ``last``, both included."""
    return logs.where(F.col("block_number").between(first, last))


def next_step(last_indexed: int, latest: int, step: int = BLOCKS_PER_STEP) -> tuple[int, int] | None:
    """The next range of blocks to index (step + 1 of them), or None where nothing is new."""
    if latest <= last_indexed:
        return None
    return last_indexed + 1, min(latest, last_indexed + 1 + step)


def write_logs(logs: DataFrame, path: str, blocks_per_folder: int = BLOCKS_PER_STEP) -> None:
    """Parquet by signature and block bucket, so that a decoder or a range reads its folders only.

    Rebalanced by both, so that a folder is one file where it is small and many where a signature is frequent.
    """
    bucketed = logs.withColumn("block_bucket", F.floor(F.col("block_number") / blocks_per_folder))
    bucketed.hint("rebalance", "topic0", "block_bucket").write.mode("append").partitionBy("topic0", "block_bucket").parquet(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Logs that ``write_logs`` stored; filters on topic0 and on ``block_bucket`` prune folders."""
    return spark.read.schema(schemas.STORED_LOG).parquet(path)


#: Bits of a zone from the address, and blocks that share its other bits.
ADDRESS_BITS, BLOCKS_PER_ZONE = 5, 100_000


def _address_bits(address: Column) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(1 << ADDRESS_BITS))


def zone(address: Column, block: Column) -> Column:
    """Interleaved bits of the address (of its hash: addresses of one kind can begin alike) and of the block's span, the lowest ``ADDRESS_BITS`` of each; the span's higher bits stand above them.

    Zones beside one another hold neighbouring spans of neighbouring hashes, and either an address or a
    range of blocks alone leaves few of them.
    """
    a, b = _address_bits(address), F.floor(block / BLOCKS_PER_ZONE).cast("bigint")
    low = reduce(Column.__add__, [F.shiftleft(F.getbit(x, F.lit(k)).cast("bigint"), 2 * k + n) for k in range(ADDRESS_BITS) for n, x in enumerate((a, b))])
    return F.shiftleft(F.shiftright(b, ADDRESS_BITS), 2 * ADDRESS_BITS) + low


def address_of_zone(z: Column) -> Column:
    """The address bits of a zone."""
    return reduce(Column.__add__, [F.shiftleft(F.getbit(z, F.lit(2 * k)).cast("bigint"), k) for k in range(ADDRESS_BITS)])


def write_logs_by_address(logs: DataFrame, path: str) -> None:
    """Parquet by signature and zone, sorted by address inside a file, with bloom filters on the address.

    A folder is one file where it is small, and many, by ranges of addresses, where a signature is frequent.
    """
    zoned = logs.withColumn("zone", zone(F.col("address"), F.col("block_number")))
    dealt = zoned.repartitionByRange("topic0", "zone", "address").sortWithinPartitions("topic0", "zone", "address", "block_number", "log_order")
    dealt.write.mode("append").option("parquet.bloom.filter.enabled#address", "true").partitionBy("topic0", "zone").parquet(path)


def read_by_address(spark: SparkSession, path: str, topics: Iterable[str] | None = None, addresses: Iterable[str] | None = None, first_block: int | None = None, last_block: int | None = None) -> DataFrame:
    """Logs that ``write_logs_by_address`` stored, of these signatures, contracts and blocks (None: any).

    Folders of other signatures, of other bits of addresses and of other spans are not read; in the files
    that are, row groups go by their statistics and bloom filters.
    """
    rows = spark.read.schema(schemas.ADDRESSED_LOG).parquet(path)
    if topics is not None:
        rows = rows.where(F.col("topic0").isin(*topics))
    if addresses is not None:
        wanted = list(addresses)
        bits = spark.range(1).select(F.array_distinct(F.array(*[_address_bits(F.lit(a)) for a in wanted])).alias("b")).first()["b"] if wanted else []
        rows = rows.where(address_of_zone(F.col("zone")).isin(bits) & F.col("address").isin(wanted))
    span = F.shiftleft(F.shiftright("zone", 2 * ADDRESS_BITS), ADDRESS_BITS) + reduce(Column.__add__, [F.shiftleft(F.getbit("zone", F.lit(2 * k + 1)).cast("bigint"), k) for k in range(ADDRESS_BITS)])
    if first_block is not None:
        rows = rows.where((span >= first_block // BLOCKS_PER_ZONE) & (F.col("block_number") >= first_block))
    if last_block is not None:
        rows = rows.where((span <= last_block // BLOCKS_PER_ZONE) & (F.col("block_number") <= last_block))
    return rows.drop("zone")
