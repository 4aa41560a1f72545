"""Continuous indexing: logs in, typed tables out, each micro-batch an idempotent upsert.

A table is a folder of Parquet, partitioned by a hash of the key, or by spans of blocks where a key
never changes its block, so that a batch falls into few partitions. A batch rewrites the partitions
that its rows fall into, and no others. What it will write is complete in a folder beside them before they
are replaced, so that a batch that is cut short is finished by the next one. Merging rows again changes
nothing: replays, restarts and new checkpoints need no record of what has been done.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators import partials
from ledgerlake.operators.rollups import DAY, HOUR, by_token, factory_columns, ohlc, price, with_fees
from ledgerlake.operators.upsert import upsert
from ledgerlake.sources.logs import known_events, normalise
from ledgerlake.topics import ALL

BUCKETS = 64
_FEW = 4
_PENDING = "_pending"  # Spark's readers pass over names that begin like this


@dataclass(frozen=True)
class Table:
    """An output of a stream: ``decode`` makes its rows, the newest row of every ``keys`` stays.

    ``by`` are the columns whose hash partitions it (the keys, unless given; equal keys must agree in
    them). With ``span``, partitions are spans of so many blocks instead: for events, whose log has one
    block. Choose either so that a partition is about what one batch may rewrite.
    ``derived`` are tables recomputed, partition by partition, from this one's rows: current states and
    running totals, grouped by columns that include ``by``.
    """

    decode: Callable[[DataFrame], DataFrame]
    keys: Sequence[str] = ("id",)
    by: Sequence[str] = ()
    derived: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    order: Sequence[str] = ("block_number", "log_order")
    span: int | None = None


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _has_rows(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(at))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows, or None where nothing has been written yet."""
    return spark.read.parquet(path).drop("bucket") if _has_rows(spark, path) else None


def _bucket(by: Sequence[str], buckets: int, span: int | None = None) -> Column:
    at = F.floor(F.col("block_number") / span) if span else F.pmod(F.xxhash64(*by), F.lit(buckets))
    return at.cast("int").alias("bucket")


def _finish(spark: SparkSession, path: str) -> None:
    """Put complete pending partitions in their places, folder by folder, without reading them; one that was cut short in this goes on with the folders that are left."""
    pending = f"{path}/{_PENDING}"
    fs, at = _folder(spark, pending)
    if _exists(spark, f"{pending}/_SUCCESS"):
        for folder in (s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")):
            place = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), folder.getName())
            fs.delete(place, True)
            if not fs.rename(folder, place):
                raise OSError(f"cannot rename {folder} to {place}")
    fs.delete(at, True)


def _replace(rows: DataFrame, path: str, bucket: Column, few: bool) -> None:
    """Replace the partitions of ``rows``, which are computed in full before the table is touched.

    Where a batch falls into ``few`` of them, every task writes a file into each, and rows need no shuffle of their own for it.
    """
    dealt = rows.withColumn("bucket", bucket)
    (dealt if few else dealt.hint("rebalance", "bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{_PENDING}")
    _finish(rows.sparkSession, path)


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str] = ("id",), by: Sequence[str] = (), derived: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, order: Sequence[str] = ("block_number", "log_order"), buckets: int = BUCKETS, span: int | None = None, hot: bool = True) -> None:
    """Upsert a batch into the table at ``path``, then recompute the ``derived`` tables (path -> function) there.

    A replayed batch changes nothing; an older row never replaces a newer one. Only partitions that
    the batch falls into are read and written. ``hot`` as in ``upsert``.
    """
    spark, bucket = batch.sparkSession, _bucket(by or keys, buckets, span)
    touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()]  # a few numbers
    if not touched:
        return
    few = len(touched) <= _FEW
    _finish(spark, path)
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket") if _has_rows(spark, path) else None
    _replace(upsert(old, batch, keys, order, hot), path, bucket, few)
    for name, make in (derived or {}).items():
        own = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        _replace(make(own), name, bucket, few)


def index_stream(raw: DataFrame, tables: Mapping[str, Table | Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, seconds: float | None = None, topics: Sequence[str] = ALL, buckets: int = BUCKETS) -> StreamingQuery:
    """Decode a stream of raw logs into tables under ``out``; a decoder alone stands for a table keyed by id.

    ``topics`` are the signatures that are kept, by default all that any decoder reads. ``seconds``
    polls at that interval; without it, all that is available is processed and the query ends. Counts
    of logs and the latest block are observed as metric "progress".
    """
    logs = known_events(normalise(raw), topics).observe("progress", F.count("*").alias("events_indexed"), F.max("block_number").alias("latest_block"))
    specs = {name: t if isinstance(t, Table) else Table(t) for name, t in tables.items()}

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, t in specs.items():
                merge_batch(t.decode(batch), f"{out}/{name}", t.keys, t.by, {f"{out}/{n}": f for n, f in t.derived.items()}, t.order, buckets, t.span)
        finally:
            batch.unpersist()

    writer = logs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(processingTime=f"{seconds} seconds").start() if seconds else writer.trigger(availableNow=True).start()


def watermarked(swaps: DataFrame, late: str = "2 hours") -> DataFrame:
    """``at`` from ``timestamp`` (unix seconds), with a watermark; the two functions below take such a stream."""
    return swaps.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)


def drop_replays(swaps: DataFrame) -> DataFrame:
    """Rows of an append-only stream once per id, within the watermark."""
    return swaps.dropDuplicatesWithinWatermark(["id"])


def rollup_stream(swaps: DataFrame, pools: DataFrame, seconds: int = HOUR, label: str = "periodStartUnix") -> DataFrame:
    """The fields of ``rollups.pool_period`` as a stream of tumbling windows: per pool and window txCount, volumeUSD, open, high, low, close, feesUSD.

    ``pools`` is a static table. State is one row per pool and window, dropped once the watermark has passed.
    """
    rows = ohlc(swaps.withColumn("window", F.window("at", f"{seconds} seconds")), ["pool", "window"], price())
    timed = rows.withColumn(label, F.unix_timestamp("window.start")).drop("window")
    return with_fees(timed, pools).withColumn("id", F.concat_ws("-", "pool", F.col(label).cast("string")))


def day_stream(swaps: DataFrame, pools: DataFrame, kind: str = "pool", label: str = "date") -> DataFrame:
    """Days of pools, tokens or the factory (``kind``) as a stream, by two stateful operators in a row.

    The first keeps a mergeable state for each key and hour; an hour that the watermark has closed goes on to the
    second, which keeps one for each key and day. So a day's state gets 24 rows a key, not its swaps, and late swaps
    within the watermark are in both. For append mode: a day comes once, when it is closed, in the columns of
    ``rollups.pool_period``, ``token_period`` or ``factory_period``. ``swaps`` as from ``watermarked``; ``pools`` is a static table.
    """
    rows = by_token(swaps, pools, ("at",)) if kind == "token" else swaps
    key, amounts = ("token", ["amount"]) if kind == "token" else ("pool", ["amount0", "amount1"])
    priced = rows.withColumn("price", price("amount", "other") if kind == "token" else price())
    hours = priced.groupBy(key, F.window("at", f"{HOUR} seconds")).agg(*partials.state_columns(amounts))
    days = hours.groupBy(key, F.window(F.window_time("window"), f"{DAY} seconds").alias("day")).agg(*partials.merged_columns(hours))
    timed = partials.with_prices(days.withColumn(label, F.unix_timestamp("day.start")))
    if kind == "token":
        return timed.select("token", label, "txCount", "volumeUSD", "open", "high", "low", "close", F.concat_ws("-", "token", F.col(label).cast("string")).alias("id"))
    full = with_fees(timed, pools).select("pool", "day", label, "txCount", "volumeUSD", "open", "high", "low", "close", "feesUSD", F.concat_ws("-", "pool", F.col(label).cast("string")).alias("id"))
    if kind == "pool":
        return full.drop("day")
    every = full.groupBy(F.window(F.window_time("day"), f"{DAY} seconds").alias("all_day")).agg(*factory_columns())
    return every.select(F.unix_timestamp("all_day.start").alias(label), "txCount", "volumeUSD", "feesUSD")
