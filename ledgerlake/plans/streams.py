"""Queries that run a stream to its end over the tables' logs, and return what it leaves."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.decode import amm, defi, securities
from ledgerlake.operators import enrich, entities, partials, rollups
from ledgerlake.operators.upsert import as_documents, latest_by_key, read_entities, upsert_stored_entities
from ledgerlake.plans import registry as _registry
from ledgerlake.plans.queries import _AGENT, _SWAPS, _period, _pools, _timed, manifest, totals_as_text
from ledgerlake.plans.registry import query as _query
from ledgerlake.sources import synth
from ledgerlake.sources.bucketed import buckets_for, merge_into, write_bucketed
from ledgerlake.sources.logs import read_stored, write_logs, write_logs_by_address
from ledgerlake.streaming import index, progress, state


#: A store puts its buffer on disk when a batch ends: stores share the bounded memory, and what idle ones keep of it leaves so little to the others
#: that they write files of a few rows and wait until these are merged. No write reads first to count rows.
_ON_DISK = {"changelogCheckpointing__enabled": "false", "boundedMemoryUsage": "true", "trackTotalNumberOfRows": "false"}
#: A join keeps its two sides' rows and counts in one store a partition instead of four.
_JOINS = {"spark__sql__streaming__join__stateFormatVersion": "3"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir; under a temporary one in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def session(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings for a while."""
    names = {k: k.replace("__", ".") for k in conf}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, conf[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(rows: DataFrame, folder: str, *by: str) -> DataFrame:
    """``rows`` from files, for what reads them several times: logs are decoded once. Columns ``by`` of few values are folders."""
    with session(rows.sparkSession, spark__sql__maxConcurrentOutputFileWriters="8" if by else "0"):  # folders are written side by side, without a sort
        rows.write.partitionBy(*by).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def as_stream(rows: DataFrame, folder: str, batches: int = 3, key: str | None = None) -> DataFrame:
    """``rows`` written to files, and read as a stream of about so many batches, in no order of blocks.

    A batch has a file for every core; the last one has room for one file more, that comes later. Files are sorted by
    ``key``, if given: a store that is asked for keys in their order finds most of them in the block that it has just read.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(batches * max(2, spark.sparkContext.defaultParallelism) - 1)
    (dealt.sortWithinPartitions(key) if key else dealt).write.parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", math.ceil((files + 1) / batches)).parquet(folder)


def stores_for(spark: SparkSession, folder: str, each: int = 500_000) -> int:
    """Partitions of the state of a stream over the files at ``folder``: of ``each`` rows at most or so, and as many for every core.

    A stream keeps the number that it starts with, and every batch loads and commits all of its stores, with rows or without.
    """
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-spark.read.parquet(folder).count() // (each * cores)))


def run_to_the_end(stream: DataFrame, folder: str, stores: int | None = None) -> DataFrame:
    """The rows that an append stream has written once all that is available is processed. Its state is kept on disk, in bounded memory: it grows with the rows.

    ``stores``: partitions of each operator's state, by default as many as of any shuffle.
    """
    own = {} if stores is None else {"spark__sql__shuffle__partitions": str(stores)}
    with session(stream.sparkSession, spark__sql__streaming__stateStore__providerClass=state.ROCKSDB, **own, **_JOINS, **{f"spark__sql__streaming__stateStore__rocksdb__{k}": v for k, v in _ON_DISK.items()}):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _stored_states(spark: SparkSession, sf: str, make: Callable[[DataFrame, int], DataFrame], name: str) -> DataFrame:
    """States of the swaps that three increments of blocks leave, the first of which comes again at the end.

    Increments are ranges that end inside a span, so one span gets rows of two of them. Each is a folder, and reads no
    other's rows; merging keeps the last swap of each id, so they come as they are decoded.
    """
    folder = scratch(spark, name)
    top = synth.swap_v2_logs(spark, sf).agg(F.max("block_number")).first()[0]
    span = 1 + top // 8
    swaps = written(_timed(spark, sf, upserted=False).withColumn("part", F.floor(F.col("block_number") * 3 / (top + 1)).cast("int")), f"{folder}/in", "part")
    parts = [swaps.where(F.col("part") == k).drop("part") for k in range(3)]
    for part in (*parts, parts[0]):
        index.merge_batch(part, f"{folder}/swaps", derived={f"{folder}/states": lambda rows: make(rows, span)}, span=span, hot=False)
    return index.read_table(spark, f"{folder}/states")


@_query(_registry.SQL["upsert_swaps"])
def bucketed_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches and a replay into tables in buckets of the id, which stay where they are."""
    rows, folder = amm.swaps_v2(synth.swap_v2_logs(spark, sf)), scratch(spark, "buckets")
    first, second = (rows.where(F.col("block_number") % 2 == k) for k in (0, 1))
    names, buckets = [f"swaps_{uuid.uuid4().hex}" for _ in range(3)], buckets_for(rows)
    write_bucketed(latest_by_key(first, ("id",)), names[0], ["id"], buckets, f"{folder}/0")
    for k, batch in ((1, second), (2, second)):
        merge_into(spark, names[k - 1], batch, ["id"], buckets, names[k], f"{folder}/{k}")
    return spark.table(names[2]).select("id", "pool", "amount0", "amount1", "sender")


@_query(_registry.SQL["routed_logs"])
def routed_stored_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest's rules over logs stored by signature and by interleaved bits of address and block."""
    folder = scratch(spark, "logs")
    write_logs_by_address(synth.agent_logs(spark, sf), folder)
    return enrich.route_stored(spark, folder, manifest(spark, sf)).groupBy("handler").agg(F.count("*").alias("logs"))


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(round(c_acctbal * 100) AS BIGINT)::VARCHAR AS stake, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND round(c_acctbal * 100) >= 1000 ORDER BY round(c_acctbal * 100) DESC, 1 LIMIT 1000""")
def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """VARIANT documents upserted on disk, twice those of one type, then filtered and ordered by their paths."""
    folder, rows = scratch(spark, "documents"), as_documents(synth.entities(spark, sf))
    upsert_stored_entities(rows, folder)
    upsert_stored_entities(rows.where("entity_type = 'Delegator'"), folder)
    stored = read_entities(spark, folder, "variant")
    found = entities.list_documents(stored, "Validator", 1000, "stake", "desc", {"segment": "BUILDING", "stake_gte": "1000"})
    return found.select("id", entities.at_path("stake").alias("stake"), entities.at_path("segment").alias("segment"))


@_query(_registry.SQL["pool_days"])
def pool_days_from_states(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of spans of blocks, kept as increments come and merged to days."""
    states = _stored_states(spark, sf, lambda swaps, span: partials.pool_states(swaps, span, amounts=()), "pool-states")
    return _period(partials.pool_period(states, _pools(spark, sf)), "pool", "date")


@_query(_registry.SQL["token_days"])
def token_days_from_states(spark: SparkSession, sf: str) -> DataFrame:
    pools = written(_pools(spark, sf), scratch(spark, "pools"))  # every increment reads them
    states = _stored_states(spark, sf, lambda swaps, span: partials.token_states(swaps, pools, span, amounts=()), "token-states")
    return _period(partials.token_period(states), "token", "date")


@_query(_registry.SQL["pool_totals"])
def pool_totals_from_states(spark: SparkSession, sf: str) -> DataFrame:
    """Totals from days, which come from hours."""
    hours = partials.pool_states(_timed(spark, sf))
    return totals_as_text(partials.pool_totals(partials.merge_periods(hours, "pool"), _pools(spark, sf)))


@_query(_registry.SQL["pool_days"])
def streamed_pool_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days by two stateful operators, swaps in no order; a mark far in the future, in the last file, closes every day but its own."""
    folder, late = scratch(spark, "days"), 400_000
    swaps = _timed(spark, sf).select("id", "pool", "timestamp", "amount0", "amount1", "amountUSD", "block_number", "log_order")
    stream = as_stream(swaps, f"{folder}/in")
    mark = F.lit(spark.read.parquet(f"{folder}/in").agg(F.max("timestamp")).first()[0] + (late + 3) * rollups.DAY)
    spark.range(1).select(F.lit("mark").alias("id"), F.lit("mark").alias("pool"), mark.cast("bigint").alias("timestamp"), *[F.lit("1").alias(c) for c in ("amount0", "amount1", "amountUSD")], F.lit(0).cast("bigint").alias("block_number"), F.lit(0).cast("bigint").alias("log_order")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    pools = written(_pools(spark, sf), f"{folder}/pools")  # every batch reads them
    days = run_to_the_end(index.day_stream(index.watermarked(stream, f"{late} days"), pools), folder, stores_for(spark, f"{folder}/in"))
    return _period(days, "pool", "date")


@_query("""WITH l AS (SELECT o_orderkey AS b FROM orders), m AS (SELECT max(b) AS top, max(b) // 8 AS step FROM l), s AS (SELECT unnest(range(0, top + 1, step + 1)) AS f, top, step FROM m)
SELECT CAST(f AS BIGINT) AS first_block, CAST(least(f + step, top) AS BIGINT) AS last_block, (SELECT count(*) FROM l WHERE b BETWEEN f AND f + step) AS events, CAST(top - least(f + step, top) AS BIGINT) AS lag FROM s""")
def indexed_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of an index run over votes in steps of blocks, and of a second run that finds nothing new.

    Logs are stored by block first, so that a step reads its own and encodes none.
    """
    folder, made = scratch(spark, "progress"), synth.vote_logs(spark, sf)
    step = made.agg(F.max("block_number")).first()[0] // 8
    write_logs(made, f"{folder}/logs", step + 1)
    logs = read_stored(spark, f"{folder}/logs").drop("block_bucket")
    for _ in range(2):
        progress.index_new_blocks(logs, f"{folder}/progress", "votes", lambda part: index.merge_batch(defi.votes(part), f"{folder}/votes", ("contract", "tx_hash", "log_index"), span=step + 1), step=step)
    return progress.read_progress(spark, f"{folder}/progress").select("first_block", "last_block", "events", "lag")


@_query(f"""WITH {_AGENT}, f AS (SELECT * FROM a WHERE event_type IN ('click', 'view')), x AS (SELECT * FROM a WHERE event_type IN ('error', 'signup'))
SELECT 'total' AS change, CAST(event_id AS VARCHAR) AS id, CAST(sum(CASE WHEN event_type = 'click' THEN c ELSE -c END) OVER (PARTITION BY token, usr ORDER BY event_id) AS VARCHAR) AS value FROM f
UNION ALL SELECT 'tokens', token || ':' || usr, CASE arg_max(event_type, event_id) WHEN 'click' THEN 'TokensFrozen ' ELSE 'TokensUnfrozen ' END || arg_max(c, event_id) FROM f GROUP BY token, usr
UNION ALL SELECT 'account', token || ':' || usr, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'frozen' ELSE 'free' END FROM x GROUP BY token, usr""")
def streamed_freezes(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts, tokens and running totals from keyed state, over batches in no order."""
    folder = scratch(spark, "freezes")
    actions = as_stream(securities.transfer_agent_actions(synth.agent_logs(spark, sf)), f"{folder}/in")
    changes = run_to_the_end(state.freeze_changes(actions, horizon=1 << 40), folder)
    now = state.current_freezes(changes)
    parts = [
        now["totals"].select(F.lit("total").alias("change"), F.col("block_number").cast("string").alias("id"), F.col("total").alias("value")),
        now["tokens"].select(F.lit("tokens"), "id", F.concat_ws(" ", "kind", "delta")),
        now["accounts"].select(F.lit("account"), "id", F.when(F.col("frozen"), "frozen").otherwise("free")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@_query(f"WITH {_SWAPS} SELECT pool AS address, count(*) AS events FROM s JOIN part ON l_partkey = p_partkey WHERE l_orderkey >= p_partkey GROUP BY pool")
def streamed_announced_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Swaps of pools that a second stream announces, both in no order. Logs wait in state with the columns that the result needs."""
    folder = scratch(spark, "announced")
    logs = as_stream(synth.swap_v2_logs(spark, sf).select("address", "block_number"), f"{folder}/logs", key="address")
    pools = as_stream(amm.pools(synth.pool_logs(spark, sf)).select("id", "created_block"), f"{folder}/pools", key="id")
    found = run_to_the_end(state.announced_stream(logs, pools, late=1 << 31, span=1 << 31), folder, stores_for(spark, f"{folder}/logs"))
    return found.groupBy("address").agg(F.count("*").alias("events"))
