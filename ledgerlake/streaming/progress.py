"""Stored progress: which blocks have been indexed, by whom, and how far behind the chain that was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ledgerlake.sources.logs import BLOCKS_PER_STEP, block_slice, next_step

_ROWS = "name string, first_block long, last_block long, events long, lag long, batch long"


def append_progress(spark: SparkSession, path: str, name: str, first_block: int, last_block: int, events: int, lag: int | None, batch: int) -> None:
    """One more row; what is stored is never changed. ``lag``: blocks that the source has beyond ``last_block``, null where that is not known."""
    spark.createDataFrame([(name, first_block, last_block, events, lag, batch)], _ROWS).coalesce(1).write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """All rows so far; none where nothing has been stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _ROWS)
    return spark.read.schema(_ROWS).parquet(path)


def last_block(spark: SparkSession, path: str, name: str) -> int | None:
    """The last block that ``name`` has indexed, or None."""
    return read_progress(spark, path).where(F.col("name") == name).agg(F.max("last_block")).first()[0]


def index_new_blocks(logs: DataFrame, path: str, name: str, write: Callable[[DataFrame], None], step: int = BLOCKS_PER_STEP, start: int = -1) -> int:
    """Index, step by step, the blocks that the progress at ``path`` does not have; the number of steps taken.

    ``write`` gets the logs of a step and must be idempotent (an upsert): progress is stored after it, so a run that
    dies between the two does the step again. Without new blocks nothing is written. Counts are
    observed while ``write`` reads, not by a pass of their own; ``start`` is the block before the first.
    """
    spark, steps = logs.sparkSession, 0
    latest = logs.agg(F.max("block_number")).first()[0]
    done = last_block(spark, path, name)
    at = start if done is None else done
    while latest is not None and (blocks := next_step(at, latest, step)):
        seen = Observation()
        write(block_slice(logs, *blocks).observe(seen, F.count("*").alias("events")))
        append_progress(spark, path, name, *blocks, seen.get["events"], latest - blocks[1], steps)
        at, steps = blocks[1], steps + 1
    return steps


class ProgressListener(StreamingQueryListener):
    """Appends what ``index.index_stream`` observes ("progress": events_indexed, latest_block) after each batch that had logs.

    ``spark.streams.addListener(ProgressListener(spark, path))``; queries are told apart by their name, or else
    their id. The first block of a batch follows the last one of the batch before it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get("progress")
        if row is None or row["latest_block"] is None:
            return
        name = p.name or str(p.id)
        before = last_block(self.spark, self.path, name)
        first = -1 if before is None else before
        append_progress(self.spark, self.path, name, min(first + 1, row["latest_block"]), max(first, row["latest_block"]), row["events_indexed"], None, p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
