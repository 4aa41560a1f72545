"""Tables stored in buckets of their join key, so that upserts and joins leave the large side where it is.

Two tables with equal buckets of the key on which they meet are joined bucket by bucket. A batch that meets such
a table is shuffled to its buckets; the table itself is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.upsert import latest_by_key


def buckets_for(rows: DataFrame, each: int = 500_000, least: int = 8) -> int:
    """Buckets of about ``each`` rows for a table that will hold ``rows``, so that a task's memory does not grow with the table."""
    return max(least, -(-rows.count() // each))


def write_bucketed(rows: DataFrame, name: str, by: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Store ``rows`` as table ``name`` in sorted buckets of ``by``, at ``path`` if given, and read it back.

    Rows are dealt to the buckets first, so a bucket is one file, which keeps it sorted for the reader. Choose
    ``buckets`` so that one is some hundred megabytes, and equal for tables that are joined on these columns.
    """
    dealt = rows.repartition(buckets, *by)
    dealt.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(name, **({"path": path} if path else {}))
    return rows.sparkSession.table(name)


def upsert_bucketed(old: DataFrame, new: DataFrame, buckets: int, keys: Sequence[str] = ("id",), order: Sequence[str] = ("block_number", "log_order")) -> DataFrame:
    """``upsert`` of a batch into a table in buckets of ``keys`` (one row a key): the newest rows of the batch meet the table by a full join.

    The batch is shuffled to the table's ``buckets`` and combined there; the table is scanned, bucket by bucket, and
    has no exchange and no aggregate. Equal orders are settled by the other columns, as in ``upsert``. Keys are not null.
    """
    rest = [c for c in old.columns if c not in keys and c not in order]

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.struct(*order, *rest).alias(name))

    met = packed(old, "old_row").join(packed(latest_by_key(new.select(old.columns).repartition(buckets, *keys), keys, order), "new_row"), list(keys), "full")
    won = met.select(*keys, F.greatest("old_row", "new_row").alias("r"))
    return won.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in old.columns])


def merge_into(spark: SparkSession, name: str, new: DataFrame, keys: Sequence[str], buckets: int, next_name: str, path: str | None = None, order: Sequence[str] = ("block_number", "log_order")) -> DataFrame:
    """Upsert ``new`` into table ``name`` and store the result as ``next_name``, in the same buckets; ``name`` stays as it is for its readers.

    The result comes in the table's buckets already, so writing it shuffles nothing.
    """
    merged = upsert_bucketed(spark.table(name), new, buckets, keys, order)
    merged.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(next_name, **({"path": path} if path else {}))
    return spark.table(next_name)
