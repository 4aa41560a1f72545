"""Last write wins: typed tables and generic entities are replaced by key, row for row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("block_number", "log_order"), hot: bool = True) -> DataFrame:
    """The row with the greatest ``order`` of every key; equal orders are settled by the other columns, left to right.

    An aggregate with map-side combination: a hot key sends one row per task, which a window would
    not. The row itself is what is compared, so that it travels once. ``hot=False`` is for keys of which few come
    twice, as ids of logs: rows are shuffled as they come, and sorted once, by a hash first. A sort looks at eight bytes of
    its first column, in which ids of a kind are all alike.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("r")
    groups = rows.groupBy(*keys) if hot else rows.repartition(*keys).groupBy(F.xxhash64(*keys), *keys)
    return groups.agg(best).select(*[F.col(k) if k in keys else F.col(f"r.{k}").alias(k) for k in rows.columns])


def upsert(old: DataFrame | None, new: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str] = ("block_number", "log_order"), hot: bool = True) -> DataFrame:
    """``new`` rows replace whole ``old`` rows of the same key unless they are older. Replaying is harmless."""
    return upsert_all(old, [new], keys, order, hot)


def upsert_all(old: DataFrame | None, batches: Sequence[DataFrame], keys: Sequence[str] = ("id",), order: Sequence[str] = ("block_number", "log_order"), hot: bool = True) -> DataFrame:
    """What upserting the batches one after another gives, by one aggregate and one shuffle: the newest row wins whatever the batches' order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x for x in (old, *batches) if x is not None])
    return latest_by_key(rows, keys, order, hot)


def as_entities(rows: DataFrame, entity_type: str, ident: str = "id") -> DataFrame:
    """Typed rows as generic entities: the whole row as one JSON document."""
    data = [c for c in rows.columns if c not in ("block_number", "log_order")]
    version = [F.col(c).cast("long").alias(c) if c in rows.columns else F.lit(0).cast("long").alias(c) for c in ("block_number", "log_order")]
    return rows.select(F.lit(entity_type).alias("entity_type"), F.col(ident).cast("string").alias("id"), F.to_json(F.struct(*data)).alias("data"), *version)


def upsert_entities(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """By (entity_type, id); documents are replaced, never merged."""
    return upsert(old, new, ("entity_type", "id"))


def as_documents(entities: DataFrame) -> DataFrame:
    """Entities with their document as VARIANT, for types without a declared schema; malformed text is null."""
    return entities.withColumn("data", F.try_parse_json("data"))


def upsert_documents(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``upsert_entities`` for VARIANT documents; equal orders are settled by the document's text."""
    rows = new if old is None else old.unionByName(new)
    order = F.struct("block_number", "log_order", F.to_json("data").alias("text"))
    best = F.max_by(F.struct("data", "block_number", "log_order"), order).alias("r")
    return rows.groupBy("entity_type", "id").agg(best).select("id", "r.data", "r.block_number", "r.log_order", "entity_type")


def write_entities(entities: DataFrame, path: str) -> None:
    """One folder per entity type, so that get and list read their own type only. Types that ``entities`` does not hold stay as they are."""
    entities.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_type").parquet(path)


def upsert_stored_entities(new: DataFrame, path: str) -> None:
    """Upsert ``new`` into the entities stored at ``path``: types that it holds are read, merged and replaced, others are not touched.

    Documents are stored as they come, as text or (``as_documents``) as VARIANT, one or the other at a path. The
    merged types are complete in a folder beside them before any is replaced, so a job that dies in the
    middle loses nothing; the next upsert puts a complete one in place first. Upserting rows again changes nothing.
    """
    kind = new.schema["data"].dataType.simpleString()
    merge = upsert_documents if kind == "variant" else upsert_entities
    spark, staged = new.sparkSession, f"{path.rstrip('/')}/_staged"
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put_in_place() -> None:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{staged}/_SUCCESS")):
            write_entities(read_entities(spark, staged, kind), path)
        fs.delete(at, True)

    put_in_place()
    types = [r[0] for r in new.select("entity_type").distinct().collect()]  # names of types, not rows
    old = read_entities(spark, path, kind).where(F.col("entity_type").isin(types)) if types and fs.exists(at.getParent()) else None
    merge(old, new).write.partitionBy("entity_type").parquet(staged)
    put_in_place()


def read_entities(spark: SparkSession, path: str, data: str = "string") -> DataFrame:
    """Stored entities; ``data`` is "variant" where documents were stored as such."""
    return spark.read.schema(f"id string, data {data}, block_number long, log_order long, entity_type string").parquet(path)
