"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python fewer rows at a time than Spark's 10,000: texts can be long, and a batch is held whole.

    This sets the session's own setting, and leaves it so: plans read it when they run, not when they are built.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    A temporary folder only in local mode (tests); RuntimeError on a cluster that names none, where
    every machine would write its own part to its own disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def write_stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back; the folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a written table."""
    return write_stage(df)[0]


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage that nothing reads any more."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def join_by_key(rows: DataFrame, named: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """rows x named on ``key``, without gathering a hot key in one task.

    ``named`` has one row per key, with the number ``n`` of its rows among ``total``. Keys that hold
    over 1 / ``share`` of all rows are fewer than ``share``, so they are broadcast; the others meet
    in a shuffle. Both inputs are read twice: hand in staged tables.
    """
    hot = F.col(n) * share > total
    few, many = (F.broadcast(named.where(hot).drop(n)), named.where(~hot).drop(n))
    often = rows.join(few, key)
    return often.unionByName(rows.join(few.select(key), key, "left_anti").join(many, key))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def may_train(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned: the remainder is known and is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (case ignored, as Spark compares)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def bounded_sample(df: DataFrame, by: str, id_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by a hash of the id; one row for a repeated id.

    Only the number of rows per class reaches the driver. Used to fit models, never to score.
    """
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in sorted(sizes.items(), key=str):
        keep = keep | ((F.col(by) == F.lit(value)) & (draw < F.lit(round(1e6 * min(1.0, per_class / n)))))
    rest = [c for c in df.columns if c != id_col]
    return df.where(keep).groupBy(id_col).agg(F.min(F.struct(*rest)).alias("r")).select(id_col, *[F.col(f"r.{c}").alias(c) for c in rest])


def text_chunks(docs: DataFrame, text: str, target_bytes: int, stable: bool) -> tuple[DataFrame, str, int]:
    """Deal documents into chunks of about ``target_bytes`` of text by a hash of their place in the table.

    Returns the documents with a chunk column, that column's name and the total of bytes. Neither
    copies of a text nor rows that agree in every column meet in one chunk more often than others.
    ``stable`` says that ``docs`` gives the same rows in the same partitions and order whenever it is
    computed again, as a scan of files does; it is written to the shared folder first otherwise.
    """
    docs = docs if stable else staged(docs)
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    chunks = max(1, -(-total // target_bytes))
    name = fresh(docs.columns, "chunk")
    return docs.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(29)), F.lit(chunks))), name, total
