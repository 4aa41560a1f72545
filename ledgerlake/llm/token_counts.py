"""Token counts through a digest cache.

The cache is a table (digest, version, n_tokens) in a folder. A text's digest is the SHA-256 of its
normalised content, the version is the SHA-256 of the tokenizer file's bytes and of the library's
name, so that a changed tokenizer never meets old counts. Documents are joined to the cache on both
digests; only distinct misses are encoded, and appended to the folder.

Normalising may not change a count. Tokenizers look for special strings before they normalise, and
keep white space and case as they like, so null as empty text is all that holds for every one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import exists, join_by_key, staged

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


@lru_cache(maxsize=2)
def _counter(path: str):
    """text list -> counts, by the library that the file's name asks for; one per Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(pieces.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(path.rpartition(".")[2].encode() + b"\0" + f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing has been stored yet."""
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``), one row per document.

    Reads the cache at ``cache_path`` and appends what it lacks, so a second run encodes nothing. An
    entry that two runs appended counts once. Null and empty texts have 0 bytes and 0 tokens; texts of
    any length are encoded whole. Repeated rows give repeated results, but a text held by many
    documents is encoded once. Other columns play no part, an empty table gives an empty result.
    ``tokenizer_path`` must exist on every executor.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def stored() -> DataFrame:
        return read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = [d not in seen and not seen.add(d) for d in batch.column("digest").to_pylist()]
            yield batch.filter(pa.array(new, pa.bool_()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in once_per_task(batches):
            counts = [n for at in range(0, len(batch), 256) for n in count(batch.column("text").slice(at, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(batch), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    # A task sends each text once at most, so that a copy group of any size stays a row per task.
    offered = rows.select("digest", "text").mapInArrow(once_per_task, "digest binary, text string").repartition("digest")
    missed = offered.join(stored().hint("shuffle_hash"), "digest", "left_anti").select("digest", "text")
    missed.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    sizes = staged(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    held = staged(sizes.groupBy("digest").agg(F.count("*").alias("n")).join(stored(), "digest"))
    total = held.agg(F.sum("n")).first()[0] or 0
    return join_by_key(sizes, held, "digest", "n", total).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
