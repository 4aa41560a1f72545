"""Corpus pipeline: quality, line dedup, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents, whatever other columns there are and whatever they are called. A
stage's docs are files that have been written and are read again, so they are the same whenever they
are computed. Nulls: a null text is scored as an empty one, is left alone by the line and substring
stages, is one group with other texts without words for near-duplicates, and is packed as its end
token; a null doc_id comes last. Repeated rows are rows like any others, so near_dedup keeps one of
them. Texts of any length are read whole. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import lines, packing, quality, simhash, substrings
from ledgerlake.llm.common import bounded_batches, fresh, read_table, staged

ACCEPT = 0.7


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more)."""
    model = quality.fit_quality_model(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "score")
    return quality.with_quality(docs, model, score).where(F.col(score) >= ACCEPT).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go but for their first occurrence; documents left without text go too."""
    bounded_batches(spark)
    kept = lines.dedup_lines(docs, stable=True)
    return kept.where(F.col("text").isNull() | (F.col("text") != ""))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8)."""
    bounded_batches(spark)
    return simhash.keep_one_of_each_group(docs, shingle=5, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start anywhere else are cut out; documents left without text go."""
    bounded_batches(spark)
    kept = substrings.drop_repeats_from_texts(docs, window=50, stable=True)
    return kept.where(F.col("text").isNull() | (F.col("text") != ""))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096; every document's tokens and an end token."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


STAGES = [("quality", accept_quality), ("line_dedup", dedup_lines), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages), ("packing", pack)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
