"""Asking across the corpus about hashes, without moving texts or gathering occurrences.

Documents are dealt into chunks. A chunk sends each of its distinct hashes once, whatever their number
of occurrences there, in sorted blocks, one per bucket of the hash space. A bucket sees all blocks of
its hashes and answers each block with a mask. The chunk, which can build its blocks again, reads the
masks. A hash that a third of all documents hold costs one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

ASKS = "bucket long, chunk long, n long, keys binary, extra binary"
ANSWERS = "bucket long, chunk long, mask binary"


def packed(a: np.ndarray) -> bytes:
    """Bytes of an integer array, its byte planes apart (they compress better)."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def asks_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "chunk", "n", "keys", "extra"), columns, kinds, strict=True)})


def answers_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "chunk", "mask"), columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)})


def masks_of(answers: pa.Table) -> dict[int, np.ndarray]:
    """bucket -> one boolean for each key of the block, in its order (padding at the end)."""
    return {b: np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool) for b, m in zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist(), strict=True)}


def mask_bytes(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def answer(asks: DataFrame, judge: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Every bucket's blocks to ``judge``, which returns (bucket, chunk, mask) rows."""
    return asks.groupBy("bucket").applyInArrow(lambda t: answers_table(judge(t)), ANSWERS)


def ask(docs: DataFrame, chunk: str, make: Callable[[pa.Table, int], list[tuple]]) -> DataFrame:
    return docs.groupBy(chunk).applyInArrow(lambda key, t: asks_table(make(t, key[0].as_py())), ASKS)


def ask_again(docs: DataFrame, chunk: str, answers: DataFrame, make: Callable[[pa.Table, int, pa.Table], list[tuple]]) -> DataFrame:
    """The second question of a chunk that has read its first answers."""
    return docs.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, t, a: asks_table(make(t, key[0].as_py(), a) if t.num_rows else []), ASKS)


def finish(docs: DataFrame, chunk: str, answers: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    return docs.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(make, schema)


