"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Each task explodes its documents into pre-tokens and notes, for a chunk of documents, the distinct
words and at which positions they stand (as an array). The words are shuffled by hash, so that each
distinct word of the whole corpus meets itself and is encoded once; its ids are joined back to the
chunks, and every document is reassembled by position. For decoding, the ids join the token-byte
table. What is shuffled is a chunk's distinct words, in compressed blocks, not its text.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) * buckets >> 32


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, with matches over the whole length (copies of documents)."""
    wide = zstandard.ZstdCompressionParameters.from_level(6, enable_ldm=True, window_log=25)
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(compression_params=wide).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").reshape(-1)


def _packed_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(9).compress(sizes.tobytes() + b"".join(words))


def _unpacked_words(raw: bytes, n: int) -> list[bytes]:
    flat = zstandard.ZstdDecompressor().decompress(raw)
    ends = (np.cumsum(np.frombuffer(flat, np.uint32, n)) + 4 * n).tolist()
    return [flat[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


def pretoken_chunks(docs: DataFrame, pattern: str, chunk_bytes: int, buckets: int) -> DataFrame:
    """Chunks of documents and, for each, its distinct words by bucket of the hash space.

    A row without a bucket is a chunk: doc_ids, lengths (pre-tokens of each document), ``places``, for
    every pre-token in order the number of its word, and in ``words`` the bucket of each number. A row
    with a bucket holds its ``n`` distinct words, in the order of their numbers.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "bucket", "doc_ids", "lengths", "places", "n", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, made = regex.compile(pattern).findall, 0
        part = TaskContext.get().partitionId()
        ids: list = []
        lengths: list[int] = []
        places: list[np.ndarray] = []
        words: dict[str, int] = {}
        size, kind = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = (part << 32) + made
            flat = np.concatenate([np.zeros(0, np.uint32), *places])
            places.clear()
            listed = [w.encode("utf-8", "surrogatepass") for w in words]
            # words are numbered by how often they stand in the chunk, which packs the places best
            order = np.argsort(-np.bincount(flat, minlength=len(listed)), kind="stable")
            rank = np.empty(len(listed), np.uint32)
            rank[order] = np.arange(len(listed), dtype=np.uint32)
            of = np.fromiter((_bucket(listed[k], buckets) for k in order.tolist()), np.uint32, len(listed))
            groups = [(b, [listed[order[k]] for k in np.flatnonzero(of == b).tolist()]) for b in np.unique(of).tolist()]
            flat = rank[flat]
            rows = [(chunk, None, ids, lengths, _packed(flat), len(listed), _packed(of))]
            rows += [(chunk, b, None, None, None, len(own), _packed_words(own)) for b, own in groups]
            kinds = (pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                found = find(text)
                ids.append(ident)
                lengths.append(len(found))
                places.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found)))
                size += len(text.encode("utf-8", "surrogatepass"))
                if size >= chunk_bytes:
                    yield from flush()
                    ids, lengths, places, words, size, made = [], [], [], {}, 0, made + 1
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(cut, f"chunk long, bucket long, doc_ids array<{id_type}>, lengths array<long>, places binary, n long, words binary")


def encode_words(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Each distinct word of a bucket is encoded once, as one piece; every chunk gets the ids of its own.

    Returns of_chunk, bucket, n, sizes (ids of each word) and ids. A word costs a bucket one entry
    per chunk that holds it, however often it stands there.
    """

    def encode(blocks: pa.Table) -> pa.Table:
        piece, known, out = _encoding(ranks_path, pattern)._encode_single_piece, {}, []
        for chunk, bucket, n, raw in zip(*(blocks.column(c).to_pylist() for c in ("chunk", "bucket", "n", "words")), strict=True):
            got = []
            for w in _unpacked_words(raw, n):
                ids = known.get(w)
                if ids is None:
                    known[w] = ids = array("I", piece(w))
                got.append(ids)
            sizes = np.fromiter(map(len, got), np.uint32, n)
            out.append((chunk, bucket, n, _packed(sizes), _packed(np.frombuffer(b"".join(got), "<u4"))))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("of_chunk", "bucket", "n", "sizes", "ids"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    return words.groupBy("bucket").applyInArrow(encode, "of_chunk long, bucket long, n long, sizes binary, ids binary")


@lru_cache(maxsize=2)
def token_table(ranks_path: str) -> list[bytes]:
    """The token-byte table by id: as many rows as the tokenizer has ranks, whatever the corpus."""
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token
    return table


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, chunk_bytes: int = 35_000_000, bucket_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, n_tokens, ids (uint32 little-endian binary), decoded (binary), one row per document.

    Null and empty texts have no ids and decode to nothing; texts of any length are encoded whole.
    Repeated rows give repeated results, equal texts equal ones; other columns play no part, and an
    empty table gives an empty result. There is a bucket of words for every ``bucket_bytes`` of text,
    so that a bucket, which one task holds, does not grow with the corpus.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(min(shuffles, 1 + total // 1_000_000), -(-total // bucket_bytes)))
    rows = staged(pretoken_chunks(docs, pattern, chunk_bytes, buckets))
    back = encode_words(rows.where("bucket IS NOT NULL").select("chunk", "bucket", "n", "words"), ranks_path, pattern)
    chunks = rows.where("bucket IS NULL").select("chunk", "doc_ids", "lengths", "places", "words")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def reassemble(chunk: pa.Table, words: pa.Table) -> pa.Table:
        kind = chunk.schema.field("doc_ids").type.value_type
        out_ids, out_text, counts, held, parts, filled = [], [], [], [], [], 0
        names = ("doc_id", "n_tokens", "ids", "decoded")

        def part(ids: list) -> pa.Table:
            return pa.table(dict(zip(names, (pa.array(ids, kind), pa.array(counts, pa.int64()), pa.array(out_ids, pa.binary()), pa.array(out_text, pa.binary())), strict=True)))

        if chunk.num_rows:
            table = token_table(ranks_path)
            words = words.sort_by("bucket")
            sizes = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(x) for x in words.column("sizes").to_pylist())]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, "<u4"), *(_unpacked(x) for x in words.column("ids").to_pylist())])
            starts = np.cumsum(sizes) - sizes
            listed = np.argsort(_unpacked(chunk.column("words")[0].as_py()), kind="stable")  # numbers, bucket by bucket
            number = np.empty(len(listed), np.int64)
            number[listed] = np.arange(len(listed))
            # the token-byte table joins the ids of each distinct word of the chunk, once
            tokens = [table[k] for k in flat.tolist()]
            spelling = [b"".join(tokens[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            place = number.astype(np.uint32)[_unpacked(chunk.column("places")[0].as_py())]
            held, at = chunk.column("doc_ids")[0].as_py(), 0
            for n in chunk.column("lengths")[0].as_py():
                own = place[at : at + n]
                at += n
                size = sizes[own]
                ends = np.cumsum(size)
                total = int(ends[-1]) if n else 0
                out_ids.append(flat[np.arange(total) + np.repeat(starts[own] - (ends - size), size)].tobytes())
                out_text.append(b"".join([spelling[k] for k in own.tolist()]))
                counts.append(total)
                filled += len(out_ids[-1]) + len(out_text[-1])
                if filled > 16_000_000:  # batches of this size leave little to hold at once; a binary array ends at 2 GB
                    parts.append(part(held[: len(counts)]))
                    held, out_ids, out_text, counts, filled = held[len(counts) :], [], [], [], 0
        return pa.concat_tables([*parts, part(held)])

    return chunks.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(reassemble, f"doc_id {id_type}, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """The operator's output as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
