"""Line dedup by content-defined line chunks.

A text's lines are hashed, and a hash of the last two of these hashes rolls over them: the new line comes in,
the one before the last goes out. Each of a few bits of the rolling hash makes one chunking of the text: where
the bit is zero, a chunk ends. So an inserted line moves the boundaries near it only, and a passage whose end
one chunking cuts away with its surroundings is cut at its end by another. Chunks of two lines or more that
occur more than once in the corpus are removed but for their first occurrence, after their bytes have been
compared. Single lines are never removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from ledgerlake.llm.common import text_chunks
from ledgerlake.llm.rounds import answer, ask, ask_again, finish, mask_bytes, masks_of, packed, unpacked
from ledgerlake.llm.substrings import _ordered

_MASK = (1 << 64) - 1
_LAST = np.iinfo(np.int64).max
#: Chunkings of every text, and the distance of their bits in the rolling hash.
CHUNKINGS, _APART = 6, 7


def rolling_hashes(lines: list[bytes]) -> list[int]:
    """For every line, a hash of it and the line before: hashes are rotated as they age, and leave by exclusive or."""
    hashes = [xxhash.xxh64_intdigest(line, 7) for line in lines]
    out, rolling = [], 0
    for k, h in enumerate(hashes):
        rolling = _rotated(rolling, 1) ^ h ^ (_rotated(hashes[k - 2], 2) if k > 1 else 0)
        out.append(rolling)
    return out


def _rotated(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & _MASK


def line_chunks(lines: list[bytes], chunkings: int = CHUNKINGS) -> list[tuple[int, int]]:
    """(first line, line after the last) of every chunk of two lines or more of a whole text, by all chunkings together, in order.

    A chunk ends after a line whose rolling hash has a zero in the chunking's bit, once it holds two lines,
    and at the end of the text. Chunks hold about three lines; two copies of a passage are cut alike but
    for their ends.
    """
    rolling, last = rolling_hashes(lines), len(lines) - 1
    out = set()
    for bit in range(chunkings):
        first = 0
        for k, r in enumerate(rolling):
            if k > first and (k == last or not r >> (_APART * bit) & 1):
                out.add((first, k + 1))
                first = k + 1
    return sorted(out)


def _pieces(t: pa.Table) -> list[tuple[int, int, int, bytes]]:
    """(row, first line, line after, bytes) of the chunks, in order."""
    out = []
    for row, text in enumerate(t.column("text").to_pylist()):
        if text is None or "\n" not in text:
            continue
        lines = text.encode("utf-8", "replace").split(b"\n")
        out += [(row, a, b, b"\n".join(lines[a:b])) for a, b in line_chunks(lines)]
    return out


def _bucket(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:8], "big") * buckets >> 64


def dedup_lines(docs: DataFrame, chunk_bytes: int = 10_000_000, counts: str | None = None, stable: bool = False) -> DataFrame:
    """All columns of ``docs``, the text without repeated multi-line chunks; ``n_chars`` follows where it exists.

    The first occurrence stays: the smallest doc_id (null ids last; ids are integers), then the
    position; what overlaps it in the same text is no repeat. Every line that goes is in a chunk that stays
    in an earlier place. Rows that agree in doc_id and text share their chunks like any rows: one of them
    keeps the chunk, the others lose it. Null and empty texts stay as they are; a text of any length is cut
    whole. ``counts`` names a column for the number of lines removed; a column of that name is
    replaced, other columns of any name stay. An empty table stays empty. ``stable``: see ``text_chunks``.
    """
    if counts:
        docs = docs.select(*[c for c in docs.columns if c.lower() != counts.lower()])
    dealt, chunk, total = text_chunks(docs, "text", chunk_bytes, stable)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(min(shuffles, 1 + total // 50_000), -(-total // 200_000_000)))
    names, at = docs.columns, docs.columns.index("text")
    id_at = names.index("doc_id")

    def first_ids(t: pa.Table, pieces: list) -> dict[bytes, tuple[int, int]]:
        """bytes -> (doc_id of the first occurrence here, occurrences)"""
        ids = [_LAST if x is None else x for x in t.column(id_at).to_pylist()]
        out: dict[bytes, tuple[int, int]] = {}
        for row, _, _, raw in pieces:
            ident, n = out.get(raw, (ids[row], 0))
            out[raw] = (min(ident, ids[row]), n + 1)
        return out

    def keyed(found: dict[bytes, tuple[int, int]]) -> dict[int, list[tuple[bytes, bytes]]]:
        """bucket -> sorted (digest, bytes)"""
        out: dict[int, list[tuple[bytes, bytes]]] = {}
        for raw in found:
            digest = xxhash.xxh3_128_digest(raw)
            out.setdefault(_bucket(digest, buckets), []).append((digest, raw))
        return {b: sorted(x) for b, x in out.items()}

    def ordered(t: pa.Table) -> pa.Table:
        return _ordered(t, "text", "doc_id").select(names)

    def first(t: pa.Table, chunk_id: int) -> list[tuple]:
        t = ordered(t)
        found = first_ids(t, _pieces(t))
        return [(b, chunk_id, len(x), b"".join(d for d, _ in x), mask_bytes(np.array([found[r][1] > 1 for _, r in x]))) for b, x in keyed(found).items()]

    def judge_hashes(blocks: pa.Table) -> list[tuple]:
        kind = np.dtype([("a", "<u8"), ("b", "<u8")])
        parts = [np.frombuffer(k, kind) for k in blocks.column("keys").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(e, np.uint8))[: len(p)] for p, e in zip(parts, blocks.column("extra").to_pylist(), strict=True)]
        _, where = np.unique(np.concatenate(parts), return_inverse=True)
        repeated = np.bincount(where, weights=1 + np.concatenate(twice).astype(np.int64))[where] > 1
        ends = np.cumsum([len(p) for p in parts])
        return [(b, c, mask_bytes(repeated[e - len(p) : e])) for b, c, p, e in zip(blocks.column("bucket").to_pylist(), blocks.column("chunk").to_pylist(), parts, ends, strict=True)]

    def suspects(found: dict, answers: pa.Table) -> dict[int, list[tuple[bytes, bytes]]]:
        masks = masks_of(answers)
        return {b: left for b, x in keyed(found).items() if (left := [p for p, hit in zip(x, masks[b], strict=False) if hit])}

    def second(t: pa.Table, chunk_id: int, answers: pa.Table) -> list[tuple]:
        t = ordered(t)
        found = first_ids(t, _pieces(t))
        out = []
        for b, x in suspects(found, answers).items():
            numbers = np.array([len(r) for _, r in x] + [found[r][0] for _, r in x], np.int64)
            out.append((b, chunk_id, len(x), zstandard.ZstdCompressor(level=3).compress(b"".join(r for _, r in x)), packed(numbers)))
        return out

    def judge_bytes(blocks: pa.Table) -> list[tuple]:
        """True for the chunk of documents that holds the first occurrence of exactly these bytes."""
        best: dict[bytes, tuple[int, int]] = {}
        parts = []
        for c, n, raw, extra in zip(*(blocks.column(k).to_pylist() for k in ("chunk", "n", "keys", "extra")), strict=True):
            flat, numbers = zstandard.ZstdDecompressor().decompress(raw), unpacked(extra, np.int64)
            ends = np.cumsum(numbers[:n]).tolist()
            pieces = [flat[e - size : e] for e, size in zip(ends, numbers[:n].tolist(), strict=True)]
            parts.append((pieces, numbers[n:].tolist(), c))
            for piece, ident in zip(pieces, numbers[n:].tolist(), strict=True):
                best[piece] = min(best.get(piece, (ident, c)), (ident, c))
        return [(b, c, mask_bytes(np.array([best[p] == (i, c) for p, i in zip(pieces, ids, strict=True)]))) for b, (pieces, ids, c) in zip(blocks.column("bucket").to_pylist(), parts, strict=True)]

    def final(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = ordered(t) if t.num_rows else t.select(names)
        pieces = _pieces(t)
        found = first_ids(t, pieces)
        bucket = answers.column("bucket").to_numpy()
        masks = masks_of(answers.filter(pa.array(bucket < 0)))
        owns: dict[bytes, bool] = {}
        for b, x in suspects(found, answers.filter(pa.array(bucket >= 0))).items() if t.num_rows else ():
            owns |= {raw: bool(hit) for (_, raw), hit in zip(x, masks[-1 - b], strict=False)}
        drop: dict[int, list[tuple[int, int]]] = {}
        stays: dict[bytes, tuple[int, int]] = {}
        for row, a, b, raw in pieces:
            if raw in owns:
                if owns[raw]:
                    owns[raw] = False  # the first occurrence stays, those after it go
                    stays[raw] = (row, b)
                elif (row, a) >= stays.get(raw, (row, a)):  # what overlaps it is a part of it
                    drop.setdefault(row, []).append((a, b))
        texts, removed = t.column(at).to_pylist(), [0] * t.num_rows
        sizes = t.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
        for row, spans in drop.items():
            lines, gone = texts[row].split("\n"), {k for a, b in spans for k in range(a, b)}
            texts[row] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            removed[row] = len(gone)
            if sizes:
                sizes[row] = len(texts[row])
        t = t.set_column(at, t.schema.field(at), pa.array(texts, t.schema.field(at).type))
        if sizes is not None:
            k = names.index("n_chars")
            t = t.set_column(k, t.schema.field(k), pa.array(sizes, t.schema.field(k).type))
        return t.append_column(counts, pa.array(removed, pa.int64())) if counts else t

    same_hash = answer(ask(dealt, chunk, first), judge_hashes)
    same_bytes = answer(ask_again(dealt, chunk, same_hash, second), judge_bytes)
    both = same_hash.unionByName(same_bytes.selectExpr("-1 - bucket AS bucket", "chunk", "mask"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return finish(dealt, chunk, both, final, schema + (f", `{counts}` bigint" if counts else ""))
