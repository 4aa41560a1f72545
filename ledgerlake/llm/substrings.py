"""Substring dedup by a count-min prefilter and an exact second pass.

A window is ``window`` consecutive words. First pass: every chunk of documents is a partial sketch,
the cells of its windows in a few rows of counters; the partial sketches are merged cell by cell (in
buckets of the cell space, as a shuffle), and overestimate how often a window starts anywhere. Second
pass: only windows estimated repeated, in every row of the sketch, are grouped exactly, by 128-bit
hashes of their word sequences. An estimate is never too low, so no repeated window is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ledgerlake.llm.common import text_chunks
from ledgerlake.llm.rounds import answer, ask, ask_again, finish, mask_bytes, masks_of, packed, unpacked

_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text as UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            one = np.ones(1, np.uint64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([one, np.full(2 * n, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASE)


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """A 128-bit hash (as a pair) of each window's word sequence, from 128-bit hashes of the words."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, _PAIR)
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    out = np.empty(n, _PAIR)
    for k, name in enumerate(("a", "b")):
        up, down = _POWERS[k].get(len(words))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(halves[:, k] * up, dtype=np.uint64)])
        total = (prefix[window:] - prefix[:n]) * down[:n]
        total ^= total >> np.uint64(31)
        out[name] = total * np.uint64(0xFF51AFD7ED558CCD)
    return out


def _ordered(docs: pa.Table, text: str, ident: str) -> pa.Table:
    """Rows in an order that is the same whenever the chunk is built again, for any row order that arrives."""
    texts = docs.column(text).to_pylist()
    ids = docs.column(ident).to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, texts[k] or ""))
    return docs.take(pa.array(order, pa.int64()))


class _Sketch:
    def __init__(self, rows: int, cells_bits: int, buckets: int):
        self.rows, self.bits, self.buckets = rows, cells_bits, buckets

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        mixed = hashes["a"] if row == 0 else (hashes["b"] ^ (hashes["a"] >> np.uint64(row))) * np.uint64(_BASE[row % 2] | 1)
        return mixed >> np.uint64(64 - self.bits)

    def spans(self, row: int) -> np.ndarray:
        """Cell bounds of the buckets."""
        return (np.arange(self.buckets + 1) * ((1 << self.bits) / self.buckets)).astype(np.uint64)

    def blocks(self, hashes: np.ndarray):
        """(bucket, distinct sorted cells, whether the chunk holds a second window there) for all rows and buckets."""
        for row in range(self.rows):
            cells, counts = np.unique(self.cells(hashes, row), return_counts=True)
            cuts = np.searchsorted(cells, self.spans(row))
            for k in range(self.buckets):
                if cuts[k] < cuts[k + 1]:
                    part = slice(cuts[k], cuts[k + 1])
                    yield row * self.buckets + k, cells[part], counts[part] > 1


def _merge_cells(blocks: pa.Table) -> list[tuple]:
    """Answers for one bucket: which cells count two windows or more."""
    parts = []
    for raw, extra in zip(blocks.column("keys").to_pylist(), blocks.column("extra").to_pylist(), strict=True):
        cells = np.cumsum(unpacked(raw, np.uint32), dtype=np.uint64)  # relative to the block's first
        parts.append((cells + np.frombuffer(extra[:8], np.uint64)[0], np.unpackbits(np.frombuffer(extra[8:], np.uint8))[: len(cells)].astype(bool)))
    low = min(int(c[0]) for c, _ in parts)
    high = max(int(c[-1]) for c, _ in parts)
    seen = np.zeros(high - low + 1, np.uint8)  # counters that stop at two
    for cells, twice in parts:
        at = (cells - np.uint64(low)).astype(np.int64)
        seen[at] = np.minimum(seen[at] + 1 + twice, 2)
    return [(b, c, mask_bytes(seen[(cells - np.uint64(low)).astype(np.int64)] > 1)) for b, c, (cells, _) in zip(blocks.column("bucket").to_pylist(), blocks.column("chunk").to_pylist(), parts, strict=True)]


def _merge_hashes(blocks: pa.Table) -> list[tuple]:
    """Answers for one bucket: which windows start twice or more."""
    parts = [(unpacked(raw, np.uint64).reshape(2, -1), np.unpackbits(np.frombuffer(extra, np.uint8))) for raw, extra in zip(blocks.column("keys").to_pylist(), blocks.column("extra").to_pylist(), strict=True)]
    a, b = (np.concatenate([p[0][k] for p in parts]) for k in (0, 1))
    weight = np.concatenate([1 + e[: p.shape[1]].astype(np.int64) for p, e in parts])
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    group = np.cumsum(new) - 1
    repeated = np.empty(len(a), bool)
    repeated[order] = np.bincount(group, weights=weight[order])[group] > 1
    out, at = [], 0
    for bucket, chunk, (p, _) in zip(blocks.column("bucket").to_pylist(), blocks.column("chunk").to_pylist(), parts, strict=True):
        out.append((bucket, chunk, mask_bytes(repeated[at : at + p.shape[1]])))
        at += p.shape[1]
    return out


def repeated_spans(docs: DataFrame, window: int, make, schema, text: str = "text", ident: str = "doc_id", chunk_bytes: int = 8_000_000, depth: int = 2, cells_per_window: int = 4, stable: bool = False) -> DataFrame:
    """Run both passes and hand every chunk's rows, in order, with a covered mask per row, to ``make``.

    ``make(rows, covered)`` returns the output table of a chunk in ``schema``; a mask has a place for
    each word of its row. Words are split again where they are needed, so that a chunk never holds
    them all at once. ``stable``: see ``text_chunks``.
    """
    dealt, chunk, total = text_chunks(docs, text, chunk_bytes, stable)
    windows = max(1, total // 5)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(min(shuffles, 1 + windows // 1000), -(-windows // 4_000_000)))
    bits = int(np.clip(np.ceil(np.log2(windows * cells_per_window)), 12, 62))
    while (1 << bits) // buckets >= 1 << 32:
        buckets *= 2
    sketch = _Sketch(depth, bits, buckets)

    def parsed(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Rows in order, the words of each, and all windows' hashes, row after row."""
        t = _ordered(t, text, ident)
        counts, hashes = [], [np.zeros(0, _PAIR)]
        for x in t.column(text):
            w = words_of(x.as_py())
            counts.append(len(w))
            hashes.append(window_hashes(w, window))
        return t, np.array(counts, np.int64), np.concatenate(hashes)

    def first(t: pa.Table, at: int) -> list[tuple]:
        out = []
        for bucket, cells, twice in sketch.blocks(parsed(t)[2]):
            steps = np.diff(cells, prepend=cells[:1]).astype(np.uint32)
            out.append((bucket, at, len(cells), packed(steps), np.uint64(cells[0]).tobytes() + mask_bytes(twice)))
        return out

    def suspects(hashes: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Positions of the windows that every row of the merged sketch estimates repeated."""
        masks, keep = masks_of(answers), np.ones(len(hashes), bool)
        for row in range(depth):
            distinct, inverse = np.unique(sketch.cells(hashes, row), return_inverse=True)
            flagged = np.zeros(len(distinct), bool)
            cuts = np.searchsorted(distinct, sketch.spans(row))
            for k in range(buckets):
                if cuts[k] < cuts[k + 1]:
                    flagged[cuts[k] : cuts[k + 1]] = masks[row * buckets + k][: cuts[k + 1] - cuts[k]]
            keep &= flagged[inverse]
        return np.flatnonzero(keep)

    def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the hashes, where a new one begins in it, and the bounds of the buckets among the distinct ones."""
        order = np.lexsort((hashes["b"], hashes["a"]))
        a, b = hashes["a"][order], hashes["b"][order]
        firsts = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        cuts = np.searchsorted(a[firsts], (np.arange(1, buckets) * (2.0**64 / buckets)).astype(np.uint64))
        return order, firsts, np.concatenate([[0], cuts, [len(firsts)]])

    def second(t: pa.Table, at: int, answers: pa.Table) -> list[tuple]:
        hashes = parsed(t)[2]
        left = hashes[suspects(hashes, answers)]
        order, firsts, cuts = grouped(left)
        distinct, twice = left[order[firsts]], np.diff(np.append(firsts, len(left))) > 1
        return [(k, at, int(n - m), packed(np.concatenate([distinct["a"][m:n], distinct["b"][m:n]])), mask_bytes(twice[m:n])) for k, (m, n) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if m < n]

    def final(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return make(t, [])
        t, counts, hashes = parsed(t)
        bucket = answers.column("bucket").to_numpy()
        left = suspects(hashes, answers.filter(pa.array(bucket >= 0)))
        order, firsts, cuts = grouped(hashes[left])
        masks, repeated = masks_of(answers.filter(pa.array(bucket < 0))), np.zeros(len(firsts), bool)
        for k, (m, n) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if m < n:
                repeated[m:n] = masks[-1 - k][: n - m]
        hit = np.zeros(len(hashes), bool)
        hit[left[order]] = np.repeat(repeated, np.diff(np.append(firsts, len(left))))
        covered, at = [], 0
        for n in counts.tolist():
            starts = np.flatnonzero(hit[at : at + max(0, n - window + 1)])
            at += max(0, n - window + 1)
            edge = np.zeros(n + 1, np.int32)
            edge[starts] += 1
            edge[starts + window] -= 1
            covered.append(np.cumsum(edge[:-1]) > 0)
        return make(t, covered)

    cells = answer(ask(dealt, chunk, first), _merge_cells)
    exact = answer(ask_again(dealt, chunk, cells, second), _merge_hashes)
    both = cells.unionByName(exact.selectExpr("-1 - bucket AS bucket", "chunk", "mask"))
    return finish(dealt, chunk, both, final, schema)


def remove_repeats(docs: DataFrame, window: int = 35, stable: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), one row per document.

    Every word covered by a window whose word sequence also starts anywhere else, in the same
    document or another, is removed; windows are judged on the input. Null and empty texts have no
    words; texts shorter than a window keep all. Repeated rows repeat each other's windows. Texts of
    any length are read whole, an empty table gives an empty result, other columns play no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(t: pa.Table, covered: list) -> pa.Table:
        kept = []
        for x, m in zip(t.column("text"), covered, strict=True):
            w = words_of(x.as_py())
            kept.append(b" ".join([x for x, c in zip(w, m.tolist(), strict=True) if not c] if m.any() else w).decode("utf-8", "replace"))
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array([len(m) for m in covered], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in covered], pa.int64()), "kept": pa.array(kept, pa.string())})

    return repeated_spans(docs.select("doc_id", "text"), window, make, f"doc_id {kind}, n_words long, n_removed long, kept string", stable=stable)


def drop_repeats_from_texts(docs: DataFrame, window: int = 35, stable: bool = False) -> DataFrame:
    """The documents with their repeated spans cut out of ``text``; ``n_chars`` follows where it exists.

    What is kept stays as it stands, white space included, up to the removed words. Null texts stay
    null; columns of any other name stay as they are; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index("text")

    def make(t: pa.Table, covered: list) -> pa.Table:
        t = t.select(names)
        texts = t.column("text").to_pylist()
        out = [x if x is None or not m.any() else _cut(x, words_of(x), m) for x, m in zip(texts, covered, strict=True)]
        t = t.set_column(at, t.schema.field(at), pa.array(out, t.schema.field(at).type))
        if "n_chars" in names and covered:
            k = names.index("n_chars")
            old = t.column(k).to_pylist()
            t = t.set_column(k, t.schema.field(k), pa.array([len(x) if m.any() else n for x, m, n in zip(out, covered, old, strict=True)], t.schema.field(k).type))
        return t

    return repeated_spans(docs, window, make, docs.schema, stable=stable)


def _cut(text: str, words: list[bytes], covered: np.ndarray) -> str:
    """The text without the covered words and the white space that follows each."""
    raw, out, at, keep_from = text.encode("utf-8", "replace"), [], 0, 0
    for word, drop in zip(words, covered.tolist(), strict=True):
        start = raw.index(word, at)
        if drop:
            out.append(raw[keep_from:start])
            at = keep_from = start + len(word)
            while keep_from < len(raw) and raw[keep_from : keep_from + 1].isspace():
                keep_from += 1
            at = keep_from
        else:
            at = start + len(word)
    out.append(raw[keep_from:])
    return b"".join(out).decode("utf-8", "replace").rstrip()
