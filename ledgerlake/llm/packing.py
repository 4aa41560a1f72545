"""Bounded-space online packing of tokenised documents into sequences of fixed length.

Each partition keeps a fixed number of open windows. A document's full windows are closed at once;
its remainder goes into the open window where it fits best. When none fits, the fullest is topped up
with the document's head if the gap is worth a cut, and emitted. What is open at the end of the
partitions is merged: groups of partitions fill their leftovers into full sequences.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged

#: str.split() also splits at these four, which the tokenizer's white space does not hold.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
MERGED = 1 << 62


class PieceTable:
    """A word-end BPE vocabulary as byte ranks, for a fast merge loop.

    A pre-token is its bytes and an end byte 0xFF (never part of UTF-8), which the first ranks merge
    into the last byte; then the merges follow in their order. Merging by the joined bytes equals
    merging by listed pairs as long as every token encodes to itself: whatever stands in a token's
    span has merged as it would alone, so its last two parts are the listed pair. Tokens that do not
    encode to themselves can never arise, and are left out.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = {c: bytes([b]) for b, c in _byte_letters().items()}
        spell = lambda token: b"".join(letters[c] for c in token.removesuffix("</w>")) + b"\xff" * token.endswith("</w>")
        self.by_bytes = {spell(t): i for t, i in vocab.items() if set(t.removesuffix("</w>")) <= letters.keys()}
        ranks = {bytes([b]) + b"\xff": b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        pairs = {}
        for k, merge in enumerate(model["merges"]):
            left, right = map(spell, merge.split(" ") if isinstance(merge, str) else merge)
            pairs.setdefault((left, right), k)
        for (left, right), k in sorted(pairs.items(), key=lambda x: x[1]):
            if self._alone(left + right, pairs) == 1:
                ranks.setdefault(left + right, 512 + k)
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.ids = {r: self.by_bytes[t] for t, r in ranks.items() if t in self.by_bytes}

    @staticmethod
    def _alone(token: bytes, pairs: dict) -> int:
        """How many parts a token's bytes merge into by the listed pairs."""
        body = token.removesuffix(b"\xff")
        parts = [bytes([b]) for b in body]
        if token != body:
            parts[-1] += b"\xff"
        while len(parts) > 1:
            k, at = min((pairs.get(p, len(pairs)), at) for at, p in enumerate(zip(parts, parts[1:], strict=False)))
            if k == len(pairs):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes that byte-level vocabularies are written with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text by a tokenizer whose pre-tokens never span white space, through a cache of words.

    The cache stops growing at ``most_words``; frequent words come early, rare ones are encoded again.
    Words in Latin letters go through the piece table, all others through the tokenizer itself. That
    holds for tokenizers built as ``_BUILT``, with special strings that begin with ``<|`` and hold no
    white space; texts go through any other tokenizer as they are.
    """

    #: Composed, white space collapsed, lower case; split by a pattern, bytes as letters; BPE with a word end.
    _BUILT = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", "</w>")

    def __init__(self, path: str, most_words: int = 400_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cache = Tokenizer.from_file(path), most_words, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_words = self._is_built(told)
        if self.by_words:
            self.find = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            self.pieces = PieceTable(path)

    def _is_built(self, told: dict) -> bool:
        steps, cuts, model = ((told.get(k) or {}) for k in ("normalizer", "pre_tokenizer", "model"))
        normal, cut = steps.get("normalizers", []), cuts.get("pretokenizers", [])
        built = ([x["type"] for x in normal], [x["type"] for x in cut], model.get("type"), model.get("end_of_word_suffix"))
        if built != self._BUILT or told.get("post_processor") is not None:
            return False
        spaces = normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        split = cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        return bool(spaces and split and all(x["content"].startswith("<|") and not any(map(str.isspace, x["content"])) for x in told["added_tokens"]))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        out, find, merge, ids = {}, self.find, self.pieces.encoding._encode_single_piece, self.pieces.ids
        for w in words:
            if max(w) >= "\u0250" or "<|" in w:
                out[w] = self._ids(w)
            else:
                found: list[int] = []
                for piece in find(w.lower()):
                    found += [ids[r] for r in merge(piece.encode() + b"\xff")]
                out[w] = struct.pack(f"<{len(found)}I", *found)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [self._ids(t) for t in texts]
        plain = [unicodedata.is_normalized("NFC", t) and not _SEPARATORS.search(t) for t in texts]
        words = [t.split() if ok else [] for t, ok in zip(texts, plain, strict=True)]
        known = self.cache
        learnt = self._learn(set().union(*words) - known.keys())
        if len(known) + len(learnt) <= self.most:
            known.update(learnt)
            get = known.__getitem__
        else:
            get = lambda w: known.get(w) or learnt[w]
        return [b"".join(map(get, ws)) if ok else self._ids(t) for t, ws, ok in zip(texts, words, plain, strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, least_cut: int, first_id: int):
        self.length, self.windows, self.least_cut, self.next_id = length, windows, least_cut, first_id
        self.open: list[list] = []  # [free, pieces]

    def _close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for ident, start, ids, total in pieces:
            yield ident, start, ids, total, self.next_id, at
            at += len(ids) // 4
        self.next_id += 1

    def add(self, ident, ids: bytes, total: int, start: int = 0) -> Iterator[tuple]:
        wide = 4 * self.length
        for at in range(0, len(ids) - wide + 1, wide):
            yield from self._close([(ident, start + at // 4, ids[at : at + wide], total)])
        rest = ids[len(ids) - len(ids) % wide :]
        start += (len(ids) - len(rest)) // 4
        size = len(rest) // 4
        if not size:
            return
        fits = [w for w in self.open if w[0] >= size]
        if not fits and len(self.open) >= self.windows:
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if full[0] >= self.least_cut:
                full[1].append((ident, start, rest[: 4 * full[0]], total))
                rest, start, size = rest[4 * full[0] :], start + full[0], size - full[0]
            yield from self._close(full[1])
            fits = [w for w in self.open if w[0] >= size]
        if fits:
            best = min(fits, key=lambda w: w[0])
        else:
            self.open.append(best := [self.length, []])
        best[0] -= size
        best[1].append((ident, start, rest, total))
        if not best[0]:
            self.open.remove(best)
            yield from self._close(best[1])


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, windows: int = 32, least_cut: int = 48, merge_partitions: int = 16, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is the ids of its text (null: empty) and ``end_id``; every id lies in one piece, and
    the pieces of a sequence stand without gaps from offset 0. ``ids`` (uint32, little endian) is
    null with ``keep_ids`` off. Rows are packed as they come: repeated rows are packed repeatedly,
    texts of any length are cut into full sequences, of windows that fit equally well the oldest is
    taken, other columns play no part, and an empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def table(rows: list[tuple], kind: pa.DataType, ids: bool) -> list[pa.Array]:
        ident, start, raw, total, sequence, offset = zip(*rows, strict=True) if rows else [[]] * 6
        ints = lambda x: pa.array(x, pa.int64())
        return [pa.array(ident, kind), ints(start), ints([len(r) // 4 for r in raw]), ints([zlib.crc32(r) for r in raw]), ints(total), ints(sequence), ints(offset), pa.array(raw if ids else [None] * len(rows), pa.binary())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, kind = _encoder(tokenizer_path), TaskContext.get().partitionId(), None
        packer, end = Packer(length, windows, least_cut, part << 40), np.array([end_id], "<u4").tobytes()

        def batch_of(rows: list[tuple], ids: bool, group) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*table(rows, kind, ids), pa.array([group] * len(rows), pa.int64())], [*columns, "merge"])

        for batch in batches:
            kind = batch.column("doc_id").type
            for at in range(0, len(batch), 512):
                part_ = batch.slice(at, 512)
                texts = [t or "" for t in part_.column("text").to_pylist()]
                rows = [row for ident, ids in zip(part_.column("doc_id").to_pylist(), encoder.encode(texts), strict=True) for row in packer.add(ident, ids + end, len(ids) // 4 + 1)]
                yield batch_of(rows, keep_ids, None)
        for _, pieces in packer.open:
            yield batch_of(list(packer._close(pieces)), True, part // merge_partitions)

    # Staged, for both branches below read it; open windows are few and carry their ids.
    packed = staged(docs.select("doc_id", "text").mapInArrow(pack, schema + ", merge long"))

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        kind, rows, pieces, free = group.schema.field("doc_id").type, [], [], length
        packer = Packer(length, 1, 1, MERGED | key[0].as_py() << 40)
        for ident, start, raw, total in zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            while raw:
                head, raw = raw[: 4 * free], raw[4 * free :]
                pieces.append((ident, start, head, total))
                start, free = start + len(head) // 4, free - len(head) // 4
                if not free:
                    rows += packer._close(pieces)
                    pieces, free = [], length
        rows += packer._close(pieces) if pieces else []
        return pa.Table.from_arrays(table(rows, kind, keep_ids), columns)

    closed = packed.where(F.col("merge").isNull()).drop("merge")
    merged = packed.where(F.col("merge").isNotNull()).groupBy("merge").applyInArrow(merge, schema)
    return closed.unionByName(merged)
