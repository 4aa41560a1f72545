"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample of the vectors; every distinct vector is indexed in each tree.
Levels that the sample is too small for split by a direction of their own at the sample's median, so
the depth follows the number of rows while what is broadcast stays bounded. A leaf that the sample
says is large is dealt into blocks, each a group of its own, so that near-equal vectors, which no
plane parts, do not meet in one task. A query searches all trees through one priority queue, ordered
by the squared distance that its path strayed over split planes, and takes the first leaves of
whichever trees; the candidates there are scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged


class ProjectionTree:
    """Nodes are paths: 1 is the root, 2k and 2k + 1 its children."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, least: int = 24):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.depth = depth
        self.fitted = int(np.clip(np.floor(np.log2(max(1, len(sample)) / least)), 0, depth))
        self.normals = np.zeros((2**self.fitted, dim))
        self.cuts = np.zeros(2**self.fitted)
        rest = {1: sample}
        for node in range(1, 2**self.fitted):
            own = rest.pop(node)
            a, b = own[rng.integers(len(own), size=2)] if len(own) > 1 else (rng.normal(size=dim), 0)
            normal = a - b if np.abs(a - b).sum() > 1e-9 else rng.normal(size=dim)
            self.normals[node] = normal / np.linalg.norm(normal)
            far = own @ self.normals[node]
            self.cuts[node] = np.median(far) if len(own) else 0.0
            rest[2 * node], rest[2 * node + 1] = own[far <= self.cuts[node]], own[far > self.cuts[node]]
        self.level_normals = rng.normal(size=(max(0, depth - self.fitted), dim))
        self.level_normals /= np.linalg.norm(self.level_normals, axis=1, keepdims=True)
        self.level_cuts = np.array([np.median(sample @ n) if len(sample) else 0.0 for n in self.level_normals])
        leaves, counts = np.unique(self.leaves(sample), return_counts=True)
        self.share = dict(zip(leaves.tolist(), (counts / max(1, len(sample))).tolist(), strict=True))

    def blocks(self, leaf: int, rows: float, target: int) -> int:
        """Blocks for a leaf's part of ``rows``, as its part of the sample foretells it; entries are no more than the sample's rows."""
        return max(1, -int(-self.share.get(leaf, 0.0) * rows // target))

    def plane(self, node: int) -> tuple[np.ndarray, float]:
        level = node.bit_length() - 1
        return (self.normals[node], self.cuts[node]) if level < self.fitted else (self.level_normals[level - self.fitted], self.level_cuts[level - self.fitted])

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        node = np.ones(len(unit), np.int64)
        for level in range(self.depth):
            if level < self.fitted:
                beyond = np.einsum("ij,ij->i", unit, self.normals[node]) > self.cuts[node]
            else:
                beyond = unit @ self.level_normals[level - self.fitted] > self.level_cuts[level - self.fitted]
            node = 2 * node + beyond
        return node


def search_leaves(trees: list[ProjectionTree], unit: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the ``most`` best leaves over all trees, by one priority queue of squared margins, summed along a path."""
    queue: list[tuple[float, int, int]] = [(0.0, t, 1) for t in range(len(trees))]
    out = []
    while queue and len(out) < most:
        strayed, t, node = heapq.heappop(queue)
        while node.bit_length() - 1 < trees[t].depth:
            normal, cut = trees[t].plane(node)
            margin = float(unit @ normal) - cut
            near = 2 * node + int(margin > 0)
            heapq.heappush(queue, (strayed + margin * margin, t, near ^ 1))
            node = near
        out.append((t, node))
    return out


def _usable(vector: list | None) -> bool:
    if vector is None or not len(vector) or any(x is None for x in vector):
        return False
    v = np.asarray(vector, np.float64)
    return bool(np.isfinite(v).all() and np.abs(v).max() > 0)


def _rows(binary: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = b"".join(binary.to_pylist())
    return np.frombuffer(flat, "<f8").reshape(len(binary), -1)


def distinct_vectors(table: DataFrame, ident: str, vector: str, keep: int, most: int = 20_000) -> DataFrame:
    """(vec, ids): usable vectors as bytes of doubles, each with its ``keep`` smallest ids.

    A task collapses equal vectors over ``most`` distinct ones at a time, so that a vector that a third
    of all rows hold sends ``keep`` ids for that many rows or more, and lists are short where they meet.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vec", "ids"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and _usable(v):
                    raw = np.asarray(v, "<f8").tobytes()
                    held[raw] = sorted({*held.get(raw, ()), i})[:keep]
            if len(held) >= most:
                yield flush()
                held = {}
        yield flush()

    parts = table.select(F.col(ident).cast("long"), vector).mapInArrow(collapse, "vec binary, ids array<long>")
    return parts.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def true_neighbours(block: np.ndarray, vectors: DataFrame, k: int) -> list[tuple[int, np.ndarray]]:
    """(row of ``block``, vector) of the ``k`` nearest other vectors, by brute force over all of column vec; a task hands on k rows a query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in block]
        for batch in batches:
            if not len(batch):
                continue
            c = _rows(batch.column(0))
            scores = (block @ c.T) / np.linalg.norm(c, axis=1)
            raw = batch.column(0).to_pylist()
            for j, line in enumerate(scores):
                near = np.argpartition(-line, min(k, len(line) - 1))[: k + 1]
                own = block[j].tobytes()
                best[j] = sorted([*best[j], *((-float(line[x]), raw[x]) for x in near if raw[x] != own)])[:k]
        out = [(j, *x) for j, held in enumerate(best) for x in held]
        q, score, vec = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.float64()), pa.array(vec, pa.binary())], ["q", "s", "vec"])

    parts = vectors.select("vec").mapInArrow(scan, "q int, s double, vec binary")
    found = parts.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "vec"))), 1, k).alias("best")).collect()
    return [(r["q"], np.frombuffer(x["vec"], "<f8")) for r in found for x in r["best"]]


def leaves_for(target: float, trees: list[ProjectionTree], block: np.ndarray, truth: list[tuple[int, np.ndarray]], least: int) -> int:
    """``least``, doubled until the first leaves of each query of ``block`` hold ``target`` of its true neighbours."""
    most = sum(2**tree.depth for tree in trees)
    if not truth:
        return least
    unit = block / np.linalg.norm(block, axis=1, keepdims=True)
    near = np.stack([v / np.linalg.norm(v) for _, v in truth])
    homes = np.stack([tree.leaves(near) for tree in trees], axis=1).tolist()
    while least < most:
        taken = [set(search_leaves(trees, one, least)) for one in unit]
        hits = sum(any((t, leaf) in taken[q] for t, leaf in enumerate(home)) for (q, _), home in zip(truth, homes, strict=True))
        if hits >= target * len(truth):
            break
        least *= 2
    return min(least, most)


def nearest(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, trees: int = 8, leaf_rows: int = 512, leaves: int | None = None, sample_rows: int = 65_000, seed: int = 5, recall: float = 0.95, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest cosine for each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own (a copy under another id counts). Nearest first, ties
    to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite components take
    no part; a vector is compared with those of its own length, for a cosine needs equal lengths. A
    repeated id with one vector counts once; other columns play no part; an empty table gives an empty
    result. The sample of ``sample_rows`` (of 40 MB at most) shapes the trees only; every vector is
    indexed. ``leaves`` are taken for each query, by default 16 for every level of the trees, doubled
    until a block of 64 queries finds a share of ``recall`` of its true neighbours, which are sought
    by brute force. A leaf is dealt into blocks of about ``block_rows``. A query whose leaves hold fewer than ``k``
    other vectors is compared with all of them, so it gets ``k`` rows wherever there are as many.
    """
    vectors = staged(distinct_vectors(table, ident, vector, k + 1).withColumn("key", F.unhex(F.sha2("vec", 256))))
    plain = table.select(F.col(ident).cast("long").alias("query_id"), vector).where(F.col("query_id") % every == 0)

    def key_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, np.asarray(v, "<f8").tobytes()) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if _usable(v)]
            i, v = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(v, pa.binary())], ["query_id", "vec"])

    queries = staged(plain.mapInArrow(key_of, "query_id long, vec binary").withColumn("qkey", F.unhex(F.sha2("vec", 256))).dropDuplicates(["query_id", "qkey"]))
    # one search for each length that vectors have; a table of embeddings has one
    widths = sorted((r["w"], r["n"]) for r in vectors.groupBy(F.octet_length("vec").alias("w")).agg(F.count("*").alias("n")).collect()) or [(8, 0)]
    parts = [_nearest_of_width(vectors.where(F.octet_length("vec") == w), queries.where(F.octet_length("vec") == w), w, n, k, every, trees, leaf_rows, leaves, sample_rows, seed, recall, block_rows) for w, n in widths]
    return reduce(DataFrame.unionByName, parts)


def _nearest_of_width(vectors: DataFrame, queries: DataFrame, width: int, n: int, k: int, every: int, trees: int, leaf_rows: int, leaves: int | None, sample_rows: int, seed: int, recall: float, block_rows: int) -> DataFrame:
    rows = min(sample_rows, max(1000, 40_000_000 // width))
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(round(1e6 * min(1.0, rows / max(1, n))))
    found = [r[0] for r in vectors.where(draw).select("vec").collect()]
    sample = np.frombuffer(b"".join(found), "<f8").reshape(-1, width // 8)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / leaf_rows)), 0, 60))
    # broadcast: trees over the bounded sample, whatever the number of rows
    forest = vectors.sparkSession.sparkContext.broadcast([ProjectionTree(sample, depth, seed + t) for t in range(trees)])

    def block_of(key: bytes, blocks: int) -> int:
        return int.from_bytes(key[:8], "big") % blocks

    def dealt(batch: pa.RecordBatch, hits: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        row, *place = zip(*hits, strict=True)
        part = batch.take(pa.array(row))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(place, kinds, strict=True)), *part.columns], ["tree", "leaf", "held_block", "asked_block", *part.schema.names])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _rows(batch.column("vec"))
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            keys = batch.column("key").to_pylist()
            for t, tree in enumerate(forest.value):
                hits = [(i, t, leaf, block_of(keys[i], tree.blocks(leaf, n, block_rows)), b) for i, leaf in enumerate(tree.leaves(unit).tolist()) for b in range(tree.blocks(leaf, n / every, block_rows))]
                yield dealt(batch.select(["vec", "ids"]), hits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _rows(batch.column("qvec"))
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            keys = batch.column("qkey").to_pylist()
            for at in range(0, len(batch), 64):
                hits = []
                for i in range(at, min(at + 64, len(batch))):
                    for t, leaf in search_leaves(forest.value, unit[i], leaves):
                        tree = forest.value[t]
                        own = block_of(keys[i], tree.blocks(leaf, n / every, block_rows))
                        hits += [(i, t, leaf, b, own) for b in range(tree.blocks(leaf, n, block_rows))]
                yield dealt(batch, hits)

    found_table = "qkey binary, score double, vec_id long"

    def scored(q: np.ndarray, keys: list[bytes], c: np.ndarray, ids: list[list[int]]) -> pa.Table:
        out: list[tuple] = []
        least = np.array([x[0] for x in ids])
        norms = np.sqrt((c * c).sum(1))
        for at in range(0, len(q) if len(c) else 0, 256):
            rough = (q[at : at + 256] @ c.T) / norms[None, :]
            for j, line in enumerate(rough):
                # a margin over rounding, then the measure itself on the original vectors
                enough = np.partition(line, -(k + 1))[-(k + 1)] if len(line) > k + 1 else -np.inf
                near = np.flatnonzero(line >= enough - 1e-9 * np.abs(line).max())
                one = q[at + j]
                exact = (c[near] * one).sum(1) / (np.sqrt((one * one).sum()) * norms[near])
                for x in np.lexsort((least[near], -exact))[: k + 1]:
                    out += [(keys[at + j], float(exact[x]), i) for i in ids[near[x]]]
        a, b, i = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"qkey": pa.array(a, pa.binary()), "score": pa.array(b, pa.float64()), "vec_id": pa.array(i, pa.int64())})

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return scored(np.empty((0, 1)), [], np.empty((0, 1)), [])
        return scored(_rows(asked.column("qvec")), asked.column("qkey").to_pylist(), _rows(held.column("vec")), held.column("ids").to_pylist())

    def against_all(block: list) -> DataFrame:
        """Scores of a block of queries against every vector, a few from each batch of them."""
        q, keys = np.frombuffer(b"".join(r["vec"] for r in block), "<f8").reshape(len(block), -1), [bytes(r["qkey"]) for r in block]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield from scored(q, keys, _rows(batch.column("vec")), batch.column("ids").to_pylist()).to_batches()

        return vectors.select("vec", "ids").mapInArrow(scan, found_table)

    if leaves is None:
        some = [r["vec"] for r in queries.select("qkey", "vec").distinct().orderBy("qkey").limit(64).collect()]
        block = np.frombuffer(b"".join(some), "<f8").reshape(-1, width // 8)
        leaves = leaves_for(recall, forest.value, block, true_neighbours(block, vectors, k) if some else [], 16 * (depth + 1))
    place = ["tree", "leaf", "held_block", "asked_block"]
    spot = "tree int, leaf long, held_block int, asked_block int"
    asked = queries.groupBy("qkey").agg(F.first("vec").alias("qvec")).mapInArrow(look, f"{spot}, qkey binary, qvec binary")
    held = vectors.select("vec", "ids", "key").mapInArrow(index, f"{spot}, vec binary, ids array<long>")
    hits = asked.groupBy(*place).cogroup(held.groupBy(*place)).applyInArrow(rerank, found_table)

    def best_of(scores: DataFrame) -> DataFrame:
        # at most leaves * blocks * (k + 1)^2 rows per distinct query vector
        return scores.groupBy("qkey").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))

    def own(asking: DataFrame, scores: DataFrame) -> DataFrame:
        empty = F.array().cast("array<struct<s:double,vec_id:bigint>>")
        return asking.join(best_of(scores), "qkey", "left").select("query_id", "qkey", "vec", F.slice(F.filter(F.coalesce("best", empty), lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))

    found = staged(own(queries, hits))
    short = found.where(F.size("best") < k).select("query_id", "qkey", "vec")
    # the leaves of these hold too few vectors, or the table does: they are compared with all, a bounded block at a time
    blocks = -(-short.count() // 2048)
    of_block = F.pmod(F.xxhash64("qkey"), F.lit(max(1, blocks)))
    parts = [found.where(F.size("best") == k)]
    for b in range(blocks):
        asking = short.where(of_block == b)
        block = asking.select("qkey", "vec").distinct().collect()
        if block:
            parts.append(own(asking, against_all(block)))
    every_one = reduce(DataFrame.unionByName, parts)
    return every_one.select("query_id", F.posexplode("best").alias("r", "b")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
