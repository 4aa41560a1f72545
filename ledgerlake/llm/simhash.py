"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint is the bitwise majority of its shingles' 64-bit hashes. Distinct
fingerprints are partitioned by a vantage-point tree: every node splits by the Hamming distance to a
vantage point at the median of a bounded sample. A fingerprint lives in one shard, and is also sent
as a query to each shard that its search ball overlaps, by the triangle inequality. Inside a shard
the same splitting goes on in numpy down to small leaves, which are compared exactly.

Distances of random fingerprints crowd around half of the bits, so a ball of the full radius crosses
most boundaries. Two facts keep pruning effective without losing a pair: distance on a subset of the
bits is a (pseudo-)metric too, and two fingerprints within r bits differ in r // 2 bits or fewer on
one of two halves. So there is a tree for either half, searched with radius r // 2.

Equal fingerprints are collapsed first, and a shard returns a spanning forest of its links instead of
all pairs, so a group of copies costs what its rows cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import fresh, join_by_key, staged
from ledgerlake.llm.components import connected_components

_HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers that give further hashes of a shingle from its first one.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 for no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each shingle, from its first one."""
    x = (hashes ^ (hashes >> np.uint64(29))) * _MIX[k]
    x = (x ^ (x >> np.uint64(32))) * _MIX[(k + 1) % 3]
    return x ^ (x >> np.uint64(31))


def with_fingerprints(docs: DataFrame, shingle: int, column: str, wide: str | None = None, size: str | None = None, key: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the fingerprint (long, two's complement) of every whole text.

    ``wide`` adds an array of three further fingerprints by other hashes, for checks of candidates,
    ``size`` the number of shingles and ``key`` a hash of their set; all are then taken over distinct shingles.
    """
    at = docs.columns.index("text")

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, more, sizes, keys = [], [], [], []
            for text in batch.column(at):
                h = shingle_hashes(text.as_py(), shingle)
                h = np.unique(h) if wide else h
                prints.append(majority(h))
                if wide:
                    more.append([majority(mixed(h, k)) for k in range(3)])
                    sizes.append(len(h))
                    keys.append(xxhash.xxh3_64_intdigest(h.tobytes()))
            columns = [*batch.columns, pa.array(np.array(prints, np.uint64).view(np.int64))]
            if wide:
                flat = np.array(more, np.uint64).reshape(-1).view(np.int64)
                columns += [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3), pa.int32()), pa.array(flat)), pa.array(sizes, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, column, *([wide, size, key] if wide else [])])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])
    return docs.mapInArrow(stamp, schema.add(wide, T.ArrayType(T.LongType())).add(size, T.LongType()).add(key, T.LongType()) if wide else schema)


class VantageTree:
    """Vantage points and radii fitted on a sample of distinct fingerprints; node k has children 2k+1 and 2k+2.

    Levels that the sample is too small for (fewer than ``least`` a node) share one vantage point
    each, at the sample's median, so that the depth may follow the number of rows.
    """

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int, seed: int, least: int = 4):
        rng = np.random.default_rng(seed)
        self.mask, self.depth = mask, depth
        self.fitted = int(np.clip(np.log2(max(1, len(sample)) / least), 0, depth))
        self.points = np.zeros(2**self.fitted - 1, np.uint64)
        self.radii = np.full(2**self.fitted - 1, -1, np.int16)
        self.level_points = rng.integers(0, 2**63, depth - self.fitted, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.level_radii = np.array([np.median(np.bitwise_count((sample ^ p) & mask)) if len(sample) else int(mask).bit_count() // 2 for p in self.level_points], np.int16)
        rest = {0: sample}
        for node in range(2**self.fitted - 1):
            own = rest.pop(node, sample[:0])
            self.points[node] = own[rng.integers(len(own))] if len(own) else rng.integers(0, 2**63, dtype=np.uint64)
            far = np.bitwise_count((own ^ self.points[node]) & mask)
            self.radii[node] = int(np.median(far)) if len(own) else int(mask).bit_count() // 2
            rest[2 * node + 1], rest[2 * node + 2] = own[far <= self.radii[node]], own[far > self.radii[node]]

    def route(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): every leaf that the ball around a fingerprint overlaps, and whether the fingerprint lives there."""
        row, node, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
        for level in range(self.depth):
            point, near = (self.points[node], self.radii[node]) if level < self.fitted else (self.level_points[level - self.fitted], self.level_radii[level - self.fitted])
            far = np.bitwise_count((prints[row] ^ point) & self.mask).astype(np.int16)
            edge = far <= near
            inner, outer = far - radius <= near, far + radius > near
            row = np.concatenate([row[inner], row[outer]])
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
            home = np.concatenate([home[inner] & edge[inner], home[outer] & ~edge[outer]])
        return row, node - (2**self.depth - 1), home


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking positions a[i] and b[i]; a label is the smallest position linked."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        least = np.minimum(one, two)
        label = label.copy()
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
        while ((jump := label[label]) != label).any():
            label = jump


def _search(prints: np.ndarray, homes: np.ndarray, asks: np.ndarray, mask: np.uint64, radius: int, rng: np.random.Generator, small: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (homes, queries) of leaves: positions that must be compared. A vantage point splits what is larger."""
    work = [(homes, asks)]
    while work:
        own, ask = work.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > small:
            point = prints[own[rng.integers(len(own))]]
            far, asked = (np.bitwise_count((prints[x] ^ point) & mask).astype(np.int16) for x in (own, ask))
            middle = int(np.median(far))
            inside = far <= middle
            if 0 < inside.sum() < len(own):
                one, two = ask[asked - radius <= middle], ask[asked + radius > middle]
                if len(one) + len(two) < 1.95 * len(ask):  # else the boundary crosses almost every ball
                    work += [(own[inside], one), (own[~inside], two)]
                    continue
        yield own, ask


def shard_links(prints: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, bits: int, sizes: np.ndarray | None = None, wide: np.ndarray | None = None, wide_bits: int = 0, ratio: float = 0.0, asks: np.ndarray | None = None) -> np.ndarray:
    """Position -> smallest position linked to it inside this shard.

    Links are within ``bits`` of 64 and, with ``wide``, within ``wide_bits`` of all 256; with
    ``sizes`` only sets whose sizes can be similar enough (``ratio``) are compared. ``asks`` marks the
    queries (all by default), ``home`` what they are compared with.
    """
    label, rng = np.arange(len(prints)), np.random.default_rng(len(prints))
    for own, ask in _search(prints, np.flatnonzero(home), np.arange(len(prints)) if asks is None else np.flatnonzero(asks), mask, radius, rng):
        for at in range(0, len(ask), max(1, 2_000_000 // len(own))):
            q = ask[at : at + max(1, 2_000_000 // len(own))]
            if sizes is None:
                a, b = np.nonzero(np.bitwise_count(prints[q][:, None] ^ prints[own][None, :]) <= bits)
                a, b = q[a], own[b]
            else:
                ordered = own[np.argsort(sizes[own], kind="stable")]
                q = q[np.argsort(sizes[q], kind="stable")]
                a, b = _banded(prints, sizes, q, ordered, bits, ratio)
            if wide is not None and len(a):
                close = sum(np.bitwise_count(wide[a, k] ^ wide[b, k]).astype(np.int16) for k in range(wide.shape[1])) + np.bitwise_count(prints[a] ^ prints[b]) <= wide_bits
                a, b = a[close], b[close]
            label = _united(label, a, b)
    return label


def _banded(prints: np.ndarray, sizes: np.ndarray, q: np.ndarray, own: np.ndarray, bits: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``bits``; both sides come sorted by size, so a block of queries meets a slice of homes."""
    out_a, out_b, lengths = [], [], sizes[own]
    for at in range(0, len(q), 64):
        block = q[at : at + 64]
        lo, hi = np.searchsorted(lengths, sizes[block[0]] * ratio - 1e-9), np.searchsorted(lengths, sizes[block[-1]] / ratio + 1e-9, side="right")
        if lo < hi:
            a, b = np.nonzero(np.bitwise_count(prints[block][:, None] ^ prints[own[lo:hi]][None, :]) <= bits)
            out_a.append(block[a])
            out_b.append(own[lo:hi][b])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def fingerprint_links(prints: DataFrame, bits: int, shard_rows: int = 20_000, sample_rows: int = 20_000) -> DataFrame:
    """Links (fp, rep) between distinct fingerprints whose closure equals that of all pairs within ``bits``.

    ``prints`` has one long column fp without repeats. Trees are fitted on about ``sample_rows``
    fingerprints; the sample shapes the shards only, never what is found.
    """
    n = prints.count()
    draw = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1_000_000)) < F.lit(round(1e6 * min(1.0, sample_rows / max(1, n))))
    sample = np.array([r[0] for r in prints.where(draw).collect()], np.int64).view(np.uint64)
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / shard_rows)), 0, 40))
    trees = [VantageTree(sample, mask, depth, k) for k, mask in enumerate(_HALVES)]
    radius = bits // 2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k, tree in enumerate(trees):
                row, leaf, home = tree.route(fp.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k), pa.int32()), pa.array(leaf, pa.int64()), pa.array(home), pa.array(fp[row])], ["tree", "leaf", "home", "fp"])

    def search(key: tuple, shard: pa.Table) -> pa.Table:
        fp, home = shard.column("fp").to_numpy(), shard.column("home").to_numpy()
        root = shard_links(fp.view(np.uint64), home, _HALVES[key[0].as_py()], radius, bits)
        moved = root != np.arange(len(root))
        return pa.table({"fp": fp[moved], "rep": fp[root[moved]]})

    return prints.mapInArrow(route, "tree int, leaf long, home boolean, fp long").groupBy("tree", "leaf").applyInArrow(search, "fp long, rep long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per document.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id
    reachable, itself included (null ids never win; null if the component has no other). Texts
    without words, null ones included, share fingerprint zero and are linked like any other.
    Repeated rows are kept, texts of any length are read whole, other columns play no part, and an
    empty table gives an empty result.
    """
    stamped = staged(with_fingerprints(docs.select("doc_id", "text"), shingle, "fp").select("doc_id", "fp"))
    prints = staged(stamped.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    component = connected_components(fingerprint_links(prints.select("fp"), bits, shard_rows), "fp", "rep")
    rooted = prints.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(smallest, "root").select("fp", "component_id", "n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    return join_by_key(stamped, named, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block_rows: int | None = None) -> DataFrame:
    """The documents, with one row of every near-duplicate group: the one with the smallest doc_id.

    Two texts link where the Jaccard similarity of their sets of word shingles (64-bit hashes) is
    ``similarity`` or more. Fingerprints only choose candidates: for binary sets the cosine is
    2J / (1 + J), and fingerprints differ in a share of bits equal to the angle / pi. They are taken
    with 4.5 standard deviations of slack on 64 bits and 6 on 256 (sets of a few shingles differ in
    more bits than the angle says); the sets decide. Of rows with equal ids, or null ids (last),
    one stays, and so of repeated rows. Texts without words, null ones included, form one group; texts
    of any length are read whole; other columns of any name stay; an empty table stays empty. Sizes of
    shingle sets prune: a set's size is its distance to the empty set, a vantage point that all share.
    """
    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = int(64 * angle + 4.5 * np.sqrt(64 * angle * (1 - angle)))
    wide_bits = int(256 * angle + 6 * np.sqrt(256 * angle * (1 - angle)))
    fp, wide, size, row, key = (fresh(docs.columns, x) for x in ("fp", "wide", "size", "row", "key"))
    # a number of its own for every row, once written, so that copies never need to meet in a join
    stamped = staged(with_fingerprints(docs, shingle, fp, wide, size, key).withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("t"), F.col(row).alias("vertex"))
    # Equal sets of shingles are one vertex, named by the row that stays for it.
    sets = stamped.groupBy(key, F.col(fp).alias("fp"), F.col(wide).alias("wide"), F.col(size).alias("size")).agg(F.min(order).alias("least"))
    vertex = staged(sets.select("least.vertex", "fp", "wide", "size", "least"))
    candidates = connected_components(wide_links(vertex, bits, wide_bits, similarity, block_rows), "vertex", "rep").withColumnRenamed("node", "vertex")
    asked = staged(vertex.select("vertex", "fp", "wide", "size").join(candidates, "vertex"))
    texts = with_blocks(asked).join(stamped.select(F.col(row).alias("vertex"), "text"), "vertex")
    component = connected_components(exact_links(texts, shingle, wide_bits, similarity), "vertex", "rep")
    rooted = vertex.join(component.withColumnRenamed("node", "vertex"), "vertex", "left").select("least", F.coalesce("component", "vertex").alias("root"))
    winners = rooted.groupBy("root").agg(F.min("least").alias("w")).select(F.col("w.vertex").alias(row))
    return stamped.join(winners, row, "left_semi").select(*docs.columns)


def similar_sets(sets: list[np.ndarray], prints: np.ndarray, wide_bits: int, ratio: float, flat: int = 4_000_000) -> np.ndarray:
    """Position -> smallest position linked to it: sets (sorted, distinct) of Jaccard similarity ``ratio`` or more.

    Pairs whose fingerprints (four words a row) differ in over ``wide_bits`` are not compared, nor are
    pairs that earlier links already unite, so a group of near copies costs about what its sets cost.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    by_size = np.argsort(sizes, kind="stable")
    lengths, label = sizes[by_size], np.arange(len(sets))
    stops = np.searchsorted(lengths, lengths / ratio + 1e-9, side="right")
    for at, one in enumerate(by_size.tolist()):
        rest = by_size[at + 1 : stops[at]]
        rest = rest[label[rest] != label[one]]
        rest = rest[np.bitwise_count(prints[rest] ^ prints[one]).sum(1, dtype=np.int64) <= wide_bits]
        own = sets[one]
        while len(rest):
            now = max(1, int(np.searchsorted(np.cumsum(sizes[rest]), flat)))
            some, rest = rest[:now], rest[now:]
            all_hashes = np.concatenate([sets[k] for k in some.tolist()])
            hit = own[np.minimum(np.searchsorted(own, all_hashes), len(own) - 1)] == all_hashes
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            near = some[common / (len(own) + sizes[some] - common) >= ratio]
            label = _united(label, np.full(len(near), one), near)
            rest = rest[label[rest] != label[one]]
    return label


def with_blocks(asked: DataFrame, rows: int = 4_000, hashes: int = 2_000_000) -> DataFrame:
    """Candidates (vertex, size, component, ...) with the number of blocks of their group: one for every ``rows`` sets or ``hashes`` shingles."""
    blocks = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("size") / hashes)).cast("int")
    large = staged(asked.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1"))
    # few groups are large, so they rarely fail to fit this bound; a group's rows then stay where they are
    few = F.broadcast(large) if large.count() <= 200_000 else large
    return asked.join(few, "component", "left").fillna(1, ["blocks"])


def exact_links(texts: DataFrame, shingle: int, wide_bits: int, ratio: float) -> DataFrame:
    """Links (vertex, rep) inside groups of candidates (vertex, fp, wide, component, blocks, text), decided on the sets of shingles.

    A large group is dealt into its blocks, and every pair of its blocks is a task of its own. Texts
    travel, for they are smaller than their hashes.
    """

    def decide(key: tuple, block: pa.Table) -> pa.Table:
        name = block.column("vertex").to_numpy()
        wide = block.column("wide").combine_chunks().flatten().to_numpy().reshape(-1, 3)
        prints = np.column_stack([block.column("fp").to_numpy(), wide]).view(np.uint64)
        root = similar_sets([np.unique(shingle_hashes(x.as_py(), shingle)) for x in block.column("text")], prints, wide_bits, ratio)
        moved = root != np.arange(len(root))
        return pa.table({"vertex": name[moved], "rep": name[root[moved]]})

    dealt = texts.select("component", "vertex", "fp", "wide", "text", "blocks").withColumn("own", F.pmod(F.xxhash64("vertex", F.lit(11)), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> own OR blocks = 1)")))
    tasks = pairs.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other", "blocks")
    return tasks.groupBy("component", "low", "high").applyInArrow(decide, "vertex long, rep long")


def rows_of_block(n: int) -> int:
    """An eighth of all ``n`` rows, from 4,000 to 250,000: a row is copied to its block's pairs, so between 32,000 and two million rows copies grow with the rows; beyond, a task's memory bounds the block."""
    return int(np.clip(n // 8, 4_000, 250_000))


def wide_links(vertex: DataFrame, bits: int, wide_bits: int, ratio: float, block_rows: int | None = None) -> DataFrame:
    """Links (vertex, rep) between vertices (fp, wide, size): rings around the empty set, then vantage points in each block.

    A ring spans a factor of 1 / ``ratio`` in size, so a set meets its own ring and the two beside it.
    A ring is dealt into blocks of about ``block_rows`` (``rows_of_block`` by default), and every pair of blocks is a task of its own: a source whose texts have one length
    fills many tasks, none of which holds more than two blocks.
    """
    step = float(np.log(1 / ratio))
    ringed = vertex.select("vertex", "fp", "wide", F.col("size").cast("long").alias("size"), F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / step + 1e-9).alias("ring"))
    # one number a ring, and rings grow with the logarithm of the longest text
    counts = {r["ring"]: r["n"] for r in ringed.groupBy("ring").agg(F.count("*").alias("n")).collect()}
    rows = block_rows or rows_of_block(sum(counts.values()))
    blocks = {ring: -(-n // rows) for ring, n in counts.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row to the tasks of its block with every block of its ring and of the rings beside it."""
        for batch in batches:
            name, rings = batch.column("vertex").to_numpy(), batch.column("ring").to_pylist()
            picks, tasks, homes, asks = [], [], [], []
            for k, (x, ring) in enumerate(zip(name.tolist(), rings, strict=True)):
                own = (x * 0x9E3779B97F4A7C15 >> 20) % blocks[ring]
                out = [(f"{ring}.{min(own, b)}.{max(own, b)}", own <= b, own >= b) for b in range(blocks[ring])]
                out += [(f"{ring}+{own}.{b}", True, False) for b in range(blocks.get(ring + 1, 0))]
                out += [(f"{ring - 1}+{b}.{own}", False, True) for b in range(blocks.get(ring - 1, 0))]
                picks += [k] * len(out)
                for column, values in zip((tasks, homes, asks), zip(*out, strict=True), strict=True):
                    column += values
            part = batch.select(["vertex", "fp", "wide", "size"]).take(pa.array(picks, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tasks, pa.string()), pa.array(homes, pa.bool_()), pa.array(asks, pa.bool_())], [*part.schema.names, "task", "home", "asks"])

    def search(key: tuple, shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy().view(np.uint64)
        wide = shard.column("wide").combine_chunks().flatten().to_numpy().reshape(-1, 3).view(np.uint64)
        name = shard.column("vertex").to_numpy()
        root = shard_links(fp, shard.column("home").to_numpy(), _ALL, bits, bits, shard.column("size").to_numpy().astype(np.float64), wide, wide_bits, ratio, shard.column("asks").to_numpy())
        moved = root != np.arange(len(root))
        return pa.table({"vertex": name[moved], "rep": name[root[moved]]})

    dealt = ringed.mapInArrow(deal, "vertex long, fp long, wide array<long>, size long, task string, home boolean, asks boolean")
    return dealt.groupBy("task").applyInArrow(search, "vertex long, rep long")
