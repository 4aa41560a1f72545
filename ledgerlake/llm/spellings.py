"""Spelling variants by a dictionary of trie-node pairs.

The words of a corpus are numbered in two tries: a node of the forward trie stands for a beginning of
words, one of the reversed trie for an end. A word cut at place i is a pair of integers, the node of what
comes before and the node of what comes after; with the character at i skipped it is another. Two words
that differ by one replaced character share a skipping pair, and a word that has one character more than
another shares a skipping pair with a plain pair of the shorter one. Since a node is one text and no other,
equal pairs are exact neighbours, without a comparison of letters and without a hash.

Tries are numbered over sorted ranges of words. A node that crosses ranges gets its number from the first
range that has it, which follows from the ranges' first and last words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import drop_stage, staged, write_stage
from ledgerlake.llm.licenses import LOWER, UPPER

#: What stands between runs of letters.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"


def slipped(run: Column, ident: Column, every: int = 97) -> Column:
    """The run, less one code point where ``every`` divides the CRC-32 of "<ident>:<run>" (a null id is empty text)."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: runs of letters, A to Z in lower case, after ``slipped``, of so many code points and occurrences."""
    # explode_outer: for a plain explode Spark infers a filter that would split every text twice
    runs = docs.select(F.col(ident).alias("ident"), F.explode_outer(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN)).alias("run")).where(F.length("run") >= least_length)
    lowered = runs.select("ident", F.translate("run", UPPER, LOWER).alias("run"))
    words = lowered.select(slipped(F.col("run"), F.col("ident")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def common_length(a: str, b: str) -> int:
    """The number of leading code points that two texts share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    return next(k for k in range(most) if a[k] != b[k])


class Range:
    """What a sorted range of words must know of the ranges before it: ``owners[j]`` names the range that numbers the beginning of length j of its first word, for the lengths that an earlier range has too."""

    def __init__(self, number: int, first: str, last: str, before: Range | None) -> None:
        self.number, self.first, self.last = number, first, last
        self.owners: list[int] = []
        if before is not None:
            # beginnings that all of the range before shares with the one before that have their number from further back
            through = min(len(before.owners) - 1, common_length(before.first, before.last))
            shared = common_length(before.last, first)
            self.owners = [before.owners[j] if j <= through else before.number for j in range(shared + 1)]

    def nodes(self, words: list[str]) -> Iterator[list[int]]:
        """For each of the sorted words, the numbers of its beginnings of length 0, 1, ... to the whole.

        Beginnings of the range's last word are numbered by length (negative numbers), so that later
        ranges can name them; all others by a counter of this range.
        """
        ids: list[int] = []
        before, fresh = "", 0
        for word in words:
            ids = ids[: common_length(before, word) + 1]
            head, tail = common_length(word, self.first), common_length(word, self.last)
            for j in range(len(ids), len(word) + 1):
                if j < len(self.owners) and j <= head:
                    ids.append(-((self.owners[j] << 32) + j) - 1)
                elif j <= tail:
                    ids.append(-((self.number << 32) + j) - 1)
                else:
                    ids.append((self.number << 40) + fresh)
                    fresh += 1
            before = word
            yield ids


def trie_nodes(words: DataFrame, key: str, part_chars: int = 4_000_000) -> DataFrame:
    """``words`` with ``id``, which rises with ``key``, and ``nodes``: the trie node of every beginning of ``key``.

    ``key`` is distinct and not null. Words are sorted into ranges of about ``part_chars`` code points, each
    numbered in one task; the first and last word of every range are all that reaches the driver. ``nodes``
    has one number more than the key has code points, so a long word costs its length.
    """
    chars = words.agg(F.sum(F.length(key) + 1)).first()[0] or 0
    ranged = staged(words.repartitionByRange(max(1, -(-chars // part_chars)), key).withColumn("part", F.spark_partition_id()))
    ranges: dict[int, Range] = {}
    last = None
    for r in sorted(ranged.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()):
        last = ranges[r["part"]] = Range(r["part"], r["first"], r["last"], last)

    def number(t: pa.Table) -> pa.Table:
        t = t.sort_by(key)  # by bytes of UTF-8, which is the order of code points
        own = ranges[t.column("part")[0].as_py()]
        flat = [np.array(ids, np.int64) for ids in own.nodes(t.column(key).to_pylist())]
        ends = np.cumsum([0] + [len(x) for x in flat])
        nodes = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(flat)))
        ids = pa.array((own.number << 32) + np.arange(t.num_rows))
        return t.drop_columns("part").append_column("id", ids).append_column("nodes", nodes.cast(pa.list_(pa.int64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return ranged.groupBy("part").applyInArrow(number, f"{fields}, id bigint, nodes array<bigint>")


def _pairs(words: DataFrame) -> DataFrame:
    """p, s, id, n, kind of every place of every word: 0 plain, 2 with a character skipped, 1 likewise within a run of one character.

    Skipping any character of a run gives the same text, so only its first counts as the longer word's place.
    """
    size = F.size("ahead")

    def pair(i: Column, kind: Column, skip: int) -> Column:
        return F.struct(F.get("ahead", i).alias("p"), F.get("behind", size - 1 - i - skip).alias("s"), kind.alias("kind"))

    plain = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, F.lit(0), 0))
    first = F.transform("letters", lambda c, i: (i == 0) | (c != F.get("letters", i - 1)))
    skipping = F.transform(first, lambda is_first, i: pair(i, F.when(is_first, 2).otherwise(1), 1))
    return words.withColumn("letters", F.split("word", "")).select("id", "n", F.explode_outer(F.concat(plain, skipping)).alias("x")).select("x.p", "x.s", "x.kind", "id", "n")


def _neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, best (n, minus id): the number of near words and the most frequent of them, the first in order among equals.

    A pair of nodes has one plain word at most, and as many skipping ones as there are characters to put
    in the gap (at most 90), so a group is small however many words there are, and gives a row for each member,
    not for each pair of them.
    """
    member = F.struct("n", (-F.col("id")).alias("minus_id"))
    groups = _pairs(words).groupBy("p", "s").agg(
        F.max(F.when(F.col("kind") == 0, member)).alias("plain"),
        F.collect_list(F.when(F.col("kind") > 0, member)).alias("skipping"),
        F.collect_list(F.when(F.col("kind") == 2, member)).alias("longer"),
    ).where((F.size("skipping") > 1) | ((F.size("longer") > 0) & F.col("plain").isNotNull()))

    def found(x: Column, n: Column, best: Column) -> Column:
        return F.struct((-x["minus_id"]).alias("id"), n.cast("long").alias("n_near"), best.alias("best"))

    replaced = F.when(F.size("skipping") > 1, F.transform("skipping", lambda x: found(x, F.size("skipping") - 1, F.array_max(F.filter("skipping", lambda y: y != x)))))
    shorter = F.when(F.col("plain").isNotNull(), F.transform("longer", lambda x: found(x, F.lit(1), F.col("plain"))))
    longer = F.when(F.col("plain").isNotNull() & (F.size("longer") > 0), F.array(found(F.col("plain"), F.size("longer"), F.array_max("longer"))))
    empty = F.array().cast("array<struct<id:bigint,n_near:bigint,best:struct<n:bigint,minus_id:bigint>>>")
    rows = groups.select(F.explode_outer(F.concat(*[F.coalesce(x, empty) for x in (replaced, shorter, longer)])).alias("x"))
    return rows.groupBy("x.id").agg(F.sum("x.n_near").alias("n_near"), F.max("x.best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """id, root: where following ``to`` from ``id`` ends. Every round doubles the steps taken; the links have no cycle, for n doubles with each."""
    spark = links.sparkSession
    current, folder = write_stage(links.select("id", F.col("to").alias("root")))
    while True:
        further = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped, new = write_stage(current.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_stage(spark, folder)
        current, folder = jumped.select("id", "root"), new
        if jumped.where("moved").isEmpty():
            return current


def spelling_variants(counts: DataFrame, ratio: int = 2, part_chars: int = 4_000_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``counts`` (word, n; words distinct).

    Near words differ by one inserted, deleted or replaced code point; n_near counts them (0: none). A
    word's form is its near word of largest n, the first in code-point order among equals, if that n is
    ``ratio`` times its own or more; form_n is that n; both null otherwise. root is where the forms lead,
    the word itself without one. Words may be as long as they like. Null words take no part; without any
    word the result is empty.
    """
    # the counts are sorted twice, and sorting reads its input twice
    counts = staged(counts.where("word IS NOT NULL").select("word", "n"))
    ahead = trie_nodes(counts, "word", part_chars).withColumnRenamed("nodes", "ahead")
    behind = trie_nodes(counts.select(F.reverse("word").alias("drow")), "drow", part_chars).select(F.reverse("drow").alias("word"), F.col("nodes").alias("behind"))
    words = staged(ahead.join(behind, "word"))
    near = _neighbours(words)
    listed = words.select("id", "word", "n")
    formed = listed.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("form"))
    formed = staged(formed.select("id", "word", "n", "n_near", (-F.col("form.minus_id")).alias("to"), F.col("form.n").alias("form_n")))
    roots = _roots(formed.where("to IS NOT NULL"))
    full = formed.join(roots, "id", "left")
    for at, name in (("to", "form"), ("root", "root_word")):
        full = full.join(listed.select(F.col("id").alias(at), F.col("word").alias(name)), at, "left")
    return full.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
