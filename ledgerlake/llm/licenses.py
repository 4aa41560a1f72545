"""License scans by diagonal voting.

Every k words in a row of a document are hashed and joined to the places of license templates that have
the same hash and the same words. A match votes for its diagonal, the place in the document less the place
in the template: an unchanged copy gives all its votes to one diagonal, and inserted or missing words move
the rest of a copy to a diagonal beside it. Neighbouring diagonals are merged into spans, and a span
stands if the matched words cover enough of the template.

All of it is DataFrame functions. Documents do not meet: the words of a row are exploded where it is read,
the templates (a few hundred rows, whatever the corpus) go to every task, and only matches and one short
row per document are shuffled, by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and (lower-case) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are always counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The wording of public license notices, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _words(lowered: Column) -> Column:
    # splitting takes a tenth of the time that extracting every match does
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _grams(words: str, k: int) -> Column:
    """Every ``k`` consecutive words, joined by spaces; none where there are fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))
    return F.when(F.size(words) >= k, each).otherwise(F.array().cast("array<string>"))


def template_places(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """template, label, n_template (words), place (from 0), k_words, k_hash: a row for every place of every template."""
    listed = F.array(*[F.struct(F.lit(number).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for number, (label, text) in enumerate(templates)])
    read = spark.range(1).select(F.inline(listed)).select("template", "label", _words(_lowered(F.col("text"))).alias("words"))
    each = read.select("template", "label", F.size("words").alias("n_template"), F.posexplode(_grams("words", k)).alias("place", "k_words"))
    return each.withColumn("k_hash", F.xxhash64("k_words"))


def _phrase_places(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        at = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            at = at & (F.get(words, i + k) == part)
        return at

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _read(docs: DataFrame, ident: str, text: str, phrases: Mapping[str, str]) -> DataFrame:
    """row, words and ``fact`` (id, n_words, n_base, first_word, last_word, labels) of every row."""
    lowered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), _lowered(F.col(text)).alias("lowered"))
    read = lowered.withColumn("words", _words(F.col("lowered")))
    # few texts hold a phrase's last word, and the places are looked up in those only
    found = [F.when(F.contains("lowered", F.lit(p.split()[-1])) & (F.size("words") > 0), _phrase_places(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for p in phrases]
    read = read.select("row", "id", "words", F.array(*found).cast("array<array<int>>").alias("found"))
    places = F.flatten("found")
    named = F.filter(F.array(*[F.when(F.size(F.get("found", k)) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]).cast("array<string>"), lambda x: x.isNotNull())
    fact = F.struct("id", F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_distinct(named).alias("base"))
    return read.select("row", "words", fact.alias("fact"))


def _spans(docs: DataFrame, ident: str, text: str, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], k: int, slack: int, gap: int) -> DataFrame:
    """row, fact, label, first_word, after_word, score: a row for every span, and one without a label for every row of ``docs``.

    ``fact`` is on the rows without a label only.
    """
    places = F.broadcast(template_places(docs.sparkSession, templates, k))  # a row for each word of the templates
    read = _read(docs, ident, text, phrases).withColumn("grams", _grams("words", k))
    # the first element stands for the row itself, so that one pass over the texts gives both
    each = read.select("row", "fact", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("grams"))).alias("at", "doc_words")).withColumn("doc_hash", F.xxhash64("doc_words"))
    met = each.join(places, (F.col("doc_hash") == F.col("k_hash")) & (F.col("doc_words") == F.col("k_words")), "left").where("at = 0 OR template IS NOT NULL")
    votes = met.select("row", F.when(F.col("at") == 0, F.col("fact")).alias("fact"), "template", "label", "n_template", "place", (F.col("at") - 1).alias("at")).repartition("row")
    # one shuffle by row serves the three groupings below
    diagonals = votes.groupBy("row", "template", "label", "n_template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.max("fact").alias("fact"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list("place").alias("places")
    )
    beside = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(beside) > slack) | (F.col("first") > F.max("last").over(beside.rowsBetween(Window.unboundedPreceding, -1)) + k + gap) | (F.col("last") + k + gap < F.min("first").over(beside.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = diagonals.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("span", F.sum("new").over(beside))
    merged = numbered.groupBy("row", "template", "label", "n_template", "span").agg(F.max("fact").alias("fact"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1)))))
    return merged.select("row", "fact", "label", F.col("first").cast("long").alias("first_word"), (F.col("last") + k).cast("long").alias("after_word"), F.when(F.col("label").isNotNull(), covered / F.col("n_template")).alias("score"))


def license_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = 4, share: float = 0.8, slack: int = 4, gap: int = 12) -> DataFrame:
    """doc_id, label, first_word, after_word, score: every span that covers ``share`` of a template's words.

    See ``scan_licenses``.
    """
    spans = _spans(docs, ident, text, templates, {}, k, slack, gap)
    ids = spans.where("label IS NULL").select("row", F.col("fact.id").alias("doc_id"))
    return spans.where((F.col("label").isNotNull()) & (F.col("score") >= share)).select("row", "label", "first_word", "after_word", "score").join(ids, "row").select("doc_id", "label", "first_word", "after_word", "score")


def scan_licenses(docs: DataFrame, ident: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, k: int = 4, share: float = 0.8, slack: int = 4, gap: int = 12) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``.

    Words are those of the whole text with A to Z in lower case. n_base counts the places of all ``phrases``,
    first_word and last_word are the smallest and the largest (from 0), null where there is none.
    ``labels`` adds those of templates of which one span covers ``share`` of the words; diagonals at most
    ``slack`` apart are one span if at most ``gap`` words lie between them. ``score`` is the largest cover of
    any template by any span, 0 without one. Labels are distinct, sorted and joined by commas, empty text where
    there is none. A null or empty text has no words; texts of any length are read whole; rows that agree in
    id or text each give their own row; an empty table gives none; other columns, whatever their names, are
    not read. Templates of fewer than ``k`` words match nothing.
    """
    spans = _spans(docs, ident, text, templates, phrases, k, slack, gap)
    stands = F.when(F.col("score") >= share, F.col("label"))
    found = spans.groupBy("row").agg(F.max("fact").alias("fact"), F.collect_set(stands).alias("own"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    joined = F.array_join(F.array_sort("fact.base"), ",").alias("base_labels")
    return found.select(F.col("fact.id").alias("doc_id"), "fact.n_words", "fact.n_base", "fact.first_word", "fact.last_word", joined, F.array_join(F.array_sort(F.array_union("fact.base", "own")), ",").alias("labels"), "score")
