"""The queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import ann, bpe, langid, licenses, lines, matroska, packing, quality, simhash, spellings, substrings, token_counts, whitening
from ledgerlake.llm.common import read_table, shared_dir


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify_language(docs, langid.fit_language_model(docs))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through the cache in the folder that spark.ledgerlake.token_counts names, by default a new one of its own."""
    cache = spark.conf.get("spark.ledgerlake.token_counts", None) or f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"), window=35, stable=True).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_removed, n_chars, text_sha256 (null for a null text) of every document after line dedup."""
    kept = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts="lines_removed", stable=True)
    return kept.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.classify_quality(docs, quality.fit_quality_model(docs, read_table(spark, sf_dir, "labels")))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_features(matroska.store_texts(read_table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(read_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_variants(spellings.word_counts(read_table(spark, sf_dir, "documents")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_byte_bpe, op3_simhash, op4_token_counts, op5_packing, op6_substring_dedup, op7_nearest_neighbours, op8_line_dedup, op9_quality, op10_matroska, op11_whitening, op12_spelling_variants, op13_license_scan)
    return {f.__name__: f for f in ops}


OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), counted AS (
  SELECT doc_id, r, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM runs WHERE length(r) >= 5 GROUP BY doc_id, r
), hashed AS (
  SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM counted, bytes
), slipped AS (
  SELECT c, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), skips AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM skips a JOIN words v ON v.word = a.p || a.s
  UNION SELECT v.word, a.word, a.n FROM skips a JOIN words v ON v.word = a.p || a.s
), best AS (
  SELECT word, other, n AS o, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o >= 2 * w.n THEN other END AS form, CASE WHEN o >= 2 * w.n THEN o END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1
), steps AS (
  SELECT word, form AS reached, 1 AS d FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form, d + 1 FROM steps s JOIN formed f ON f.word = s.reached WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(reached, d) AS root FROM steps GROUP BY word
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN ends e ON e.word = f.word
"""

def _op13_sql(k: int = 4, share: float = 0.8, slack: int = 4, gap: int = 12) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({n}, {quoted(label)}, {quoted(text)})" for n, (label, text) in enumerate(licenses.TEMPLATES))
    words = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.BETWEEN}'), lambda x: x <> '')"
    found = []
    for phrase, label in licenses.PHRASES.items():
        here = " AND ".join(f"w[i + {j}] = {quoted(x)}" for j, x in enumerate(phrase.split(), 1))
        found.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {here}), lambda i: {{'i': i, 'l': {quoted(label)}}})")
    return rf"""
WITH t AS (SELECT template, label, {words} AS w FROM (VALUES {templates}) x(template, label, text)
), d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), b AS (SELECT r, doc_id, len(w) AS n, list_concat(list_concat({found[0]}, {found[1]}), {found[2]}) AS f FROM d
), tg AS (SELECT template, label, len(w) AS n, p, array_to_string(w[p + 1:p + {k}], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - {k - 1})) AS p FROM t)
), dg AS (SELECT r, a, array_to_string(w[a + 1:a + {k}], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - {k - 1})) AS a FROM d)
), hits AS (SELECT r, template, label, n, a, p, a - p AS diagonal FROM dg JOIN tg USING (g)
), diagonals AS (SELECT r, template, diagonal, min(a) AS lo, max(a) AS hi FROM hits GROUP BY ALL
), steps AS (
  SELECT *, lag(diagonal) OVER w AS before, max(hi) OVER (PARTITION BY r, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
    min(lo) OVER (PARTITION BY r, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)
), spans AS (
  SELECT r, template, diagonal, sum(CASE WHEN diagonal - before > {slack} OR lo > top + {k + gap} OR hi + {k + gap} < low THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM steps
), covered AS (
  SELECT DISTINCT r, template, label, n, span, unnest(range(p, p + {k})) AS c FROM hits JOIN spans USING (r, template, diagonal)
), scored AS (SELECT r, label, count(*) / n AS score FROM covered GROUP BY r, template, label, n, span
), own AS (SELECT r, max(score) AS score, list(label) FILTER (score >= {share}) AS l FROM scored GROUP BY r)
SELECT doc_id, CAST(b.n AS BIGINT) AS n_words, CAST(len(f) AS BIGINT) AS n_base, CAST(list_min(list_transform(f, lambda x: x.i)) AS BIGINT) AS first_word, CAST(list_max(list_transform(f, lambda x: x.i)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.l))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(f, lambda x: x.l), coalesce(own.l, [])))), ','), '') AS labels, coalesce(own.score, 0.0)::DOUBLE AS score
FROM b LEFT JOIN own ON own.r = b.r
"""


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35
), windows AS (
  SELECT r, s, array_to_string(list_slice(w, s, s + 34), ' ') AS k FROM starts
), repeated AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM repeated
), gone AS (
  SELECT r, list(i) AS g FROM covered GROUP BY r
), words AS (
  SELECT d.r, doc_id, len(w) AS n, w, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (r)
), exploded AS (
  SELECT r, unnest(range(1, n + 1)) AS i, unnest(w) AS x FROM words
), kept AS (
  SELECT e.r, string_agg(x, ' ' ORDER BY i) AS k FROM exploded e ANTI JOIN covered c ON e.r = c.r AND e.i = c.i GROUP BY e.r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6_SQL, "op12_spelling_variants": OP12_SQL, "op13_license_scan": _op13_sql()}
