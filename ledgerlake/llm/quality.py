"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every token (a word or a run of punctuation) and its shape (case pattern, length, line end) fall into
hash buckets. A bucket's index vector is a sparse random ternary vector; its word vector is the sum of
the index vectors of its neighbours in the training sample. A document is the mean of its tokens'
word vectors, the mean of their index vectors, and a few ratios; a two-layer numpy network scores it,
and a temperature fitted on a held-back part of the sample calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import bounded_sample, is_held_out, may_train

#: Words, numbers, runs of punctuation, line ends.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
_RATIOS = 5


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray  # buckets x (context dim + index dim)
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float  # answers for everything where no labelled row could be read


class _Buckets(dict):
    """token -> (word bucket, shape bucket), remembered per worker up to a bound."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 100_000:
            self.clear()
        case = "U" if token.isupper() else "l" if token.islower() else "T" if token.istitle() else "m"
        kind = case if token[0].isalpha() else "9" if token[0].isdigit() else "n" if token == "\n" else "p"
        shape = f"\0{kind}{min(len(token), 12)}"
        pair = zlib.crc32(token.lower().encode()) & self.mask, zlib.crc32(shape.encode()) & self.mask
        self[token] = pair
        return pair


def _document(text: str | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(tokens x 2 buckets, ratios) of the whole text; null counts as empty."""
    tokens = _TOKEN.findall(text or "")
    ids = np.array([buckets[t] for t in tokens], np.int64).reshape(-1, 2)
    n = max(1, len(tokens))
    lines = (text or "").split("\n")
    ratios = np.array([np.log1p(len(tokens)), len(set(tokens)) / n, len(set(lines)) / len(lines), sum(map(str.isupper, tokens)) / n, np.log1p(len(lines))], np.float32)
    return ids, ratios


def _pool(ids: np.ndarray, ratios: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(vectors.shape[1], np.float32)
    for at in range(0, len(ids), 65_536):  # very long texts are summed piece by piece
        total += vectors[ids[at : at + 65_536].ravel()].sum(0)
    return np.concatenate([total / max(1, 2 * len(ids)), ratios])


def _index_vectors(buckets: int, dim: int, rng: np.random.Generator, ones: int = 8) -> np.ndarray:
    out = np.zeros((buckets, dim), np.float32)
    for _ in range(ones):
        out[np.arange(buckets), rng.integers(0, dim, buckets)] += rng.choice(np.array([-1, 1], np.float32), buckets)
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_quality_model(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000, bits: int = 14, dim: int = 48, hidden: int = 24, steps: int = 1500, seed: int = 11) -> QualityModel:
    """Train on at most about ``per_class`` labelled rows of either class, no text longer than ``max_chars``.

    Held-out rows are left out before anything is read. Of contradicting labels of one id the
    smaller counts. Without usable rows of both classes every score is the prior (0.5 if none).
    """
    marks = labels.where(may_train() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(marks, "quality", "doc_id", per_class)
    texts = docs.where(may_train() & (F.coalesce(F.length("text"), F.lit(0)) <= max_chars)).select("doc_id", "text")
    # the sample of ids is bounded by its parameter, so it may be broadcast; of rows that share an id one is read
    read = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("quality").alias("quality"))
    rows = sorted((r["doc_id"], r["text"], r["quality"]) for r in read.collect())
    rng = np.random.default_rng(seed)
    count, width = 1 << bits, 2 * dim + _RATIOS
    y = np.array([r[2] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        flat = np.zeros((count, 2 * dim), np.float32)
        return QualityModel(flat, np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros((width, hidden), np.float32), np.zeros(hidden, np.float32), np.zeros(hidden, np.float32), 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    buckets = _Buckets(bits)
    parsed = [_document(text, buckets) for _, text, _ in rows]
    index = _index_vectors(count, dim, rng)
    context, seen = np.zeros((count, dim), np.float32), np.zeros(count, np.float32)
    for ids, _ in parsed:
        word, own = ids[:, 0], index[ids].sum(1)  # a token's word and shape index vectors together
        near = np.zeros_like(own)
        for k in (1, 2):
            near[k:] += own[:-k]
            near[:-k] += own[k:]
        for column in (word, ids[:, 1]):
            np.add.at(context, column, near)
            np.add.at(seen, column, 1)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    context *= np.minimum(1, seen / 3)[:, None]  # a bucket hardly seen says little
    vectors = np.concatenate([context, index / np.sqrt(8)], axis=1)
    x = np.stack([_pool(ids, ratios, vectors) for ids, ratios in parsed])
    order = rng.permutation(len(x))
    held, train = order[: len(order) // 6], order[len(order) // 6 :]
    if len(set(y[held].tolist())) < 2 or len(set(y[train].tolist())) < 2:
        held = train = order
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-4
    z = np.clip((x - mean) / scale, -8, 8)
    weight = np.ones(len(y), np.float32)
    p = {"w1": rng.normal(0, 1 / np.sqrt(width), (width, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.choice(train, min(128, len(train)))
        h = np.tanh(z[pick] @ p["w1"] + p["b1"])
        error = (_sigmoid(h @ p["w2"] + p["b2"][0]) - y[pick]) * weight[pick] / len(pick)
        back = error[:, None] * p["w2"][None, :] * (1 - h * h)
        grad = {"w1": z[pick].T @ back + 3e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ error + 3e-4 * p["w2"], "b2": error.sum(keepdims=True)}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[held] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]

    def loss(t: float) -> float:
        q = np.clip(_sigmoid(logit / t), 1e-7, 1 - 1e-7)
        return float(-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean())

    temperature = float(min(np.geomspace(0.2, 10, 50), key=loss))
    return QualityModel(vectors, mean, scale, p["w1"].astype(np.float32), p["b1"].astype(np.float32), p["w2"].astype(np.float32), float(p["b2"][0]), temperature, float(y.mean()))


_SCORES: dict[str, object] = {}


def _score(model: QualityModel, text: str | None, buckets: _Buckets) -> float:
    if not model.w1.any():
        return model.prior
    x = np.clip((_pool(*_document(text, buckets), model.vectors) - model.mean) / model.scale, -8, 8)
    return float(_sigmoid((np.tanh(x @ model.w1 + model.b1) @ model.w2 + model.b2) / model.temperature))


def with_quality(docs: DataFrame, model: QualityModel, column: str) -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of every whole text; null counts as empty.

    Rows are scored one by one, whole texts of any length: repeated rows get equal scores, an empty
    table stays empty. A column that already has the name is replaced, others of any name stay.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != column.lower()])
    bits = int(np.log2(len(model.vectors)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _SCORES.setdefault(f"buckets{bits}", _Buckets(bits))
        for batch in batches:
            scores = [_score(shipped.value, t.as_py(), buckets) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify_quality(docs: DataFrame, model: QualityModel, accept: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= ``accept``), one row per document.

    Null and empty texts are scored as texts without words; other columns play no part; see ``with_quality``.
    """
    scored = with_quality(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
