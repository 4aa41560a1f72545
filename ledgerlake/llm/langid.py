"""Language ID: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is lower-cased, ASCII bytes other than letters become spaces, and its byte 2-, 3- and 4-grams
are hashed into buckets. A document is the mean of its buckets' embeddings; a linear softmax over that
mean gives the languages. Embeddings and softmax are trained together by stochastic gradient descent
in numpy on a bounded sample; a temperature and a rejection threshold are fitted on a part of the
sample that training does not see. Because mean and softmax layer are linear, embedding @ weights is
folded into one small table (buckets x languages), which is all that scoring broadcasts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_sample, is_held_out, may_train

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces; bytes of longer UTF-8 sequences stay.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_BLANKS = re.compile(rb" +")


@dataclass(frozen=True)
class LangModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding @ weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _buckets(text: str, bits: int) -> np.ndarray:
    """Hashed 2-, 3- and 4-grams of the whole text."""
    raw = _BLANKS.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16))
    four = three[:-1] | (b[3:] << np.uint32(24))
    shift = np.uint32(32 - bits)
    return np.concatenate([(two * np.uint32(2654435761)) >> shift, (three * np.uint32(2246822519)) >> shift, (four * np.uint32(3266489917)) >> shift])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _logits(model: LangModel, text: str, bits: int) -> np.ndarray:
    ids = _buckets(text, bits)
    return (np.bincount(ids, minlength=1 << bits) @ model.table if len(ids) > 1 << bits else model.table[ids].sum(0)) / max(1, len(ids)) + model.bias


def fit_language_model(docs: DataFrame, per_language: int = 600, max_chars: int = 20_000, bits: int = 15, dim: int = 16, epochs: int = 4, seed: int = 7) -> LangModel:
    """Train on at most about ``per_language`` rows of each non-null lang, none longer than ``max_chars``.

    Rows whose id hash marks them as held out are never read for training; of rows that share an id one
    is read. An empty sample gives a model without languages, which answers `und` for everything.
    """
    usable = docs.where(may_train() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "text", "lang")
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in bounded_sample(usable, "lang", "doc_id", per_language).collect() if _LETTER.search(r["text"]))
    languages = sorted({lang for _, lang, _ in rows})
    if not languages:
        return LangModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    index = {lang: k for k, lang in enumerate(languages)}
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    for _, lang, text in rows:
        words = text.split()
        at = int(rng.integers(len(words))) if words else 0
        short = " ".join(words[at : at + int(rng.integers(1, 12))])
        for part in (text, short):
            if _LETTER.search(part):
                examples.append((*np.unique(_buckets(part, bits), return_counts=True), index[lang]))
    order = rng.permutation(len(examples))
    held = order[: max(1, len(order) // 8)] if len(order) > 8 else order
    train = order[len(held) :] if len(order) > 8 else order
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs) + 0.1
        for k in rng.permutation(train):
            ids, counts, y = examples[k]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ emb[ids]
            error = _softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * 0.2 * np.outer(mean, error)
            bias -= rate * 0.02 * error
            emb[ids] -= rate * 10 * share[:, None] * back[None, :]
    table = emb @ weights
    logits = np.stack([(c / c.sum()) @ table[i] + bias for i, c, _ in (examples[k] for k in held)])
    truth = np.array([examples[k][2] for k in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    probs = np.stack([_softmax(z / temperature) for z in logits])
    top, right = probs.max(1), probs.argmax(1) == truth
    # the smallest threshold above which held-back examples are right at least 99 times in 100
    threshold = next((float(t) for t in np.linspace(0, 0.99, 100) if (top >= t).any() and right[top >= t].mean() >= 0.99), 0.99)
    return LangModel(languages, table.astype(np.float32), bias, float(temperature), threshold)


def identify_language(docs: DataFrame, model: LangModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    A null text, or one without a letter, gives `und` with score 0 (and is rejected). The score is
    the calibrated probability of the predicted language; `rejected` marks scores under the model's
    threshold; of languages with equal probability the first by name wins. Whole texts of any length
    are read, repeated rows give repeated equal results, other columns play no part, and an empty
    table gives an empty result.
    """
    bits = int(np.log2(len(model.table)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            lang, prob = [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not m.languages or text is None or not _LETTER.search(text):
                    lang.append(UNKNOWN)
                    prob.append(0.0)
                    continue
                p = _softmax(_logits(m, text, bits).astype(np.float64) / m.temperature)
                lang.append(m.languages[int(p.argmax())])
                prob.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(prob, pa.float64()), pa.array([p < m.threshold or x == UNKNOWN for p, x in zip(prob, lang, strict=True)], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
