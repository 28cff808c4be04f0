"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, schema_of, slices
from tidemark.llm.langid import held_out

SAMPLE = 4000  # labelled documents that the model is fitted on, at most
SAMPLE_CHARS = 20_000  # longer documents are not fitted on, so the sample is bounded; all are scored
FEATURES = 20_000  # words and stems of the model, at most
LEAST_DOCS = 3  # documents of the sample that a feature occurs in, at least
STEM = 5  # leading letters of a word that are a feature of their own
EPOCHS = 150
RATE = 0.1
SHRINK = 2e-3
BIAS = -5.0
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"\w+")
TOXIC_SENTENCE = 0.5


def words_of(sentence: str) -> list[str]:
    return WORD.findall(sentence.lower())


def features_of(word: str) -> tuple[str, ...]:
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


@dataclass
class Model:
    """Weights of words and stems; a sentence's score is the logistic of their sum and the bias."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self._cache: dict[str, float] = {}

    def _word(self, word: str) -> float:
        found = self._cache.get(word)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features_of(word))
            if len(self._cache) > 500_000:
                self._cache.clear()
            self._cache[word] = found
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence that has a word."""
        spans, logits = [], []
        for match in SENTENCE.finditer(text):
            words = words_of(match[0])
            if words:
                spans.append(match.span())
                logits.append(self.bias + sum(map(self._word, words)))
        scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) if logits else []
        return [(a, b, float(s)) for (a, b), s in zip(spans, scores, strict=True)]


def noisy_or(scores: np.ndarray) -> float:
    """The chance that at least one sentence is toxic; 0 without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def fit(documents: list[str], labels: list[int]) -> Model:
    """Noisy-or over sentence scores, fitted to document labels by full-batch gradient steps.

    The gradient of the log likelihood at a sentence's logit is -s for a clean document and
    s (1 - p) / p for a toxic one, p being the noisy-or. Without both labels the score is constant.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, 30.0 if len(y) and y.min() == 1 else -30.0)
    split = [[words_of(m[0]) for m in SENTENCE.finditer(d)] for d in documents]
    split = [[s for s in sentences if s] for sentences in split]
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for label, sentences in zip(labels, split, strict=True):
        counts[int(label)].update({f for s in sentences for w in s for f in features_of(w)})
    n = (len(y) - y.sum(), y.sum())

    def telling(feature: str) -> float:
        """Distance of the shares of toxic and clean documents in standard errors."""
        a, b = counts[1][feature], counts[0][feature]
        p = (a + b + 1) / (len(y) + 2)
        return abs(a / n[1] - b / n[0]) / (p * (1 - p) * (1 / n[0] + 1 / n[1])) ** 0.5

    seen = [f for f in counts[0] | counts[1] if counts[0][f] + counts[1][f] >= LEAST_DOCS]
    score = {f: telling(f) for f in seen}
    # Chance alone keeps few features beyond three standard errors.
    chosen = sorted((f for f in seen if score[f] >= 3), key=lambda f: (-score[f], f))[:FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    ids: list[int] = []
    sentence_of: list[int] = []
    doc_of: list[int] = []
    for d, sentences in enumerate(split):
        for s in sentences:
            own = {index[f] for w in s for f in features_of(w) if f in index}
            ids.extend(own)
            sentence_of.extend([len(doc_of)] * len(own))
            doc_of.append(d)
    feature, sentence, doc = (np.array(x, np.int64) for x in (ids, sentence_of, doc_of))
    w, b = np.zeros(len(chosen)), BIAS
    mean_w, square_w, mean_b, square_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        logit = np.clip(b + np.bincount(sentence, weights=w[feature], minlength=len(doc)), -30, 30)
        s = 1 / (1 + np.exp(-logit))
        p = -np.expm1(np.bincount(doc, weights=np.log1p(-s), minlength=len(y)))
        p = np.clip(p, 1e-9, 1 - 1e-12)
        g = np.where(y[doc] == 1, s * (1 - p[doc]) / p[doc], -s)
        grad_w = np.bincount(feature, weights=g[sentence], minlength=len(w)) / len(y) - SHRINK * w / 10
        grad_b = g.sum() / len(y)
        mean_w, square_w = 0.9 * mean_w + 0.1 * grad_w, 0.999 * square_w + 0.001 * grad_w**2
        mean_b, square_b = 0.9 * mean_b + 0.1 * grad_b, 0.999 * square_b + 0.001 * grad_b**2
        one, two = 1 - 0.9**step, 1 - 0.999**step
        w += RATE * (mean_w / one) / (np.sqrt(square_w / two) + 1e-6)
        b += RATE * (mean_b / one) / (np.sqrt(square_b / two) + 1e-6)
    return Model(dict(zip(chosen, w.tolist(), strict=True)), float(b))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    fold: int = 0,
    sample: int = SAMPLE,
) -> Model:
    """Model from at most ``sample`` labelled documents outside the held-out fold.

    The sample is the rows with the smallest hash of the key, the same in any run. Labels NULL or
    other than 0 and 1 teach nothing; a document labelled twice counts as toxic if any label says so.
    Documents of more than ``SAMPLE_CHARS`` code points are left out of it.
    """
    marks = (
        labels.select(column(key).alias("doc_id"), column(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # ``sample`` rows of two numbers: small by construction.
    rows = docs.select(column(key).alias("doc_id"), column(text).alias("text")).filter(
        F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARS
    )
    found = rows.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(
        F.max("y").alias("y"), F.min("text").alias("text")
    )
    taken = sorted((r["doc_id"], r["y"], r["text"] or "") for r in found.collect())
    return fit([t for _, _, t in taken], [y for _, y, _ in taken])


def with_toxicity(
    docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("_score", "_toxic")
) -> DataFrame:
    """``docs`` with the score and the offending sentences (start, end, score) as the columns ``into``.

    Places count code points. Text NULL, empty or without words: score 0, no sentences. A column of ``docs`` must not
    have one of the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, toxic = [], []
            for value in batch.column(text).to_pylist():
                found = shared.value.sentences(value or "")
                scores.append(noisy_or(np.array([s for _, _, s in found])))
                toxic.append([{"start": a, "end": b, "score": s} for a, b, s in found if s >= TOXIC_SENTENCE])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(toxic, kind)],
                names=[*batch.schema.names, *into],
            )

    kinds = (T.DoubleType(), T.ArrayType(span))
    return docs.mapInArrow(run, schema_of(docs, **dict(zip(into, kinds, strict=True))))


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, sentences), one per row of ``docs``.

    Repeated rows get the same score; an empty table gives no rows.
    """
    model = train(docs, labels, key, text, label)
    rows = docs.select(
        column(key).alias("doc_id"), column(text).alias("text"), held_out(key, 5, 0).alias("held_out")
    )
    scored = with_toxicity(rows, model)
    return scored.select(
        "doc_id", "held_out", F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_toxic").alias("sentences"),
    )
