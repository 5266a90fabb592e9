"""A regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.llm.stats import counts
from idmatch.llm.words import Texts, schema, slices, typed
from idmatch.session import durable

FEATURES = ("size", "word_length", "symbols", "upper", "digits", "punct", "bangs", "dup_lines", "repeats", "variety", "stuck", "short", "lines", "spaces")
#: Share of the pooled covariance in each class covariance, and of its diagonal in the pooled one.
POOLED, DIAGONAL = 0.2, 0.05


#: What a short text's shares are drawn towards, with the weight of so many characters or words.
TYPICAL, WEIGHT = {"upper": 0.03, "punct": 0.04, "short": 0.45}, 30


def features(texts: Texts) -> np.ndarray:
    """One row per text: counts as logarithms, shares as square roots, so that tails are short.

    Shares of short texts say little: each share counts ``WEIGHT`` characters or words of typical text besides its own.
    """
    c = {k: v.astype(float) for k, v in counts(texts).items()}
    words = np.maximum(c["n_words"], 1)
    share = lambda name, of, typical=0.0: np.sqrt((c[name] + WEIGHT * typical) / (c[of] + WEIGHT))
    return np.column_stack([
        np.log1p(c["n_words"]), np.log1p((c["word_chars"] + 5 * WEIGHT) / (c["n_words"] + WEIGHT)), share("n_symbols", "word_chars"),
        share("n_upper", "word_chars", TYPICAL["upper"]), share("n_digits", "word_chars"), share("n_punct", "word_chars", TYPICAL["punct"]),
        share("n_bangs", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
        np.log1p(c["n_distinct"]) / np.log1p(words + 1), share("n_stuck", "n_words"), share("n_short", "n_words", TYPICAL["short"]),
        np.log1p(c["n_lines"] / words), np.log1p((c["n_chars_all"] - c["word_chars"]) / words),
    ])


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, one column for each of ``FEATURES``) of every whole text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], ["doc_id", *FEATURES])

    return typed(docs, doc_id="long", text="string").mapInArrow(run, schema(doc_id="long", **{f: "double" for f in FEATURES}))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunken covariances, their log-determinants and log priors."""

    mean: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        density = np.column_stack([b - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, b in zip(self.mean, self.whiten, self.offset, strict=True)])
        return 1.0 / (1.0 + np.exp(np.clip(density[:, 0] - density[:, 1], -700, 700)))


def fit(rows: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Fits on (label, features). All sums are taken in Spark; the driver gets one row for each of two classes.

    A class without rows takes the moments of all rows, and priors are smoothed by one row a class, so a score is defined
    for any training set; without rows at all every score is 1/2. Labels other than 0 and 1 do not count.
    """
    d = len(FEATURES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    found = rows.filter("label IN (0, 1)").groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("s"),
        F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in upper]).alias("ss")).collect()
    n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in found:
        n[r.label], total[r.label] = r.n, r.s
        for (i, j), v in zip(upper, r.ss, strict=True):
            square[r.label, i, j] = square[r.label, j, i] = v
    everything = total.sum(0) / max(n.sum(), 1)
    mean = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], everything)
    within = np.array([square[c] / max(n[c], 1) - np.outer(mean[c], mean[c]) if n[c] else np.zeros((d, d)) for c in (0, 1)])
    base = (within * n[:, None, None]).sum(0) / max(n.sum(), 1)
    base = (1 - diagonal) * base + diagonal * np.diag(np.diag(base)) + 1e-4 * np.eye(d)
    whiten, offset = [], []
    for c in (0, 1):
        weight = min(1.0, pooled + d / (d + n[c]) * (1 - pooled))
        factor = np.linalg.cholesky((1 - weight) * within[c] + weight * base)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.array(whiten), np.array(offset))


def score(found: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of feature rows."""

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return found.mapInArrow(run, schema(doc_id="long", score="double"))


def classify(docs: DataFrame, labels: DataFrame, train: str = "true") -> DataFrame:
    """(doc_id, score, predicted) of every document, learnt from the labelled documents for which ``train`` holds.

    ``labels`` has doc_id and label. Labels that are null, belong to no document or contradict each other for one document
    are so many rows, none, or one row each. Repeated documents each get a row; an empty table gives no rows.
    """
    found = durable(document_features(docs))
    known = typed(labels, doc_id="long", label="int").filter(train)
    model = fit(found.join(known, "doc_id"))
    return score(found, model).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, train: str = "true") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier takes for label 1. Texts are read twice, once to
    fit and once to filter, and never shuffled."""
    known = typed(labels, doc_id="long", label="int").filter(train)
    model = fit(document_features(docs).join(known, "doc_id"))

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                yield part.filter(pa.array(model.score(features(texts)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
