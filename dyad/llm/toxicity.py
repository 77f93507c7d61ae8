"""Toxicity by a classifier chain.

Categories are predicted one after the other; each is a logistic model over the
words of the whole text and the probabilities of the categories before it.  In
training those earlier probabilities are out-of-fold: a document's value comes
from models that did not see it, as at prediction time.

The models are fitted on at most ``max_train`` labelled documents (the bounded
part; the smallest id hashes).  Of the hashed words, ``FEATURES`` per category
with the largest chi-squared statistic over the training rows are used, so the
normal equations stay small.  Scoring is one pass over all texts: a batch's
distinct words are found with Arrow, and a document's score is a sparse sum.

Null texts and others without words have probability 0 in every category; equal texts
get equal results.  A category without labels of both kinds has its constant.
Repeated labels of a document count as one (the largest)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.llm.common import append_columns, slices

#: category -> its SQL over the labels, in the order of the chain
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
BUCKETS = 1 << 18
FEATURES = 400
FOLDS = 5
MAX_TRAIN = 8_000
L2 = 1.0
THRESHOLD = 0.5


@dataclass(frozen=True)
class Link:
    """One category's model: a weight per word bucket and per earlier category."""

    words: np.ndarray  # BUCKETS, float32; zero where not used
    earlier: np.ndarray
    bias: float

    def logit(self, rows: np.ndarray, buckets: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """``rows, buckets``: the distinct word buckets of each text."""
        sums = np.bincount(rows, self.words[buckets], len(earlier))
        return self.bias + sums + earlier @ self.earlier


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of the distinct hashed words (ASCII lower-cased,
    stripped of marks) of every text."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x20\x09-\x0D.,;:!?]+")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    hashed = np.array([xxhash.xxh32_intdigest(w) % BUCKETS if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    bucket = hashed[coded.indices.to_numpy()] if len(hashed) else np.zeros(0, np.int64)
    keep = bucket >= 0
    pairs = np.unique(row[keep] * BUCKETS + bucket[keep])
    return pairs // BUCKETS, pairs % BUCKETS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_link(n: int, rows: np.ndarray, buckets: np.ndarray, earlier: np.ndarray, y: np.ndarray, use: np.ndarray) -> Link:
    """Logistic regression of ``y`` on the rows ``use`` (booleans), by Newton steps."""
    words = np.zeros(BUCKETS, np.float32)
    own = y[use]
    if not len(own) or own.min() == own.max():
        return Link(words, np.zeros(earlier.shape[1]), 30.0 if len(own) and own[0] else -30.0)
    here = use[rows]
    with_word = np.bincount(buckets[here], minlength=BUCKETS).astype(np.float64)
    both = np.bincount(buckets[here], y[rows[here]], BUCKETS)
    expected = with_word * own.mean()
    spread = expected * (1 - own.mean()) * (1 - with_word / len(own))
    chi = np.where(with_word >= 5, (both - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(FEATURES)
    x = np.zeros((n, FEATURES + earlier.shape[1] + 1))
    hit = column[buckets] >= 0
    x[rows[hit], column[buckets[hit]]] = 1
    x[:, FEATURES:-1], x[:, -1] = earlier, 1
    x = x[use]
    penalty = np.full(x.shape[1], L2)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x
        h[np.diag_indices_from(h)] += penalty
        step = np.linalg.solve(h, x.T @ (own - p) - penalty * w)
        w += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    words[chosen] = w[:FEATURES]
    return Link(words, w[FEATURES:-1], float(w[-1]))


def fit_chain(texts: pa.Array, labels: np.ndarray, folds: np.ndarray) -> list[Link]:
    """A link per column of ``labels`` (0/1); later links learn from the
    out-of-fold probabilities of earlier ones."""
    n = len(texts)
    rows, buckets = word_buckets(texts)
    earlier, chain = np.zeros((n, 0)), []
    for y in labels.T:
        chain.append(fit_link(n, rows, buckets, earlier, y, np.ones(n, bool)))
        out = np.zeros(n)
        for fold in np.unique(folds):
            held = folds == fold
            out[held] = sigmoid(fit_link(n, rows, buckets, earlier, y, ~held).logit(rows, buckets, earlier))[held]
        earlier = np.column_stack([earlier, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, max_train: int = MAX_TRAIN) -> list[Link]:
    made = labels.select("doc_id", *[F.expr(sql).cast("double").alias(f"y{i}") for i, sql in enumerate(categories.values())])
    ys = [f"y{i}" for i in range(len(categories))]
    chosen = (made.dropna().groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train rows
            .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)))
            .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_train).toArrow())
    texts = rows.column("text").combine_chunks().cast(pa.string())
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    return fit_chain(texts, np.stack([rows.column(y).to_numpy() for y in ys], axis=1), rows.column("fold").to_numpy())


def predict(docs: DataFrame, chain: Sequence[Link], names: Sequence[str]) -> DataFrame:
    """``docs`` plus a probability per category (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(list(chain))

    def run(columns: list[pa.Array]) -> list:
        texts = columns[0]
        out = [np.zeros((0, len(names)))]
        for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0))):
            rows, buckets = word_buckets(texts.slice(a, b - a))
            earlier = np.zeros((b - a, 0))
            for link in shared.value:
                earlier = np.column_stack([earlier, sigmoid(link.logit(rows, buckets, earlier))])
            earlier[np.bincount(rows, minlength=b - a) == 0] = 0
            out.append(earlier)
        return [pa.array(c) for c in np.concatenate(out).T.copy()]

    return append_columns(docs, ["text"], run, [(n, T.DoubleType()) for n in names])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_low_quality, p_toxic, toxic`` of every row of ``docs``."""
    names = [f"p_{c}" for c in CATEGORIES]
    scored = predict(docs.select("doc_id", "text"), train(docs, labels), names)
    return scored.select("doc_id", *names, (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
