"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of whole texts per language inside each task (a
sparse table of at most languages x buckets per task leaves it) and sums them
in Spark; the log-probability matrix (languages x ``BUCKETS`` floats) is
broadcast and batches of texts are scored as sparse count rows in numpy.

A text that is null or has no letter is ``und`` with score 0, as is any text
when nothing could be learned.  The score is the posterior probability of the
predicted language; equal posteriors go to the language that sorts first.  A
row with a null ``doc_id`` or ``lang`` is predicted but never learned from;
repeated rows count as often as they occur."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.llm.common import append_columns, text_slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
ALPHA = 0.1
UNKNOWN = "und"
#: the model goes through the driver and to every task: languages x BUCKETS x 4 bytes
MAX_LANGUAGES = 512
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass(frozen=True)
class NaiveBayes:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x BUCKETS
    log_prior: np.ndarray


def ngram_ids(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order, the buckets of the n-grams that start at each character of
    the joined lower-cased texts; and where each text starts (and the end)."""
    lowered = [t.lower() for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=starts[1:])
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out, mixed = [], np.zeros(len(chars), np.uint32)
    for n in ORDERS:
        mixed = mixed[: max(len(chars) - n + 1, 0)] * np.uint32(_MULTIPLIERS[1]) + chars[n - 1 :] * np.uint32(_MULTIPLIERS[0])
        out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(_MULTIPLIERS[2])) >> shift)
    return out, starts


def counts_of(ids: list[np.ndarray], start: int, end: int) -> np.ndarray:
    """Bucket counts of one text's n-grams."""
    own = [x[start : max(end - n + 1, start)] for n, x in zip(ORDERS, ids)]
    return np.bincount(np.concatenate(own), minlength=BUCKETS)


def train(docs: DataFrame) -> NaiveBayes:
    """Fit on every row of ``docs`` (``text``, ``lang``) with both not null."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, texts in text_slices(batch.column(0)):
                ids, starts = ngram_ids(texts)
                for k in range(len(texts)):
                    total = totals.setdefault(langs[at + k], np.zeros(BUCKETS + 1, np.int64))
                    total[:BUCKETS] += counts_of(ids, starts[k], starts[k + 1])
                    total[BUCKETS] += 1
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(total[seen])],
                                             names=["lang", "bucket", "n"])

    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    table = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most (languages x (BUCKETS + 1)) rows, whatever the input
    rows = table.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toPandas()
    languages = tuple(sorted(rows.lang.unique()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS + 1))
    row = rows.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    counts[row, rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy()
    grams, texts = counts[:, :-1] + ALPHA, counts[:, -1]
    return NaiveBayes(languages, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32),
                      np.log(texts / texts.sum()) if len(languages) else np.zeros(0))


def score_batch(model: NaiveBayes, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability."""
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
    if not rows or not model.languages:
        return labels, scores
    ids, starts = ngram_ids([texts[i] for i in rows])
    indptr, indices, counts = np.zeros(len(rows), np.int64), [], []
    size = 0
    for k in range(len(rows)):  # sparse rows: bucket, count
        dense = counts_of(ids, starts[k], starts[k + 1])
        at = np.flatnonzero(dense)
        indptr[k] = size
        size += len(at)
        indices.append(at)
        counts.append(dense[at])
    columns, weights = np.concatenate(indices), np.concatenate(counts).astype(np.float64)
    total = np.stack([np.add.reduceat(p[columns] * weights, indptr) for p in model.log_prob]) + model.log_prior[:, None]
    best = total.argmax(0)
    posterior = 1 / np.exp(total - total.max(0)).sum(0)
    for k, i in enumerate(rows):
        labels[i] = model.languages[best[k]]
        scores[i] = posterior[k]
    return labels, scores


def predict(docs: DataFrame, model: NaiveBayes, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its score (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array]) -> list:
        labels, scores = [], []
        for _, texts in text_slices(columns[0]):
            a, b = score_batch(shared.value, texts)
            labels += a
            scores.append(b)
        return [labels, pa.array(np.concatenate(scores) if scores else np.zeros(0))]

    return append_columns(docs, ["text"], run, [(label, T.StringType()), (score, T.DoubleType())])


def remainder(doc_id: str = "doc_id") -> F.Column:
    """The fold of a document: crc32 of its id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify(docs: DataFrame, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``, learned
    from the rows outside ``fold`` (a null ``doc_id`` is in no fold and not learned from)."""
    model = train(docs.filter(remainder() != fold))
    return predict(docs.select("doc_id", F.coalesce(remainder() == fold, F.lit(False)).alias("held_out"), "text"), model).drop("text")
