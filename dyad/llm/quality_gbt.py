"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text are computed once, in Arrow batches.  The
trees are fitted with logistic loss on at most ``max_train`` labelled documents
(the bounded, documented part), as histogram trees of fixed depth with
monotonic constraints: a split on a constrained feature must order its two
sides, and the bounds are passed down, so the score can never rise with, say,
more symbols.  The forest is flattened into numpy node arrays (complete binary
trees), and a batch walks all trees level by level without a branch per row.

Null texts have zero statistics and fail the base rule (under 50 words), as do
empty ones.  Repeated rows get equal verdicts.  Without labels of both kinds
the verdict of the trees is "keep".  Columns of the input other than the ones
read are ignored or, in :func:`append_verdict`, passed through."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.llm.common import append_columns, text_slices

MIN_WORDS = 50
MAX_TRAIN = 20_000
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS, L2, MIN_CHILD = 60, 3, 0.2, 64, 1.0, 2.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines",
          "n_distinct")
#: feature of the trees -> sign of its constraint (-1: the score never rises with it, 0: free)
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
            "digit_share": -1, "mark_share": -1, "line_words": 0, "distinct_share": 0}

_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b"!?.,;:"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 21:  # a window's number would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * v + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(window)] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of a text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text) - int(by[list(_SPACE)].sum())
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), chars, int(by[list(b"#*$%&|<>")].sum()), dup, repeat_words(words), int(by[65:91].sum()),
            int(by[48:58].sum()), int(by[list(_MARKS)].sum()), lines, len(set(words)))


def features(counts: np.ndarray) -> np.ndarray:
    """The trees' ``FEATURES`` from rows of ``COUNTS``."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    per = lambda x, y: c[x] / np.maximum(c[y], 1)
    return np.stack([np.log1p(c["n_words"]), per("word_chars", "n_words"), per("n_symbols", "word_chars"), per("n_dup_lines", "n_lines"),
                     per("n_repeat_words", "n_words"), per("n_upper", "word_chars"), per("n_digits", "word_chars"),
                     per("n_marks", "word_chars"), per("n_words", "n_lines"), per("n_distinct", "n_words")], axis=1)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Histogram gradient boosting with logistic loss and monotonic constraints."""
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 30.0 if not len(y) or y[0] else -30.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    mean = y.mean()
    raw = np.full(len(y), base := float(np.log(mean / (1 - mean))))
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(binned, edges, y - p, p * (1 - p), signs, depth, rate)
        raw += tree[3]
        out.append(tree[:3])
    return Forest(*(np.stack(a) for a in zip(*out)), base)


def _grow(binned, edges, grad, hess, signs, depth, rate):
    inner = 2**depth - 1
    feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    added = np.zeros(len(grad))
    todo = [(0, np.arange(len(grad)), -np.inf, np.inf)]
    while todo:
        node, rows, low, high = todo.pop()
        own = float(np.clip(grad[rows].sum() / (hess[rows].sum() + L2), low, high))
        if node >= inner:
            value[node - inner] = rate * own
            added[rows] = rate * own
            continue
        best = _best_split(binned, edges, grad, hess, rows, signs, low, high)
        if best is None:  # everything goes left; the leaf below has the value
            todo.append((2 * node + 1, rows, own, own))
            continue
        f, b, left, right = best
        feature[node], threshold[node] = f, edges[f][b]
        go = binned[rows, f] > b
        middle = (left + right) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[f], ((low, high), (low, high)))
        todo.append((2 * node + 1, rows[~go], *bounds[0]))
        todo.append((2 * node + 2, rows[go], *bounds[1]))
    return feature, threshold, value, added


def _best_split(binned, edges, grad, hess, rows, signs, low, high):
    """``(feature, bin, left value, right value)`` of the best allowed split, or None."""
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    gain_of = lambda g, h, v: 2 * g * v - (h + L2) * v * v
    parent = gain_of(g_all, h_all, np.clip(g_all / (h_all + L2), low, high))
    best, most = None, 1e-6
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        g = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(edge) + 1))[:-1]
        h = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(edge) + 1))[:-1]
        left = np.clip(g / (h + L2), low, high)
        right = np.clip((g_all - g) / (h_all - h + L2), low, high)
        gain = gain_of(g, h, left) + gain_of(g_all - g, h_all - h, right) - parent
        bad = (h < MIN_CHILD) | (h_all - h < MIN_CHILD)
        if signs[f]:
            bad |= (right - left) * signs[f] < 0
        gain[bad] = -1
        b = int(gain.argmax())
        if gain[b] > most:
            best, most = (f, b, left[b], right[b]), gain[b]
    return best


def append_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus the longs ``COUNTS`` (columns of these names are replaced)."""

    def run(columns: list[pa.Array]) -> list:
        rows = [text_counts(t) for _, texts in text_slices(columns[0]) for t in texts]
        made = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
        return [pa.array(c) for c in made.T]

    return append_columns(docs, ["text"], run, [(c, T.LongType()) for c in COUNTS])


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Forest for ``labels.quality`` (0/1), fitted on the ``max_train`` labelled
    documents whose ids have the smallest hashes."""
    chosen = (labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train rows
    rows = (append_counts(texts).drop("text").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(max_train).toPandas())
    counts = rows[list(COUNTS)].to_numpy(np.float64).reshape(len(rows), len(COUNTS))
    return fit(features(counts), rows.quality.to_numpy(np.float64), tuple(FEATURES.values()))


def append_verdict(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (columns passed through) plus ``COUNTS``, ``quality_score``,
    ``base_failed`` and ``kept``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(columns: list[pa.Array]) -> list:
        rows = [text_counts(t) for _, texts in text_slices(columns[0]) for t in texts]
        made = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
        return [*(pa.array(c) for c in made.T), pa.array(shared.value.score(features(made)))]

    fields = [(c, T.LongType()) for c in COUNTS] + [("quality_score", T.DoubleType())]
    scored = append_columns(docs, ["text"], run, fields)
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold))


def append_kept(docs: DataFrame, forest: Forest, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (columns passed through) plus the boolean ``name``: base rule passed and score high enough."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(columns: list[pa.Array]) -> list:
        rows = [text_counts(t) for _, texts in text_slices(columns[0]) for t in texts]
        made = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
        n_words, repeated = made[:, COUNTS.index("n_words")], made[:, COUNTS.index("n_repeat_words")]
        failed = (n_words < MIN_WORDS) | (100 * repeated > 50 * n_words)
        return [pa.array(~failed & (shared.value.score(features(made)) >= threshold))]

    return append_columns(docs, ["text"], run, [(name, T.BooleanType())])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``quality_score`` of every row of ``docs``."""
    scored = append_verdict(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", *COUNTS[:5], "base_failed", "kept", "quality_score")
