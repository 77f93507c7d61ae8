"""Principal components by randomised block iteration (M7).

The covariance of ``p`` features is never formed: a round multiplies the rows by
a ``p x l`` block on the executors (``X'(X Q)``, one pass over the table), and
only ``l x l`` matrices and a panel of columns of bounded size reach the driver.

A round, starting from random columns: ``W = C Q``; eigenvectors of ``Q' W``
turn ``Q`` into approximate components with their variances and residuals; the
next ``Q`` is an orthonormal basis of ``W`` from a tall-skinny QR (each task
reduces its rows to a triangle, the triangles are stacked and reduced again).
Rounds end when every wanted component's residual is below ``TOLERANCE`` of the
largest variance.  Up to ``DIRECT_FEATURES`` features the block is as wide as
the table and one round is exact.

``Q`` lives in a table of one row per feature.  It reaches the tasks in panels of
at most ``PANEL_BYTES``, one pass each.

Rows whose vector is null, or has a null or non-finite component, are left out of
the fit and get null scores.  ``k`` is cut to the features and the rows.
Components have their largest loading (ties: the first) positive.  Of a table
without rows the model has no components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.operators.regression import TASKS_PER_CORE, as_array, whole_rows
from dyad.session import cut_lineage, scratch

DIRECT_FEATURES = 1024
#: columns beyond the wanted ones that a block carries, at least
OVERSAMPLE = 16
PANEL_BYTES = 64 << 20
TOLERANCE = 1e-7
MAX_ROUNDS = 60
_BLOCK = "i int, q array<double>"


@dataclass
class Components:
    """``variances`` (sample variance per component), ``loadings`` (a table of one
    row per feature: ``i, q``), the features' ``mean``, and how the fit ended."""

    mean: np.ndarray
    variances: np.ndarray
    loadings: DataFrame | None = None
    signs: np.ndarray = field(default_factory=lambda: np.ones(0))
    rounds: int = 0
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def k(self) -> int:
        return len(self.variances)

    @property
    def converged(self) -> bool:
        return bool((self.residuals <= TOLERANCE * max(self.variances, default=0.0)).all())

    def variance_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(self.variances)], "component int, variance double")

    def scores(self, df: DataFrame, id_col: str, col: str = "features", out: str = "pcs") -> DataFrame:
        """``id_col, out``: each row's centred vector in the components."""
        typed = as_array(df, col).select(id_col, F.col(col).alias("_x"), F.array().cast("array<double>").alias(out))
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in typed.schema])
        p, mean = len(self.mean), self.mean
        for a, b in _panels(p, self.k):
            block = df.sparkSession.sparkContext.broadcast(_panel(self.loadings, a, b) * self.signs[a:b])
            typed = typed.mapInArrow(_scorer(mean, block, a), schema)
        return typed.select(id_col, out)


def _scorer(mean: np.ndarray, block, done: int) -> Callable:
    def run(batches):
        for batch in batches:
            x, good = whole_rows(batch.column(1), len(mean))
            n = int(good.sum())
            made = (x[good] - mean) @ block.value
            held = batch.column(2).filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(n, done)
            made = np.column_stack([held, made])
            size = np.where(good, made.shape[1], 0)
            stops = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(~good, False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(stops, pa.array(made.ravel()))],
                                             names=batch.schema.names)

    return run


def _panels(p: int, width: int) -> list[tuple[int, int]]:
    step = max(1, PANEL_BYTES // (8 * max(p, 1)))
    return [(a, min(a + step, width)) for a in range(0, width, step)]


def _panel(table: DataFrame, a: int, b: int) -> np.ndarray:
    """Columns ``a`` to ``b`` of a block table, all features."""
    got = table.select("i", F.slice("q", a + 1, b - a).alias("q")).toArrow()
    out = np.empty((got.num_rows, b - a))
    out[got.column("i").to_numpy()] = got.column("q").combine_chunks().flatten().to_numpy().reshape(-1, b - a)
    return out


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _dense(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _few_tasks(df: DataFrame) -> DataFrame:
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def _summed(parts: DataFrame) -> DataFrame:
    """Sum of the vectors ``q`` of each ``i``."""
    return parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("q"))).alias("q"))


def _per_task(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> DataFrame:
    """Rows ``i, q`` of the matrix that ``make`` forms from all rows of a task."""

    def run(batches):
        made = make(batches)
        if made is not None:
            for a in range(0, len(made), 4096):
                part = made[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), _lists(part)], names=["i", "q"])

    return df.mapInArrow(run, _BLOCK)


def _sum_of(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The sum over all rows of the matrices that ``make`` forms from batches, as ``i, q``."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        return total

    return _summed(_per_task(_few_tasks(df), add))


def _small(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], rows: int) -> np.ndarray:
    """:func:`_sum_of` on the driver: only for matrices of the block's width."""
    return _panel(_sum_of(df, make), 0, rows)


def _orthonormal(table: DataFrame, col: str) -> tuple[DataFrame, int]:
    """A block table with an orthonormal basis of the columns of ``table[col]``, and its width."""
    def triangle(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = _dense(batch.column(0))
                held = np.linalg.qr(rows if held is None else np.concatenate([held, rows]), mode="r")
        return held

    stacked = None
    for r in _per_task(_few_tasks(table.select(col)), triangle).select("q").toLocalIterator():
        stacked = [r.q] if stacked is None else [*stacked, r.q]
        if len(stacked) >= 4 * len(r.q):
            stacked = np.linalg.qr(np.array(stacked), mode="r").tolist()
    _, size, right = np.linalg.svd(np.array(stacked), full_matrices=False)
    keep = size > 1e-10 * size[0]
    turn = right[keep].T / size[keep]
    return _turned(table.select("i", F.col(col).alias("q")), turn), int(keep.sum())


def _turned(table: DataFrame, turn: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_dense(batch.column(1)) @ turn)], names=["i", "q"])

    return table.mapInArrow(run, _BLOCK)


def _times_covariance(rows: DataFrame, q: DataFrame, mean: np.ndarray, n: int, width: int) -> DataFrame:
    """``i, q, w``: the block and its product with the covariance, a pass over the rows per panel."""
    p = len(mean)
    out = q
    for at, (a, b) in enumerate(_panels(p, width)):
        block = rows.sparkSession.sparkContext.broadcast(_panel(q, a, b))

        def multiply(batch: pa.RecordBatch, block=block) -> np.ndarray:
            x, good = whole_rows(batch.column(0), p)
            x[good] -= mean
            return x.T @ (x @ block.value) / max(n - 1, 1)

        out = out.join(_sum_of(rows, multiply).withColumnRenamed("q", f"_w{at}"), "i")
    parts = [c for c in out.columns if c.startswith("_w")]
    return cut_lineage(out.select("i", "q", F.concat(*parts).alias("w")))


def _ritz(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, directions within the block and residuals, largest first."""

    def products(batch: pa.RecordBatch) -> np.ndarray:
        q, w = _dense(batch.column(0)), _dense(batch.column(1))
        return np.concatenate([q.T @ w, w.T @ w])

    both = _small(state.select("q", "w"), products, width)
    inner, outer = both[:width], both[width:]
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-value, kind="stable")
    value, vector = value[order], vector[:, order]
    residual = np.sqrt(np.maximum(0, (vector * (outer @ vector)).sum(0) - value * value))
    return np.maximum(value, 0), vector, residual


def fit(vectors: DataFrame, k: int, col: str = "features", seed: int = 0) -> Components:
    """The ``k`` principal components of the vectors in ``col`` (an array or an
    MLlib vector).  The enclosing scope owns the table ``loadings``."""
    spark = vectors.sparkSession
    with scratch() as own:
        rows = cut_lineage(as_array(vectors, col).select(F.col(col).alias("x")).filter(F.col("x").isNotNull()))
        first = rows.select(F.size("x").alias("p")).first()
        if first is None:
            return Components(np.zeros(0), np.zeros(0))
        p = first.p

        def column_sums(batch: pa.RecordBatch) -> np.ndarray:
            x, good = whole_rows(batch.column(0), p)
            return np.append(good.sum(), x.sum(0))[:, None]

        sums = _small(rows, column_sums, 1)[:, 0]
        n = int(sums[0])
        if not n:
            return Components(np.zeros(p), np.zeros(0))
        mean = sums[1:] / n
        k = max(1, min(k, p, n))
        width = p if p <= DIRECT_FEATURES else min(p, n, max(2 * k, k + OVERSAMPLE))

        def start(batches):
            for batch in batches:
                at = batch.column(0).to_numpy()
                made = [np.eye(1, p, i)[0] if width == p else np.random.default_rng([seed, i]).standard_normal(width) for i in at.tolist()]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _lists(np.array(made))], names=["i", "q"])

        q = cut_lineage(spark.range(p).mapInArrow(start, _BLOCK))
        if width < p:
            q, width = _orthonormal(q, "q")
            q = cut_lineage(q)
        for turn in range(1, MAX_ROUNDS + 1):
            state = _times_covariance(rows, q, mean, n, width)
            value, vector, residual = _ritz(state, width)
            wanted = min(k, width)
            if width == p or (residual[:wanted] <= TOLERANCE * value[0]).all() or turn == MAX_ROUNDS or value[0] == 0:
                break
            q, width = _orthonormal(state, "w")
            q = cut_lineage(q)
        loadings = own.keep(cut_lineage(_turned(state.select("i", "q"), vector[:, :wanted])))

        def largest(batches):
            best = np.zeros((wanted, 3))  # |loading|, loading, -feature
            for batch in batches:
                if batch.num_rows:
                    order = np.argsort(batch.column(0).to_numpy())
                    x = _dense(batch.column(1))[order]
                    at = np.abs(x).argmax(0)
                    own_best = np.column_stack([np.abs(x).max(0), x[at, np.arange(wanted)], -batch.column(0).to_numpy()[order][at]])
                    better = [tuple(a[[0, 2]]) > tuple(b[[0, 2]]) for a, b in zip(own_best, best)]
                    best[better] = own_best[better]
            return best

        signs, best = np.ones(wanted), [(0.0, 0.0)] * wanted
        for r in _per_task(_few_tasks(loadings), largest).toLocalIterator():
            if (r.q[0], r.q[2]) > best[r.i]:
                best[r.i], signs[r.i] = (r.q[0], r.q[2]), -1.0 if r.q[1] < 0 else 1.0
        return Components(mean, value[:wanted], loadings, signs, turn, residual[:wanted] if width < p else np.zeros(wanted))


def pca_scores(vectors: DataFrame, k: int, id_col: str, col: str = "features", out: str = "pcs") -> DataFrame:
    """M7: ``id_col, out``, the principal-component scores of every row."""
    return fit(vectors, k, col).scores(vectors, id_col, col, out)
