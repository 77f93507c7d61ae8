"""A scoring pipeline that is fitted, saved, loaded and applied as one.

It holds everything that a new row needs: the levels of the category (M8), the
mean of every numeric feature (M3), the clip bounds of the response (M4), the
linear model and the input width.  It is saved as one JSON document, numbers
exactly, in a folder that any reader of Spark can open.

Features of a row, in order: the vector, the numeric columns, the one-hot of the
category.  A null or non-finite component or number becomes its training mean, a
null vector the mean vector; a null category is the level ``unknown``, a level that
was not trained gives zeros.  Responses are clipped to their training quantiles
before the fit, and predictions are clipped alike.  A vector of another width than
the trained one is refused: an error, not a score.  Training rows without a
response, or with a vector of another width than the first, are not accepted
either: the former are left out, the latter are an error."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.functions.strings import UNKNOWN
from dyad.operators.clean import clip
from dyad.operators.order import global_quantiles
from dyad.operators.regression import SHIFT_ROWS, products
from dyad.session import cut_lineage, scratch

MAX_LEVELS = 1024


@dataclass(frozen=True)
class ScoringPipeline:
    vector: str
    numbers: list[str]
    category: str | None
    levels: list[str]
    width: int
    vector_means: list[float]
    number_means: list[float]
    low: float
    high: float
    intercept: float | None
    coefficients: list[float]

    def inputs(self, df: DataFrame) -> list[Column]:
        """The columns that :meth:`matrix` takes: the vector, the numbers and the level of the category."""
        inner = df.schema[self.vector].dataType.elementType
        vector = F.col(self.vector) if isinstance(inner, (T.FloatType, T.DoubleType)) else F.col(self.vector).cast("array<double>")
        level = [] if self.category is None else [F.coalesce(F.col(self.category).cast("string"), F.lit(UNKNOWN))]
        return [vector, *[F.col(c).cast("double") for c in self.numbers], *level]

    def matrix(self, columns: list[pa.Array]) -> np.ndarray:
        """The features of some rows; a vector of another width is an error."""
        vectors, size = columns[0], columns[0].value_lengths().fill_null(-1).to_numpy()
        wrong = size[(size != self.width) & (size >= 0)]
        if len(wrong):
            raise ValueError(f"vectors of {self.width} components expected, one has {wrong[0]}")
        out = np.zeros((len(size), self.width + len(self.numbers) + len(self.levels)))
        out[:, : self.width] = np.nan
        out[size >= 0, : self.width] = _floats(vectors.drop_null().flatten()).reshape(-1, self.width)
        for i in range(len(self.numbers)):
            out[:, self.width + i] = _floats(columns[1 + i])
        means = np.array(self.vector_means + self.number_means)
        plain = out[:, : len(means)]
        row, at = np.nonzero(~np.isfinite(plain))
        plain[row, at] = means[at]
        if self.category is not None:
            code = pc.index_in(columns[-1], pa.array(self.levels, columns[-1].type)).fill_null(-1).to_numpy()
            known = np.flatnonzero(code >= 0)
            out[known, len(means) + code[known]] = 1.0
        return out

    def score(self, df: DataFrame, out: str = "prediction", keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` (default: all) columns of ``df`` with the prediction ``out``."""
        kept = list(df.columns if keep is None else keep)
        if out in kept:
            raise ValueError(f"column {out} is there already")
        wide = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"_input{i}") for i, c in enumerate(self.inputs(df))])
        schema = T.StructType([*wide.schema.fields[: len(kept)], T.StructField(out, T.DoubleType())])
        coefficients = np.array(self.coefficients)

        def run(batches):
            for batch in batches:
                x = self.matrix(batch.columns[len(kept) :])
                # row by row: a matrix product's last bits depend on the batch
                made = pa.nulls(len(x), pa.float64()) if self.intercept is None else pa.array(self.intercept + np.einsum("ij,j->i", x, coefficients))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], names=schema.names)

        return wide.mapInArrow(run, schema).withColumn(out, clip(out, self.low, self.high))

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "document string").coalesce(1).write.mode(mode).text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringPipeline:
        row = spark.read.text(path, wholetext=True).filter("value <> ''").first()
        if row is None:
            raise ValueError(f"{path} holds no pipeline")
        return cls(**json.loads(row.value))


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _means(df: DataFrame, columns: Sequence[Column]) -> list[float]:
    finite = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) for c in columns]
    row = df.agg(F.lit(0), *[F.avg(c) for c in finite]).first()
    return [0.0 if v is None else float(v) for v in row[1:]]


def _vector_means(vectors: DataFrame, width: int) -> list[float]:
    """Mean finite component by place, of the one column of vectors; a vector of another width is an error."""

    def add_up(batches):
        total, seen = np.zeros(width), np.zeros(width, np.int64)
        for batch in batches:
            size = batch.column(0).value_lengths().fill_null(-1).to_numpy()
            if ((size != width) & (size >= 0)).any():
                # told by a row, so that the driver raises it
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([0])], names=["at", "total", "seen"])
                return
            v = _floats(batch.column(0).drop_null().flatten()).reshape(-1, width)
            finite = np.isfinite(v)
            total += np.where(finite, v, 0).sum(0)
            seen += finite.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total), pa.array(seen)], names=["at", "total", "seen"])

    found = vectors.mapInArrow(add_up, "at int, total double, seen long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")).collect()
    if any(r["at"] < 0 for r in found):
        raise ValueError(f"vectors of {width} components expected, some have another width")
    by_place = {r["at"]: r["total"] / r["seen"] if r["seen"] else 0.0 for r in found}
    return [by_place.get(i, 0.0) for i in range(width)]


def fit_pipeline(train: DataFrame, vector: str, label: str, numbers: Sequence[str] = (), category: str | None = None, l2: float = 0.0,
                 low: float = 0.005, high: float = 0.995, stored: bool = False) -> ScoringPipeline:
    """Fit on the rows of ``train`` that have a response; a feature without any value gets the mean 0.

    ``train`` is read several times, so it is written first, with its vectors;
    not if it is ``stored``: a table, or one that is joined to broadcast ones."""
    with scratch():
        used = [vector, *numbers, *([category] if category else []), label]
        rows = train.select(*used).filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
        rows = rows if stored else cut_lineage(rows)
        first = rows.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        if first is None:
            raise ValueError("no row with a response and a vector to fit")
        draft = ScoringPipeline(vector, list(numbers), category, [], first.n, [], [], None, None, 0.0, [])
        given = draft.inputs(rows)
        means = _vector_means(rows.select(given[0]), first.n)
        levels: list[str] = []
        if category is not None:
            found = rows.select(given[-1].alias("v")).distinct()
            levels = sorted(r.v for r in found.limit(MAX_LEVELS + 1).collect())
            if len(levels) > MAX_LEVELS:
                raise ValueError(f"{category} has more than {MAX_LEVELS} levels")
        bounds = global_quantiles(rows, label, [low, high])
        draft = replace(draft, levels=levels, vector_means=means, number_means=_means(rows, given[1 : 1 + len(numbers)]), low=bounds[0], high=bounds[1])

        def read(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
            made = draft.matrix(columns)
            return made, np.ones(len(made), bool)

        y = clip(F.col(label).cast("double"), *bounds)
        inputs = rows.select(F.lit(0).cast("int").alias("g"), y.alias("y"), *[c.alias(f"_input{i}") for i, c in enumerate(given)])
        some = inputs.limit(SHIFT_ROWS).toArrow()
        model = products(inputs, read, first.n + len(numbers) + len(levels), some, grouped=False)[None].ridge(l2)
        return replace(draft, intercept=model.intercept, coefficients=model.coefficients.tolist())
