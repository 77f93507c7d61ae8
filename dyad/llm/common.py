"""Shared helpers of the document operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.session import cut_lineage

#: columns of the ``documents`` table
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: a word is a run of anything but these (space, tab to carriage return): what ``bytes.split()`` splits on
WORD = r"[^\x20\x09-\x0D]+"
#: text handled at once inside one Arrow batch
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; none for null."""
    return [] if text is None else text.encode().split()


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (one row may be larger)."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """``(offset, texts)`` of bounded size, so that work space does not grow with the Arrow batch."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    for a, b in slices(sizes, limit):
        yield a, column.slice(a, b - a).to_pylist()


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fn: Callable[[list[pa.Array]], list],
    fields: Sequence[tuple[str, T.DataType]],
) -> DataFrame:
    """All columns of ``df`` as they are, plus the ``fields`` that ``fn`` makes
    from the Arrow arrays of ``inputs``.  Columns of ``df`` that have the name
    of a field are replaced."""
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names]
    extra = [c for c in inputs if c not in kept]
    if extra:
        raise ValueError(f"columns {extra} are both read and replaced")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    types = [arrow_type(t) for _, t in fields]

    def run(batches):
        for batch in batches:
            made = fn([batch.column(batch.schema.get_field_index(c)) for c in inputs])
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=batch.schema.names + names)

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows equal in ``key``, from batches
    sorted by it: the last group of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start = last_start(batch, key)
        if start == 0 and held and not _same(held[-1], batch, key):
            yield pa.Table.from_batches(held)
            held = [batch]
        elif start == 0:
            held.append(batch)
        else:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def last_start(batch: pa.RecordBatch, key: Sequence[str]) -> int:
    """First row of the batch's last group."""
    change = np.zeros(batch.num_rows, bool)
    for k in key:
        v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(change)
    return int(at[-1]) if len(at) else 0


def _same(a: pa.RecordBatch, b: pa.RecordBatch, key: Sequence[str]) -> bool:
    return all(a.column(a.schema.get_field_index(k))[-1] == b.column(b.schema.get_field_index(k))[0] for k in key)


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """First rows of the groups of sorted columns."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def row_bucket(df: DataFrame, group: Sequence[str], rows_per_bucket: int = 100_000) -> tuple[DataFrame, int]:
    """Gapless numbers without a window over a whole group, step one: a
    ``_bucket`` per row by a hash, so many that a (group, bucket) has about
    ``rows_per_bucket`` rows."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets)).cast("int")), n


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the long ``name``: 0, 1, ... without gaps in each group.

    Rows of a group are spread over hash buckets; a window numbers the rows of
    one bucket, and the sizes of earlier buckets (a small table, one row per
    group and bucket) are added.  Within a bucket the number follows ``order``."""
    from pyspark.sql import Window

    spread, _ = row_bucket(df, group)
    counts = spread.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbers = spread.withColumn("_at", F.row_number().over(inside) - 1)
    joined = numbers.join(starts, [*group, "_bucket"])
    return joined.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at", "_bucket")


__all__ = ["cut_lineage"]
