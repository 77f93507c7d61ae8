"""Join helpers: broadcast only behind a size check, with a shuffle join beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Catalyst's size of a leaf that it knows nothing about is above this
UNKNOWN_BYTES = 1 << 60
#: bound on the in-memory bytes of a broadcast side
BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (no job).  For scans it is
    the compressed file size scaled to the projected columns: no upper bound
    on the size in memory."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def input_bytes(df: DataFrame) -> int | None:
    """Sum of Catalyst's sizes of the plan's leaves, None if one is unknown (no
    job).  Unlike :func:`estimated_bytes` it is not multiplied up by joins."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= UNKNOWN_BYTES for s in sizes) else sum(sizes)


def _column_bytes(name: str, dtype: T.DataType) -> Column:
    """In-memory bytes of a column's value: exact payload of strings, binaries
    and arrays of fixed-width values, JSON length of other nested values."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
        return F.lit(24) + F.lit(16) * F.greatest(F.coalesce(F.size(col), F.lit(0)), F.lit(0))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(24) + F.lit(2) * F.coalesce(F.length(F.to_json(F.struct(col))), F.lit(0))
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of ``df``, summed over its rows by one aggregate."""
    row = reduce(lambda a, b: a + b, [_column_bytes(f.name, f.dataType).cast("long") for f in df.schema], F.lit(16).cast("long"))
    return int(df.agg(F.sum(row)).first()[0] or 0)


def broadcastable(df: DataFrame, max_bytes: int = BROADCAST_BYTES, known_rows: int | None = None) -> bool:
    """Is ``df`` proven to be at most ``max_bytes`` in memory?

    A known row count proves it when every column has a fixed width.  Otherwise
    the rows are measured, unless Catalyst's estimate (compressed file size for
    a scan, so it can only rule a side out) is over the bound already.
    """
    fixed = not any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in df.schema)
    if known_rows is not None and fixed:
        return known_rows * 16 * (1 + len(df.columns)) <= max_bytes
    return estimated_bytes(df) <= max_bytes and measured_bytes(df) <= max_bytes


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    known_rows: int | None = None,
    max_bytes: int = BROADCAST_BYTES,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``big`` to ``small``, broadcasting ``small`` only if
    :func:`broadcastable` proves its size.

    Otherwise the join is left to the planner: a shuffle join, which AQE may
    still turn into a broadcast from runtime sizes or split for skewed keys.
    ``null_safe`` lets NULL keys match each other.
    """
    keys = [on] if isinstance(on, str) else list(on)
    side = F.broadcast(small) if broadcastable(small, max_bytes, known_rows) else small
    return join_null_safe(big, side, keys, how) if null_safe else big.join(side, on=keys, how=how)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; key columns come from ``left``."""
    named = right.select(*[F.col(f"`{c}`").alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def duplicate_keys(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Fan-out audit (J7): keys that occur more than once, with their count."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
