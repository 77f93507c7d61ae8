"""Header resolution and projections (P1-P7).  Pure driver-side work on
``df.columns``; the resulting ``select`` is what reaches the scan, so column
pruning still applies."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ci_map(columns: Iterable[str]) -> dict[str, str]:
    """Case-insensitive header map: ``lower(strip(name)) -> name``."""
    return {c.strip().lower(): c for c in columns}


def ci_select(df: DataFrame, wanted: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Select ``wanted`` case-insensitively and rename them to ``names`` (P1 + P3).

    A missing header falls back to the wanted spelling itself, so Spark raises
    its own error naming the column, as the pandas original does.
    """
    m = ci_map(df.columns)
    src = [m.get(w.lower(), w) for w in wanted]
    names = list(names or wanted)
    return df.select(*[F.col(f"`{s}`").alias(n) for s, n in zip(src, names)])


def first_header(
    columns: Iterable[str],
    candidates: Sequence[str] = (),
    required: bool = True,
    what: str = "column",
) -> str | None:
    """First header matching an ordered candidate list (P2).  ``KeyError`` when required."""
    cols = list(columns)
    m = ci_map(cols)
    for cand in candidates:
        if cand in m:
            return m[cand]
    if required:
        raise KeyError(f"none of the headers {cols} is a {what}")
    return None


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename to the final schema (P5)."""
    return df.withColumnsRenamed(mapping)


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns starting with ``prefix`` in table order; error if none."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        raise RuntimeError(f"the table has no column that begins with {prefix!r}")
    return cols


def cast_keys(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast join keys before a join."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
