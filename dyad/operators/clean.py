"""Response-table cleaning: replicate collapse (A1), winsorising (M4),
entity canonicalisation once per distinct value (P22/J6) and the two cleaning
modes of the reference (median + winsorise, or strict)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.operators.order import HOT_GROUP_ROWS, global_quantiles, group_quantiles

#: grouping keys of the replicate collapse, in the reference's order
REPLICATE_KEYS = ("cell_id", "drug_id", "drug_name", "smiles", "tissue", "dataset")


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` drops rows with a NULL in any key; Spark keeps them (Q1)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


def replicate_median(
    df: DataFrame,
    keys: Sequence[str] = REPLICATE_KEYS,
    value: str = "ln_ic50",
    count_col: str | None = "n",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Median of ``value`` per key group, NULL keys dropped first (A1).

    Exact (linear interpolation).  A group larger than ``hot_rows`` is computed
    on the distributed path instead of inside one aggregate buffer.
    """
    keys = list(keys)
    base = drop_null_keys(df.filter(F.col(value).isNotNull()), keys)
    return group_quantiles(base, keys, value, [0.5], names=[value], count_col=count_col, hot_rows=hot_rows)


def clip(c: Column | str, lo: float | None, hi: float | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def winsorize(df: DataFrame, value: str = "ln_ic50", lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Clip ``value`` to its global ``lo``/``hi`` quantiles (M4, bounds global, Q4).

    The bounds are two scalars computed by a distributed exact quantile job and
    inlined as literals, so the clip itself is a plain projection.
    """
    q_lo, q_hi = global_quantiles(df, value, [lo, hi])
    return df.withColumn(value, clip(value, q_lo, q_hi))


def map_distinct(
    df: DataFrame,
    col: str,
    out: str,
    expr: Callable[[Column], Column] | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = None,
    fill: str | None = "",
) -> DataFrame:
    """Compute a function once per distinct value of ``col`` and join it back.

    Give either ``expr`` (Column -> Column) or ``stage`` (a DataFrame stage, e.g.
    a pandas UDF, mapping the one-column distinct frame to ``col, out``).  NULL
    input is filled with ``fill`` first, as the reference's ``fillna("")``.
    """
    src = df.withColumn(col, F.coalesce(F.col(col), F.lit(fill))) if fill is not None else df
    distinct = src.select(col).distinct()
    mapped = stage(distinct) if stage is not None else distinct.withColumn(out, expr(F.col(col)))
    # One row per distinct value: AQE broadcasts it when small, else a shuffle join.
    return src.join(mapped.select(col, out), on=col, how="left")


def canonicalise(df: DataFrame, col: str, fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Canonical entity string, failure -> NULL -> '' (P22), via :func:`map_distinct`."""
    from dyad.functions.strings import default_canonical

    fn = fn or default_canonical
    out = map_distinct(df, col, "_canon", expr=fn)
    return out.withColumn(col, F.coalesce(F.col("_canon"), F.lit(""))).drop("_canon")


def strict_clean(df: DataFrame, value: str = "ln_ic50", key_cols: Sequence[str] = ("smiles",)) -> DataFrame:
    """The older cleaning path (Q19): drop NULL response and NULL structure,
    no replicate median, no winsorising."""
    return df.dropna(subset=[value, *key_cols])
