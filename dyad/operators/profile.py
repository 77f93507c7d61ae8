"""Profiling aggregates (A2-A14) of the sanity notebook and the build
scripts' printed shapes.  All are partial/final aggregates; exact quartiles
use the distributed order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dyad.operators.order import _names, global_quantiles


def first_by_key(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str,
                 cols: Sequence[str] | None = None) -> DataFrame:
    """A3: one row per key, the first in ``order`` (a declared order, unlike
    ``dropDuplicates``).  ``min_by`` over a struct is merged map-side, so a key
    with many rows is never gathered into one task."""
    keys, order = _names(keys), _names(order)
    cols = [c for c in (cols or df.columns) if c not in keys]
    pick = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def coverage(df: DataFrame, conds: dict[str, object]) -> DataFrame:
    """A10: share of rows meeting each condition (``avg(cond)``)."""
    return df.agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, c in conds.items()])


def distinct_counts(df: DataFrame, cols: Sequence[str], with_rows: bool = False) -> DataFrame:
    """Exact distinct counts (and the row count, A14) in one aggregation."""
    aggs = [F.countDistinct(c).alias(f"n_{c}") for c in cols]
    if with_rows:
        aggs.append(F.count(F.lit(1)).alias("n_rows"))
    return df.agg(*aggs)


def value_counts(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """Most frequent values (count desc, value asc), top ``top``.
    The limit is the feature here: a top-k report."""
    return (
        df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col)).limit(top)
    )


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sd (sample), min, exact quartiles, max -- one row."""
    basic = df.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    # three exact quartiles (distributed), inlined as literals: no join of two one-row frames
    q = global_quantiles(df, col, [0.25, 0.5, 0.75])
    return basic.select("count", "mean", "std", "min", *[F.lit(v).cast("double").alias(n) for v, n in
                                                        zip(q, ["p25", "p50", "p75"])], "max")


def feature_stats(long_df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per-feature count, mean, sample variance, population sd (long form)."""
    return long_df.groupBy(feature).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
        F.stddev_pop(value).alias("sd_pop"),
    )


def observed_counts(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Row count observed while the frame is being written or collected,
    without a second pass (``DataFrame.observe``)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def shape(df: DataFrame) -> tuple[int, int]:
    """``(rows, columns)`` as printed by the build script."""
    return df.count(), len(df.columns)


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2/A4: full-row distinct of the chosen columns."""
    return (df.select(*cols) if cols else df).distinct()
