"""Deterministic group-mean predictor, used wherever a metric needs a
prediction both engines can reproduce: the training mean of the label per
category key, with the global training mean as fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.operators.joins import join_small


def fit_group_mean(train: DataFrame, keys: Sequence[str], label: str = "ln_ic50") -> tuple[DataFrame, float]:
    """Per-key mean table (one row per key) and the global mean."""
    keys = list(keys)
    means = train.groupBy(*keys).agg(F.avg(label).alias("_m"))
    overall = train.agg(F.avg(label)).first()[0]
    return means, overall


def predict_group_mean(df: DataFrame, model: tuple[DataFrame, float], keys: Sequence[str], out: str = "pred") -> DataFrame:
    means, overall = model
    return join_small(df, means, list(keys), how="left").withColumn(
        out, F.coalesce(F.col("_m"), F.lit(overall))
    ).drop("_m")


def out_of_fold_group_mean(df: DataFrame, keys: Sequence[str], fold: str = "fold", label: str = "ln_ic50",
                           out: str = "pred") -> DataFrame:
    """Each row predicted from the other folds only: per-key sums over all
    folds minus the row's own fold (no k-fold replication of the data)."""
    keys = list(keys)
    per_fold = df.groupBy(fold, *keys).agg(F.sum(label).alias("_fs"), F.count(label).alias("_fn"))
    per_key = per_fold.groupBy(*keys).agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    fold_tot = per_fold.groupBy(fold).agg(F.sum("_fs").alias("_gfs"), F.sum("_fn").alias("_gfn"))
    grand = fold_tot.agg(F.sum("_gfs").alias("_gs"), F.sum("_gfn").alias("_gn")).first()
    oof = (
        per_fold.join(per_key, keys).join(fold_tot, fold)
        .withColumn(
            "_m",
            F.when(F.col("_tn") - F.col("_fn") > 0, (F.col("_ts") - F.col("_fs")) / (F.col("_tn") - F.col("_fn")))
            .otherwise((F.lit(grand["_gs"]) - F.col("_gfs")) / (F.lit(grand["_gn"]) - F.col("_gfn"))),
        )
        .select(fold, *keys, "_m")
    )
    return df.join(oof, [fold, *keys], "left").withColumnRenamed("_m", out)
