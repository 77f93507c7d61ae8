"""Matrix transforms on a wide entity x feature table (M1-M9, A5, O1).

Cleaning runs in long form ``(id, feature, value)``: every statistic is a
per-feature aggregate (partial + final), joined back through a one-row-per-
feature table.  Covariance multiplies blocks of features and never emits an entity's feature pairs as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.operators.joins import join_small
from dyad.operators.order import dense_index
from dyad.operators.profile import feature_stats
from dyad.session import cut_lineage

#: features and entities of the blocks that one task of :func:`covariance_rows` multiplies
FEATURE_BLOCK = 256
ENTITY_CHUNK = 4096


def to_long(df: DataFrame, id_col: str, vec_col: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """M1: ``(id, array)`` -> long ``(id, feature index, value double)``."""
    return df.select(id_col, F.posexplode(vec_col).alias(feature, value)).withColumn(
        value, F.col(value).cast("double")
    )


def to_vectors(long_df: DataFrame, id_col: str, feature: str = "feature", value: str = "value",
               out: str = "features") -> DataFrame:
    """M1 (back): long -> one ``array<double>`` per id, one place per feature of
    the table in feature order; NULL where the entity has no row for a feature.
    One group per entity holds that entity's features only (bounded by top-k);
    an entity with two rows of a feature fails the job."""
    places = dense_index(long_df.select(feature).distinct(), [feature], out="_place")
    width = places.count()
    placed = join_small(long_df, places, feature, null_safe=True)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_place").alias("place"), F.col(value).alias("v"))))
    every = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")) if width else F.array().cast("array<long>")
    by_place = F.map_from_entries("_p")
    vector = F.when(F.transform("_p", lambda s: s["place"]) == every, F.transform("_p", lambda s: s["v"])).otherwise(
        F.transform(every, lambda i: F.try_element_at(by_place, i)))
    return placed.groupBy(id_col).agg(pairs.alias("_p")).select(id_col, vector.alias(out))


def keep_features(long_df: DataFrame, policy: str = "drop_all_null", feature: str = "feature",
                  value: str = "value", id_col: str | None = None) -> DataFrame:
    """M2: drop features that are entirely NULL (``drop_all_null``, current
    reference) or that have any NULL (``drop_any``, older versions)."""
    stats = long_df.groupBy(feature).agg(F.count(value).alias("_nn"), F.count(F.lit(1)).alias("_n"))
    if policy == "drop_all_null":
        keep = stats.filter(F.col("_nn") > 0)
    elif policy == "drop_any":
        keep = stats.filter(F.col("_nn") == F.col("_n"))
    else:
        raise ValueError(f"unknown null policy {policy!r}")
    return join_small(long_df, keep.select(feature), feature, how="left_semi")


def impute_mean(long_df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """M3: NULL -> the feature's mean over non-NULL values."""
    means = long_df.groupBy(feature).agg(F.avg(value).alias("_mean"))
    out = join_small(long_df, means, feature, how="inner")
    return out.withColumn(value, F.coalesce(F.col(value), F.col("_mean"))).drop("_mean")


def top_variance(long_df: DataFrame, k: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """A5 + O1: the ``min(k, n)`` features with the largest sample variance
    (ties: feature ascending, Q9).  Returns ``(feature, var)``; ``k`` rows at
    most, the limit being the operator."""
    stats = feature_stats(long_df, feature, value)
    return stats.orderBy(F.desc("var"), F.asc(feature)).limit(k).select(feature, "var")


def select_features(long_df: DataFrame, chosen: DataFrame, feature: str = "feature") -> DataFrame:
    return join_small(long_df, chosen.select(feature), feature, how="left_semi")


def zscore(long_df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """M5: ``(x - mean) / sd_pop`` per feature; a zero sd counts as 1 (as
    ``StandardScaler``)."""
    stats = long_df.groupBy(feature).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    out = join_small(long_df, stats, feature, how="inner")
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return out.withColumn(value, (F.col(value) - F.col("_mu")) / sd).drop("_mu", "_sd")


def covariance_rows(long_df: DataFrame, id_col: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """M6 as a table ``f1, f2, cov``: population covariance of every two features
    over the entities that have a value of both (no row for two that share none).
    Rows meet as in a self-join on the id: null ids never, and an entity's
    several values of a feature each with all its values of the other.

    Features are cut into blocks; a task multiplies two blocks of some
    ``ENTITY_CHUNK`` entities, and chunks are merged by an aggregate.  Neither
    the matrix nor a table of entities by pairs is held anywhere."""
    places = cut_lineage(dense_index(long_df.select(feature).distinct(), [feature], out="_place"))
    n_blocks = -(-places.count() // FEATURE_BLOCK)
    chunks = max(1, -(-long_df.select(id_col).distinct().count() // ENTITY_CHUNK))
    placed = join_small(long_df, places, feature, null_safe=True).filter(F.col(value).isNotNull() & F.col(id_col).isNotNull()).select(
        F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"), F.floor(F.col("_place") / FEATURE_BLOCK).cast("int").alias("_b"),
        (F.col("_place") % FEATURE_BLOCK).cast("int").alias("_at"), F.col(value).cast("double").alias("_v"))
    rows = placed.groupBy("_h", "_id", "_b").agg(F.collect_list(F.struct("_at", "_v")).alias("_l"))
    other = F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0)))).alias("_o")
    cells = rows.select("*", other).select(
        F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), F.pmod("_h", F.lit(chunks)).alias("_c"),
        (F.col("_b") > F.col("_o")).alias("_side"), "_id", F.col("_l._at").alias("_at"), F.col("_l._v").alias("_v"))

    def multiply(t: pa.Table) -> pa.Table:
        i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
        entity = t.column("_id").combine_chunks().dictionary_encode()
        entity = entity if isinstance(entity, pa.DictionaryArray) else entity.combine_chunks()
        code, side = entity.indices.to_numpy(), t.column("_side").to_numpy()
        at, v = t.column("_at").combine_chunks(), t.column("_v").combine_chunks()
        row = np.repeat(np.arange(len(code)), at.value_lengths().to_numpy())
        places, v = (side[row].astype(int), code[row], at.flatten().to_numpy()), v.flatten().to_numpy()
        has, block = np.zeros((2, 2, len(entity.dictionary), FEATURE_BLOCK))
        np.add.at(has, places, 1.0)
        np.add.at(block, places, v)
        mid = block.sum(1) / np.maximum(has.sum(1), 1)
        block = np.zeros(block.shape)
        np.add.at(block, places, v - mid[places[0], places[2]])
        one = 0 if i == j else 1
        a, b, has_a, has_b, mid_a, mid_b = block[0], block[one], has[0], has[one], mid[0], mid[one]
        n = has_a.T @ has_b
        u, w = np.nonzero(n)
        n, sa, sb, ab = (m[u, w] for m in (n, a.T @ has_b, has_a.T @ b, a.T @ b))
        out = [u + i * FEATURE_BLOCK, w + j * FEATURE_BLOCK, n, mid_a[u] + sa / n, mid_b[w] + sb / n, ab - sa * sb / n]
        if i != j:
            out = [np.concatenate([p, q]) for p, q in zip(out, [out[1], out[0], out[2], out[4], out[3], out[5]])]
        return pa.table(out, names=["_p1", "_p2", "n", "ma", "mb", "c"])

    parts = cells.groupBy("_i", "_j", "_c").applyInArrow(multiply, "_p1 long, _p2 long, n double, ma double, mb double, c double")
    n, sa, sb = F.sum("n"), F.sum(F.col("n") * F.col("ma")), F.sum(F.col("n") * F.col("mb"))
    cov = (F.sum("c") + F.sum(F.col("n") * F.col("ma") * F.col("mb")) - sa * sb / n) / n
    merged = parts.groupBy("_p1", "_p2").agg(cov.alias("cov"))
    for p, f in (("_p1", "f1"), ("_p2", "f2")):
        merged = join_small(merged, places.select(F.col("_place").alias(p), F.col(feature).alias(f)), p)
    return merged.select("f1", "f2", "cov")


def explode_components(df: DataFrame, col: str = "pcs", prefix: str = "PC", k: int | None = None) -> DataFrame:
    """Wide ``PC1..PCk`` columns on request (P7 reads them back by prefix)."""
    k = k or len(df.select(col).first()[0])
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def fit_onehot(train: DataFrame, col: str, unknown: str = "unknown") -> tuple[object, list[str]]:
    """M8 fit: sorted levels (alphabetical), NULL -> ``unknown``."""
    filled = train.select(F.coalesce(F.col(col), F.lit(unknown)).alias(col))
    indexer = StringIndexer(inputCol=col, outputCol=f"{col}_idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep").fit(filled)
    return indexer, list(indexer.labels)


def onehot(df: DataFrame, col: str, fitted: tuple[object, list[str]], out: str | None = None,
           unknown: str = "unknown") -> DataFrame:
    """M8 apply: one slot per fitted level; an unseen level gives all zeros
    (``handle_unknown='ignore'``).  The indexer's extra 'invalid' slot is cut off."""
    indexer, labels = fitted
    out = out or f"{col}_onehot"
    idx = f"{col}_idx"
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit(unknown)))
    indexed = indexer.transform(filled)  # type: ignore[attr-defined]
    enc = OneHotEncoder(inputCols=[idx], outputCols=["_oh"], dropLast=False, handleInvalid="keep").fit(indexed)
    arr = F.slice(vector_to_array("_oh"), 1, len(labels))
    return enc.transform(indexed).withColumn(out, arr).drop("_oh")


def assemble(df: DataFrame, blocks: Sequence[str], out: str = "features") -> DataFrame:
    """M9: concatenate numeric/array blocks in a fixed order into one MLlib
    vector; NULLs fail the job (``handleInvalid='error'``)."""
    cols = []
    for b in blocks:
        dtype = df.schema[b].dataType
        if isinstance(dtype, T.ArrayType):
            cols.append(array_to_vector(F.col(b)).alias(f"_{b}_v"))
        else:
            cols.append(F.col(b).cast("double").alias(f"_{b}_v"))
    staged = df.select("*", *cols)
    va = VectorAssembler(inputCols=[f"_{b}_v" for b in blocks], outputCol=out, handleInvalid="error")
    return va.transform(staged).drop(*[f"_{b}_v" for b in blocks])
