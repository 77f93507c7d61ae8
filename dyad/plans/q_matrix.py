"""Matrix queries (M1-M9, A5, O1).  The expression matrix is ``embeddings``:
one entity per ``vec_id`` with 64 features; a NULL pattern is laid over it
(every 16th feature entirely NULL, and values above 0.25 in every 4th feature) to exercise the
cleaning steps."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.plans import fixtures as fx
from dyad.plans.registry import PAIRS_SQL, pairs_df, r6, register

LONG_SQL = """lng0 AS (SELECT vec_id cell_id, unnest(range(len(embedding))) feature, unnest(embedding)::DOUBLE value
                FROM embeddings),
 lng AS (SELECT cell_id, feature, CASE WHEN feature % 16 = 0 OR (feature % 4 = 1 AND value > 0.25) THEN NULL ELSE value END value FROM lng0),
 kept AS (SELECT feature, avg(value) mean FROM lng GROUP BY feature HAVING count(value) > 0),
 imp AS (SELECT cell_id, feature, coalesce(value, mean) value FROM lng JOIN kept USING (feature)),
 top AS (SELECT feature, var_samp(value) var FROM imp GROUP BY feature ORDER BY var DESC, feature LIMIT 16),
 z AS (SELECT cell_id, feature, (value - avg(value) OVER w) /
              CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END z
         FROM imp WHERE feature IN (SELECT feature FROM top) WINDOW w AS (PARTITION BY feature))"""


def long_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long matrix with the NULL pattern applied."""
    from dyad.operators.matrix import to_long

    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding")
    lng = to_long(e, "cell_id", "embedding").withColumn("feature", F.col("feature").cast("bigint"))
    return lng.withColumn(
        "value", F.when((F.col("feature") % 16 == 0) | ((F.col("feature") % 4 == 1) & (F.col("value") > 0.25)), F.lit(None)).otherwise(F.col("value"))
    )


def imputed_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyad.operators.matrix import impute_mean, keep_features

    return impute_mean(keep_features(long_df(spark, sf_dir)))


def z_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyad.operators.matrix import select_features, top_variance, zscore
    from dyad.session import cut_lineage

    imp = cut_lineage(imputed_df(spark, sf_dir))
    return zscore(select_features(imp, top_variance(imp, 16)))


@register("matrix_unpivot", """WITH lng0 AS (SELECT vec_id cell_id, unnest(range(len(embedding))) feature,
       unnest(embedding)::DOUBLE value FROM embeddings)
SELECT cell_id, feature, round(value, 6) value FROM lng0""")
def q_matrix_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: entity x feature matrix to long form."""
    from dyad.operators.matrix import to_long

    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding")
    lng = to_long(e, "cell_id", "embedding")
    return lng.select("cell_id", F.col("feature").cast("bigint"), r6("value").alias("value"))


@register("drop_null_features", f"""WITH {LONG_SQL}
SELECT feature, count(value) n_values FROM lng WHERE feature IN (SELECT feature FROM kept) GROUP BY feature""")
def q_drop_null_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: entirely-NULL features dropped (current policy)."""
    from dyad.operators.matrix import keep_features

    return keep_features(long_df(spark, sf_dir)).groupBy("feature").agg(F.count("value").alias("n_values"))


@register("drop_any_null_features", f"""WITH {LONG_SQL}
SELECT feature FROM lng GROUP BY feature HAVING count(value) = count(*)""")
def q_drop_any_null_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: features with any NULL dropped (older policy, Q23)."""
    from dyad.operators.matrix import keep_features

    return keep_features(long_df(spark, sf_dir), "drop_any").select("feature").distinct()


@register("impute_mean", f"""WITH {LONG_SQL} SELECT cell_id, feature, round(value, 6) value FROM imp""")
def q_impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: NULL -> feature mean."""
    return imputed_df(spark, sf_dir).withColumn("value", r6("value"))


@register("feature_variance_topk", f"""WITH {LONG_SQL} SELECT feature, round(var, 9) var FROM top""")
def q_feature_variance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + O1: the 16 features of largest sample variance (ties by feature)."""
    from dyad.operators.matrix import top_variance

    return top_variance(imputed_df(spark, sf_dir), 16).withColumn("var", r6("var", 9))


@register("zscore", f"""WITH {LONG_SQL} SELECT cell_id, feature, round(z, 6) z FROM z""")
def q_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: population z-score per feature (zero sd -> 1)."""
    return z_df(spark, sf_dir).select("cell_id", "feature", r6("value").alias("z"))


@register("covariance", f"""WITH {LONG_SQL}
SELECT a.feature f1, b.feature f2, round(covar_pop(a.z, b.z), 6) cov FROM z a JOIN z b USING (cell_id)
 GROUP BY a.feature, b.feature""")
def q_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: population covariance of the selected, z-scored features, by blocks
    of features; feature pairs of an entity are never materialised as rows."""
    from dyad.operators.matrix import covariance_rows

    cov = covariance_rows(z_df(spark, sf_dir), "cell_id")
    return cov.select("f1", "f2", (F.round("cov", 6) + F.lit(0.0)).alias("cov"))


@register("onehot", f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, dataset, dense_rank() OVER (ORDER BY coalesce(tissue, 'unknown')) - 1 tissue_idx,
       count(DISTINCT coalesce(tissue, 'unknown')) OVER () n_levels FROM pairs""")
def q_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: one-hot of tissue over sorted levels (fit on all rows, Q10)."""
    from dyad.operators.matrix import fit_onehot, onehot

    pairs = pairs_df(spark, sf_dir, materialize=True)
    enc = onehot(pairs, "tissue", fit_onehot(pairs, "tissue"))
    return enc.select(
        "cell_id", "drug_id", "dataset",
        (F.array_position("tissue_onehot", 1.0) - 1).cast("bigint").alias("tissue_idx"),
        F.size("tissue_onehot").cast("bigint").alias("n_levels"),
    )


@register("assemble", f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, dataset, len(embedding) + 2 + (SELECT count(DISTINCT tissue) FROM pairs) width,
       round(list_sum(embedding::DOUBLE[]) + p_size + p_retailprice + 1, 4) checksum
  FROM pairs JOIN embeddings ON vec_id = cell_id JOIN part ON p_partkey = drug_id""")
def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + J12: ``[cell vector, drug descriptors, tissue one-hot]`` assembled
    into one vector per pair; checked by width and element sum."""
    from dyad.operators.matrix import assemble, fit_onehot, onehot
    from dyad.operators.resolve import align_blocks

    pairs = pairs_df(spark, sf_dir, materialize=True)
    cellv = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("cell_vec"))
    drugd = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_size", "p_retailprice")
    blocks = align_blocks(pairs, [(cellv, "cell_id"), (drugd, "drug_id")]).filter(F.col("cell_vec").isNotNull())
    blocks = onehot(blocks, "tissue", fit_onehot(pairs, "tissue"))
    out = assemble(blocks, ["cell_vec", "p_size", "p_retailprice", "tissue_onehot"])
    arr = vector_to_array("features")
    return out.select("cell_id", "drug_id", "dataset", F.size(arr).cast("bigint").alias("width"),
                      F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


# Principal components in SQL: cyclic Jacobi rotations of the covariance ``m`` of all z-scored features
# (padded to an even number), every round turning disjoint pairs; ``v`` collects the rotations.
PCA_SQL = f"""{LONG_SQL},
 f AS (SELECT feature, row_number() OVER (ORDER BY feature) i FROM kept),
 zz AS (SELECT cell_id, i, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END z
          FROM imp JOIN f USING (feature) WINDOW w AS (PARTITION BY i)),
 nn AS (SELECT max(i) p, max(i) + max(i) % 2 n, count(DISTINCT cell_id) c FROM zz),
 cv AS (SELECT a.i, b.i j, sum(a.z * b.z) / max(c - 1) v FROM zz a JOIN zz b USING (cell_id) CROSS JOIN nn GROUP BY a.i, b.i),
 grid AS (SELECT n, i, list(coalesce(v, 0) ORDER BY j) r, list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) e
            FROM (SELECT n, unnest(range(1, n + 1)) i FROM nn) JOIN (SELECT unnest(range(1, n + 1)) j FROM nn) ON true
            LEFT JOIN cv USING (i, j) GROUP BY n, i),
 jac AS (SELECT 0::BIGINT k, n, list(r ORDER BY i) m, list(e ORDER BY i) v FROM grid GROUP BY n
         UNION ALL
         SELECT k + 1, n, list_transform(m1, lambda row: list_transform(row, lambda x, j: cc[j] * x + ss[j] * row[pr[j]])),
                list_transform(v, lambda row: list_transform(row, lambda x, j: cc[j] * x + ss[j] * row[pr[j]]))
           FROM (SELECT *, list_transform(m, lambda row, j: list_transform(row, lambda x, i: cc[j] * x + ss[j] * m[pr[j]][i])) m1
                   FROM (SELECT *, list_transform(tt, lambda t: 1 / sqrt(1 + t * t)) cc,
                                list_transform(tt, lambda t, j: CASE WHEN j < pr[j] THEN -t ELSE t END / sqrt(1 + t * t)) ss
                           FROM (SELECT *, list_transform(tau, lambda x: CASE WHEN x IS NULL THEN 0 WHEN x < 0 THEN -1 / (-x + sqrt(1 + x * x))
                                                                           ELSE 1 / (x + sqrt(1 + x * x)) END) tt
                                   FROM (SELECT *, list_transform(pr, lambda q, j: (m[greatest(q, j)][greatest(q, j)] - m[least(q, j)][least(q, j)])
                                                                                  / nullif(2 * m[q][j], 0)) tau
                                           FROM (SELECT *, list_transform(range(n), lambda j: CASE WHEN j = n - 1 THEN k % (n - 1) WHEN j = k % (n - 1) THEN n - 1
                                                             ELSE (2 * (k % (n - 1)) - j + n - 1) % (n - 1) END + 1) pr
                                                   FROM jac WHERE k < 10 * (n - 1)))))))
,
 fin AS (SELECT m, v FROM jac WHERE k = 10 * (n - 1)),
 ev AS (SELECT j, variance, row_number() OVER (ORDER BY variance DESC) component
          FROM (SELECT unnest(range(1, p + 1)) j, unnest(list_transform(range(1, p + 1), lambda j: m[j][j])) variance FROM fin CROSS JOIN nn)),
 ld AS (SELECT component, unnest(range(1, p + 1)) i, unnest(list_transform(range(1, p + 1), lambda i: v[i][j])) l FROM ev CROSS JOIN fin CROSS JOIN nn
         WHERE component <= least(p, c)),
 sg AS (SELECT component, sign(arg_max(l, abs(l))) s FROM ld GROUP BY component)"""
PCS = 512


@register("pca_variance", f"""WITH RECURSIVE {PCA_SQL}
SELECT component::INTEGER component, round(variance, 6) variance FROM ev WHERE component <= (SELECT least({PCS}, p, c) FROM nn)""")
def q_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the variance of every principal component of the matrix branch."""
    from dyad.operators.pca import fit
    from dyad.plans.dataset import expression_vectors

    model = fit(expression_vectors(long_df(spark, sf_dir)), PCS)
    return model.variance_table(spark).select("component", r6("variance").alias("variance"))


@register("pca_scores", f"""WITH RECURSIVE {PCA_SQL}
SELECT cell_id, component::INTEGER component, round(sum(z * l) * any_value(s), 4) + 0.0 score
  FROM zz JOIN ld USING (i) JOIN sg USING (component) WHERE component <= {PCS} GROUP BY cell_id, component""")
def q_pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: full matrix branch -> all principal-component scores of every entity."""
    from dyad.plans.dataset import expression_scores

    scores = expression_scores(long_df(spark, sf_dir), pcs=PCS)
    return scores.select("cell_id", F.posexplode("pcs").alias("component", "score")).select(
        "cell_id", (F.col("component") + 1).alias("component"), (r6("score", 4) + F.lit(0.0)).alias("score"))
