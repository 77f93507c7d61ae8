import numpy as np
from pyspark.sql import functions as F

from dyad.operators.matrix import impute_mean, keep_features, to_long, to_vectors, zscore
from dyad.operators.pca import pca_scores


def test_pca_scores_orthogonal_and_ordered(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    rows = [(str(i), [float(v) for v in X[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "cell_id string, vec array<double>")
    z = zscore(to_long(df, "cell_id", "vec"))
    vecs = to_vectors(z, "cell_id")
    S = np.array([r["pcs"] for r in pca_scores(vecs, 4, "cell_id").orderBy("cell_id").collect()])
    cov = np.cov(S, rowvar=False)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-8)
    var = np.diag(cov)
    assert all(var[i] >= var[i + 1] - 1e-9 for i in range(3))


def test_null_policies_and_impute(spark):
    rows = [(c, f, v) for c, f, v in [("a", 0, None), ("b", 0, None), ("a", 1, 1.0), ("b", 1, None), ("a", 2, 2.0), ("b", 2, 4.0)]]
    df = spark.createDataFrame(rows, "cell_id string, feature long, value double")
    assert sorted(r[0] for r in keep_features(df).select("feature").distinct().collect()) == [1, 2]
    assert [r[0] for r in keep_features(df, "drop_any").select("feature").distinct().collect()] == [2]
    imp = {(r["cell_id"], r["feature"]): r["value"] for r in impute_mean(keep_features(df)).collect()}
    assert imp[("b", 1)] == 1.0 and imp[("b", 2)] == 4.0


def test_vectors_keep_the_place_of_missing_features(spark):
    from dyad.operators.matrix import to_vectors

    long_df = spark.createDataFrame([("x", 0, 1.0), ("x", 2, 3.0), ("y", 0, 4.0), ("y", 1, 5.0), ("y", 2, 6.0)],
                                    "id string, feature int, value double")
    got = {r["id"]: list(r["features"]) for r in to_vectors(long_df, "id").collect()}
    assert got == {"x": [1.0, None, 3.0], "y": [4.0, 5.0, 6.0]}


def test_covariance_rows_of_blocks_and_chunks(spark, monkeypatch):
    from dyad.operators import matrix

    monkeypatch.setattr(matrix, "FEATURE_BLOCK", 4)
    monkeypatch.setattr(matrix, "ENTITY_CHUNK", 7)
    X = np.random.default_rng(3).normal(5.0, 2.0, size=(30, 10))
    X[::3, 2] = np.nan
    rows = [(f"e{i}", 3 * f, None if np.isnan(X[i, f]) else float(X[i, f])) for i in range(30) for f in range(10)]
    df = spark.createDataFrame(rows, "id string, feature long, value double")
    got = {(r.f1, r.f2): r.cov for r in matrix.covariance_rows(df, "id").collect()}
    assert len(got) == 100
    for f in range(10):
        for g in range(10):
            both = ~np.isnan(X[:, f]) & ~np.isnan(X[:, g])
            assert abs(got[3 * f, 3 * g] - np.cov(X[both, f], X[both, g], bias=True)[0, 1]) < 1e-9


def test_covariance_rows_of_repeated_and_null_ids(spark):
    from dyad.operators.matrix import covariance_rows

    rows = [("a", 0, 1.0), ("a", 0, 4.0), ("a", 1, 2.0), ("b", 0, 3.0), ("b", 1, 7.0), (None, 0, 50.0), (None, 1, 60.0)]
    got = {(r.f1, r.f2): r.cov for r in covariance_rows(spark.createDataFrame(rows, "id string, feature long, value double"), "id").collect()}
    for f, g in [(0, 0), (0, 1), (1, 0), (1, 1)]:
        pairs = np.array([(v, w) for i, p, v in rows for j, q, w in rows if i is not None and i == j and (p, q) == (f, g)])
        assert abs(got[f, g] - np.cov(pairs.T, bias=True)[0, 1]) < 1e-9


def test_covariance_query_brings_no_matrix_to_the_driver(spark, sf_dir):
    from dyad.plans.q_matrix import q_covariance

    plan = q_covariance(spark, sf_dir)._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan and "FlatMapGroupsInArrow" in plan
