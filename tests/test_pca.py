"""Block principal components against a direct decomposition."""

import numpy as np
import pytest

from dyad.operators import pca


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(parts)


def direct(x, k):
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])[:, None]
    return s[:k] ** 2 / (len(x) - 1), c @ vt.T


def check(spark, x, k, atol=1e-6, **conf):
    df = frame(spark, x)
    model = pca.fit(df, k)
    var, scores = direct(x, model.k)
    got = np.array([r.pcs for r in model.scores(df, "id").orderBy("id").collect()])
    assert np.allclose(model.variances, var, atol=atol * var[0]) and np.allclose(got, scores, atol=atol * np.sqrt(var[0]) * 10)
    return model


def decaying(n, p, seed=0):
    r = np.random.default_rng(seed)
    return r.standard_normal((n, p)) * 0.9 ** np.arange(p) @ np.linalg.qr(r.standard_normal((p, p)))[0] + 7


def test_direct_block_is_exact(spark):
    model = check(spark, decaying(80, 9), 9, 1e-10)
    assert model.rounds == 1 and model.converged


def test_rounds_converge_and_panels_agree(spark, monkeypatch):
    monkeypatch.setattr(pca, "DIRECT_FEATURES", 8)
    monkeypatch.setattr(pca, "OVERSAMPLE", 6)
    x = decaying(120, 60)
    model = check(spark, x, 4)
    assert model.rounds > 1 and model.converged
    monkeypatch.setattr(pca, "PANEL_BYTES", 3 * 60 * 8)  # three columns a pass, two scoring passes
    assert np.allclose(check(spark, x, 4).variances, model.variances)


def test_twenty_thousand_features(spark):
    r = np.random.default_rng(3)
    x = (r.standard_normal((40, 5)) * [30, 20, 15, 10, 8]) @ r.standard_normal((5, 20_000)) / 100 + r.standard_normal((40, 20_000)) * 0.05
    df = frame(spark, x, 3)
    model = pca.fit(df, 3)
    var, scores = direct(x, 3)
    got = np.array([r.pcs for r in model.scores(df, "id").orderBy("id").collect()])
    assert model.converged and np.allclose(model.variances, var, rtol=1e-6) and np.allclose(got, scores, atol=1e-4 * np.sqrt(var[0]))


def test_bad_rows_ties_and_small_tables(spark):
    x = decaying(20, 4)
    df = frame(spark, x)
    bad = spark.createDataFrame([(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [float("inf")] * 4)], "id long, features array<double>")
    both = df.unionByName(bad)
    model = pca.fit(both, 10)
    assert model.k == 4 and np.allclose(model.variances, direct(x, 4)[0])
    out = {r.id: r.pcs for r in model.scores(both, "id").collect()}
    assert out[90] is None and out[91] is None and out[92] is None and np.allclose(out[5], direct(x, 4)[1][5])
    empty = pca.fit(df.limit(0), 3)
    assert empty.k == 0 and empty.scores(df.limit(0), "id").count() == 0
    assert pca.fit(bad, 3).k == 0
    same = frame(spark, np.ones((5, 3)))
    flat = pca.fit(same, 2)
    assert np.allclose(flat.variances, 0) and np.allclose([r.pcs for r in flat.scores(same, "id").collect()], 0)
    assert pca.fit(frame(spark, np.ones((1, 3))), 2).k == 1
    with pytest.raises(Exception, match="components expected"):
        pca.fit(df.unionByName(spark.createDataFrame([(1, [1.0])], "id long, features array<double>")), 2)
