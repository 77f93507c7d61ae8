import numpy as np
import pandas as pd

from dyad.operators.evaluate import evaluate, fold_summary
from dyad.operators.matrix import zscore


def test_evaluate_matches_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=200)
    p = np.round(y + rng.normal(scale=0.5, size=200), 1)  # rounded -> ties
    pdf = pd.DataFrame({"split": np.where(np.arange(200) < 120, "a", "b"), "y": y, "p": p})
    got = {r["split"]: r for r in evaluate(spark.createDataFrame(pdf), "y", "p", "split").collect()}
    for s, g in pdf.groupby("split"):
        assert np.isclose(got[s]["rmse"], np.sqrt(np.mean((g.y - g.p) ** 2)))
        assert np.isclose(got[s]["mae"], np.mean(np.abs(g.y - g.p)))
        assert np.isclose(got[s]["pearson"], np.corrcoef(g.y, g.p)[0, 1])
        sp = np.corrcoef(g.y.rank(), g.p.rank())[0, 1]
        assert np.isclose(got[s]["spearman"], sp)


def test_population_sd_in_zscore_and_summary(spark):
    df = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate([1, 2, 3, 4])], "id long, feature long, value double")
    z = [r["value"] for r in zscore(df).orderBy("id").collect()]
    assert np.isclose(z[0], (1 - 2.5) / 1.118033988749895)
    m = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "rmse double")
    s = fold_summary(m, ["rmse"]).first()
    assert np.isclose(s["rmse_sd"], 1.118033988749895)


def test_every_metric_uses_complete_pairs_only(spark):
    from dyad.operators.evaluate import evaluate

    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("a", 9.0, None), ("b", 1.0, None), (None, 1.0, 1.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    every = {r["g"]: r for r in evaluate(df, "y", "p", "g", ("rmse", "mae", "spearman", "pearson", "n")).collect()}
    some = {r["g"]: r for r in evaluate(df, "y", "p", "g", ("rmse", "n")).collect()}
    assert {g: r["n"] for g, r in every.items()} == {"a": 3, "b": 0, None: 2}
    assert {g: (r["n"], r["rmse"]) for g, r in every.items()} == {g: (r["n"], r["rmse"]) for g, r in some.items()}
    assert abs(every["a"]["spearman"] - 0.5) < 1e-9 and abs(every[None]["spearman"] - 1) < 1e-9 and every["b"]["spearman"] is None


def test_co_ranking_of_hot_values_and_many_buckets(spark, monkeypatch):
    from dyad.operators import order

    rng = np.random.default_rng(5)
    n = 900
    y = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(size=n), 1))
    p = np.where(rng.random(n) < 0.5, 7.0, np.round(y + rng.normal(size=n), 0)) + 1e6
    g = np.where(np.arange(n) % 3 == 0, "a", "b")
    pdf = pd.DataFrame({"g": g, "y": y, "p": p})
    df = spark.createDataFrame(pdf).repartition(6)
    for buckets in (1, 4, 60):
        monkeypatch.setattr(order, "bucket_count", lambda _: buckets)
        got = {r["g"]: r for r in evaluate(df, "y", "p", "g", ("rmse", "mae", "spearman", "pearson", "n")).collect()}
        for k, f in pdf.groupby("g"):
            assert got[k]["n"] == len(f) and np.isclose(got[k]["rmse"], np.sqrt(np.mean((f.y - f.p) ** 2)))
            assert np.isclose(got[k]["mae"], np.mean(np.abs(f.y - f.p)))
            assert np.isclose(got[k]["spearman"], np.corrcoef(f.y.rank(), f.p.rank())[0, 1], atol=1e-12)
            assert np.isclose(got[k]["pearson"], np.corrcoef(f.y, f.p)[0, 1], atol=1e-9)
        (one,) = evaluate(df, "y", "p").collect()
        assert np.isclose(one["spearman"], np.corrcoef(pdf.y.rank(), pdf.p.rank())[0, 1], atol=1e-12)
    assert evaluate(df.limit(0), "y", "p", "g").collect() == []
    (none,) = evaluate(df.limit(0), "y", "p", metrics=("spearman", "rmse", "n")).collect()
    assert none["n"] == 0 and none["spearman"] is None and none["rmse"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")
    assert evaluate(flat, "y", "p").first()["spearman"] is None
