"""The saved scoring pipeline: round trip, gaps, unknown levels, refused widths."""

import numpy as np
import pytest

from dyad.operators.scoring import ScoringPipeline, fit_pipeline

SCHEMA = "id long, v array<double>, a double, t string, y double"


@pytest.fixture(scope="module")
def train(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(300):
        v, a, t = r.standard_normal(3), r.standard_normal(), ["lung", "skin", None][i % 3]
        y = float(v @ [1, 2, 3] + a * 4 + {"lung": 5, "skin": -5, None: 0}[t] + r.standard_normal() * 0.1)
        rows.append((i, [float(x) for x in v] if i % 50 else None, float(a) if i % 40 else None, t, y if i % 60 else None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_a_loaded_pipeline_scores_alike(spark, train, tmp_path):
    fitted = fit_pipeline(train, "v", "y", ["a"], "t", 0.001)
    assert fitted.levels == ["lung", "skin", "unknown"] and fitted.width == 3 and len(fitted.coefficients) == 7
    path = str(tmp_path / "pipeline")
    fitted.save(spark, path)
    loaded = ScoringPipeline.load(spark, path)
    assert loaded == fitted
    out = {r.id: r for r in loaded.score(train).collect()}
    again = {r.id: r.prediction for r in fitted.score(train).collect()}
    assert {i: r.prediction for i, r in out.items()} == again and len(out) == 300
    whole = [r for r in out.values() if r.v and r.a is not None and r.y is not None]
    assert np.corrcoef([r.y for r in whole], [r.prediction for r in whole])[0, 1] > 0.99
    assert min(again.values()) >= fitted.low and max(again.values()) <= fitted.high
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        fitted.save(spark, path)


def test_gaps_unknown_levels_and_extra_columns(spark, train):
    p = fit_pipeline(train, "v", "y", ["a"], "t", 0.001, low=0.0, high=1.0)
    rows = [(1, None, None, "lung", None), (2, p.vector_means, p.number_means[0], "lung", None), (3, [1.0, None, float("nan")], float("inf"), "bone", None),
            (4, [1.0, p.vector_means[1], p.vector_means[2]], p.number_means[0], "other", None), (5, [0.0] * 3, 0.0, None, 1.0), (6, [0.0] * 3, 0.0, "unknown", 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", low string")
    out = {r.id: r.prediction for r in p.score(df).collect()}
    assert out[1] == out[2] and out[3] == out[4] and out[5] == out[6] and None not in out.values()
    assert p.score(df.limit(0)).count() == 0


def test_another_width_is_refused(spark, train):
    p = fit_pipeline(train, "v", "y", ["a"], "t")
    wide = spark.createDataFrame([(1, [1.0] * 4, 1.0, "lung", 1.0)], SCHEMA)
    for wrong in (wide, wide.selectExpr("id", "slice(v, 1, 2) v", "a", "t", "y")):
        with pytest.raises(Exception, match="components expected"):
            p.score(wrong).collect()
    with pytest.raises(ValueError, match="components expected"):
        fit_pipeline(train.unionByName(wide), "v", "y")
    with pytest.raises(ValueError, match="no row"):
        fit_pipeline(train.limit(0), "v", "y")
    with pytest.raises(ValueError, match="levels"):
        fit_pipeline(train.selectExpr("v", "y", "cast(id * 10000 + a as string) t").union(
            spark.range(2000).selectExpr("array(1D, 2D, 3D) v", "1D y", "cast(id as string) t")), "v", "y", category="t")


def test_a_stored_table_is_not_written_again(spark, train, monkeypatch):
    from dyad.operators import scoring

    fitted = fit_pipeline(train, "v", "y", ["a"], "t", 0.001)

    def written(df):
        raise AssertionError("the training rows were written")

    monkeypatch.setattr(scoring, "cut_lineage", written)
    again = fit_pipeline(train, "v", "y", ["a"], "t", 0.001, stored=True)
    assert np.allclose(again.coefficients, fitted.coefficients) and again.levels == fitted.levels
    narrow = again.score(train, keep=["id"])
    assert narrow.columns == ["id", "prediction"] and narrow.count() == 300
    assert {r.id: r.prediction for r in narrow.collect()} == {r.id: r.prediction for r in again.score(train).collect()}


def test_means_leave_gaps_and_infinite_values_out(spark):
    rows = [(1, [1.0, None, float("inf")], None, "a", 1.0), (2, [3.0, float("nan"), 2.0], 4.0, None, 2.0), (3, None, 2.0, "b", 4.0), (4, [9.0, 9.0, 9.0], 9.0, "c", None)]
    p = fit_pipeline(spark.createDataFrame(rows, SCHEMA), "v", "y", ["a"], "t", 0.1)
    assert p.vector_means == [2.0, 0.0, 2.0] and p.number_means == [3.0] and p.levels == ["a", "b", "unknown"]


def test_saved_scores_stores_its_pairs_without_vectors(spark, monkeypatch):
    from pyspark.sql.types import ArrayType

    from dyad.plans import q_regression

    stored, cut = [], q_regression.cut_lineage

    def watched(df):
        stored.append(df.schema)
        return cut(df)

    monkeypatch.setattr(q_regression, "cut_lineage", watched)
    q_regression.q_saved_scores(spark, "/root/testdata/sf0.001").collect()
    assert stored and not [f.name for schema in stored for f in schema if isinstance(f.dataType, ArrayType)]
