import math

from pyspark.sql import functions as F

from dyad.functions.strings import combine_descriptors, numeric, split_names
from dyad.operators.clean import canonicalise, replicate_median, winsorize


def test_null_keys_dropped_and_median_interpolates(spark):
    rows = [("c1", 1, "lung", 1.0), ("c1", 1, "lung", 2.0), ("c1", 1, "lung", 4.0), ("c1", 1, "lung", 10.0),
            ("c2", 1, None, 3.0)]
    df = spark.createDataFrame(rows, "cell_id string, drug_id long, tissue string, ln_ic50 double")
    out = replicate_median(df, ["cell_id", "drug_id", "tissue"]).collect()
    assert len(out) == 1  # the NULL-tissue group is dropped (pandas groupby semantics)
    assert out[0]["ln_ic50"] == 3.0 and out[0]["n"] == 4


def test_winsorize_bounds_are_extremes(spark):
    df = spark.range(1000).selectExpr("cast(id * id % 997 as double) v")
    w = winsorize(df, "v", 0.01, 0.99)
    lo, hi = w.agg(F.min("v"), F.max("v")).first()
    import numpy as np
    xs = [float(i * i % 997) for i in range(1000)]
    assert math.isclose(lo, np.percentile(xs, 1)) and math.isclose(hi, np.percentile(xs, 99))


def test_descriptor_combination(spark):
    df = spark.createDataFrame([("lung", "NSCLC"), ("lung", "Lung"), ("skin", None), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(combine_descriptors("a", "b")).collect()]
    assert got == ["lung / NSCLC", "lung", "skin", None]


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("",), (None,), (" 2 ",)], "s string")
    assert [r[0] for r in df.select(numeric("s")).collect()] == [1.5, None, None, None, 2.0]


def test_split_names(spark):
    df = spark.createDataFrame([("A; b ,  c  d,,",)], "s string")
    assert df.select(split_names("s")).first()[0] == ["A", "b", "c d"]


def test_canonicalise_once_per_distinct(spark):
    df = spark.createDataFrame([(1, " C C "), (2, None), (3, "C C")], "id int, smiles string")
    got = {r["id"]: r["smiles"] for r in canonicalise(df, "smiles").collect()}
    assert got == {1: "CC", 2: "", 3: "CC"}


def test_replicates_are_collapsed_before_dimensions_with_repeated_rows(spark):
    from dyad.plans.dataset import attach_dimensions, replicate_medians
    from dyad.operators.clean import REPLICATE_KEYS

    rows = [("c1", 1, "A", float(v)) for v in (5, 1, 2, 9)] + [("c1", 1, "B", 3.0), ("c2", 2, "A", 1.0), ("c2", 2, "A", 4.0), ("c1", 3, "A", 7.0),
            (None, 1, "A", 1.0), ("c1", None, "A", 1.0), ("c1", 1, None, 1.0), ("c9", 1, "A", 1.0), ("c1", 8, "A", 1.0), ("c2", 1, "A", None)]
    resp = spark.createDataFrame(rows, "cell_id string, drug_id long, dataset string, ln_ic50 double")
    # drug 1 twice the same, drug 2 under two names, drug 3 without a name, one row without a key
    comp = spark.createDataFrame([(1, "x", None), (1, "x", ""), (2, "y", "CC"), (2, "z", "CC"), (3, None, "C"), (None, "n", "N")],
                                 "drug_id long, drug_name string, smiles string")
    cells = spark.createDataFrame([("c1", "lung"), ("c1", "lung"), ("c2", "skin"), ("c2", "bone"), ("c2", None), (None, "lung")], "cell_id string, tissue string")
    joined = attach_dimensions(resp.filter("ln_ic50 is not null"), comp, cells).withColumn("smiles", F.coalesce("smiles", F.lit("")))
    want = sorted(tuple(r) for r in replicate_median(joined).select(*REPLICATE_KEYS, "n", "ln_ic50").collect())
    for hot_rows in (1, 2_000_000):
        out = replicate_medians(resp, comp, cells, hot_rows=hot_rows)
        assert sorted(tuple(r) for r in out.collect()) == want and len(want) == 6
    exchanged = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(cell_id" in x and "drug_id" in x]
    assert exchanged and not any("drug_name" in x for x in exchanged)  # no text of a dimension is shuffled with the responses
