import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dyad.operators.splits import _water_fill, balanced_group_kfold, group_split, leakage_audit, plain_kfold, subsample


def greedy(sizes: dict, k: int) -> dict:
    loads, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        f = min(range(k), key=lambda j: (loads[j], j))
        out[g] = f
        loads[f] += n
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=5, max_size=5), st.integers(1, 9), st.integers(1, 30))
def test_water_fill_equals_sequential_greedy(loads, size, m):
    got = _water_fill(list(loads), size, m)
    sim, cnt = list(loads), [0] * 5
    for _ in range(m):
        j = min(range(5), key=lambda i: (sim[i], i))
        sim[j] += size
        cnt[j] += 1
    assert got == cnt


def test_group_kfold_matches_greedy(spark):
    random.seed(3)
    rows = [(g,) for g in range(60) for _ in range(random.choice([1, 1, 2, 3, 3, 7]))]
    df = spark.createDataFrame(rows, "g long")
    got = {r["g"]: r["fold"] for r in balanced_group_kfold(df, "g", 5).select("g", "fold").distinct().collect()}
    sizes = {}
    for (g,) in rows:
        sizes[g] = sizes.get(g, 0) + 1
    assert got == greedy(sizes, 5)


def test_group_split_sizes_and_no_leak(spark):
    df = spark.range(0, 3000).selectExpr("id % 97 as drug_id", "id as cell_id")
    sp = group_split(df, "drug_id", 0.2, 0.1, 42)
    per = {r["split"]: r["g"] for r in sp.groupBy("split").agg(F.countDistinct("drug_id").alias("g")).collect()}
    n_test = math.ceil(round(0.2 * 97, 9))
    assert per["test"] == n_test
    assert per["val"] == math.ceil(round(0.1 / 0.8 * (97 - n_test), 9))
    assert sum(per.values()) == 97
    assert leakage_audit(sp, "drug_id").count() == 0


def test_group_split_rejects_other_keys(spark):
    with pytest.raises(ValueError):
        group_split(spark.range(3).selectExpr("id as tissue"), "tissue")


def test_plain_kfold_balanced(spark):
    df = spark.range(103).selectExpr("id as a", "id * 2 as b")
    counts = sorted(r[1] for r in plain_kfold(df, ["a", "b"], 5).groupBy("fold").count().collect())
    assert counts == [20, 20, 21, 21, 21]


def test_subsample_exact_n(spark):
    df = spark.range(500).selectExpr("id as k")
    assert subsample(df, 123, ["k"]).count() == 123
    assert subsample(df, 900, ["k"]).count() == 500


def test_rows_without_a_group_keep_their_place(spark):
    from dyad.operators.splits import balanced_group_kfold, group_split

    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, i) for i in range(100)], "drug_id long, i long")
    for out in (group_split(df), balanced_group_kfold(df, "drug_id", 3)):
        name = out.columns[-1]
        rows = out.collect()
        assert len(rows) == 100 and len({r[name] for r in rows if r["drug_id"] is None}) == 1
