import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from dyad.operators.order import average_ranks, distributed_quantiles, group_quantiles, prefix_agg


def test_average_ranks_ties_match_pandas(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 2.0, None, 1.0]
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 3, "v": vals, "i": range(8)})
    df = spark.createDataFrame(pdf)
    got = average_ranks(df, "v", "g", out="r").toPandas().set_index("i")["r"].sort_index()
    exp = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got.fillna(-1).to_numpy(), exp.fillna(-1).to_numpy())


def test_rank_sum_is_triangular(spark):
    df = spark.range(0, 500).selectExpr("id", "cast(id % 37 as double) v")
    r = average_ranks(df, "v", out="r").agg({"r": "sum"}).first()[0]
    assert r == 500 * 501 / 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40),
       st.sampled_from([0.0, 0.005, 0.25, 0.5, 0.995, 1.0]))
def test_distributed_quantile_matches_numpy(spark, xs, p):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = distributed_quantiles(df, "v", [p]).first()["q0"]
    assert np.isclose(got, np.percentile(xs, p * 100, method="linear"), rtol=1e-9, atol=1e-9)


def test_hot_group_path_equals_aggregate_path(spark):
    rows = [(k, float((i * 7919) % 101)) for k in ("hot", "cold1", "cold2") for i in range(300 if k == "hot" else 5)]
    df = spark.createDataFrame(rows, "k string, v double")
    a = {r["k"]: (r["q0"], r["q1"], r["n"]) for r in group_quantiles(df, ["k"], "v", [0.5, 0.9], count_col="n").collect()}
    b = {r["k"]: (r["q0"], r["q1"], r["n"]) for r in
         group_quantiles(df, ["k"], "v", [0.5, 0.9], count_col="n", hot_rows=50).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k])


def test_running_min(spark):
    vals = [5.0, 3.0, 4.0, 1.0, 2.0, 0.5]
    df = spark.createDataFrame(list(enumerate(vals)), "n long, v double")
    got = [r["m"] for r in prefix_agg(df, ["n"], None, "v", "min", inclusive=True, out="m", buckets=3).orderBy("n").collect()]
    assert got == [5.0, 3.0, 3.0, 1.0, 1.0, 0.5]


def ranked(df, by=None, **kw):
    return {r["i"]: r["r"] for r in average_ranks(df, "v", by, out="r", **kw).collect()}


def test_ranks_of_values_that_fill_many_buckets(spark):
    # one value holds most rows, in two groups, with nulls, NaN and both zeros
    rows = []
    for i in range(600):
        v = 1.0 if i % 4 else [0.0, -0.0, float("nan"), None, float(i), float("-inf"), float("inf")][i // 4 % 7]
        rows.append((i, "a" if i % 3 else None, v))
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(7)
    want = {}
    for g in ("a", None):
        own = [(i, v) for i, k, v in rows if k == g]
        some = pd.Series([np.inf if v != v else v for _, v in own if v is not None])
        key = some.where(some != np.inf, 1e300)
        key[[v == v and v == np.inf for _, v in own if v is not None]] = 1e299  # NaN after infinity
        r = iter(key.rank(method="average"))
        want |= {i: None if v is None else next(r) for i, v in own}
    for buckets in (1, 5, 40):
        assert ranked(df, "g", buckets=buckets) == want
    same = spark.createDataFrame([(i, 2.0) for i in range(100)], "i long, v double")
    assert set(ranked(same, buckets=8).values()) == {50.5}
    assert ranked(same.limit(0)) == {}


def test_ranks_within_double_groups(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 2 else -0.0, float(i % 5)) for i in range(40)], "i long, g double, v double")
    assert ranked(df, "g", buckets=4) == {i: 4.5 + 8 * (i % 5) for i in range(40)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False), st.sampled_from([0.0, -0.0, 1.5])), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.005, 0.25, 0.5, 0.995, 1.0]), st.sampled_from([0, 3, 100_000]))
def test_refined_quantile_equals_sorted_value(spark, xs, p, fetch):
    from dyad.operators import quantiles

    old, quantiles.FETCH_ROWS = quantiles.FETCH_ROWS, fetch
    try:
        df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "v double")
        (got,) = quantiles.refine_quantiles(df, "v", [p])
    finally:
        quantiles.FETCH_ROWS = old
    s, h = sorted(xs), p * (len(xs) - 1)
    lo, hi = s[int(np.floor(h))], s[int(np.ceil(h))]
    want = lo if lo == hi or h == int(h) else (np.ceil(h) - h) * lo + (h - np.floor(h)) * hi
    assert got == want or (got != got and want != want)


def test_refinement_reads_more_bits_only_where_needed(spark, monkeypatch):
    from dyad.operators import quantiles

    x = np.random.default_rng(0).normal(1e6, 1e-3, 5000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(float("nan"),)] * 3, "v double")
    monkeypatch.setattr(quantiles, "FETCH_ROWS", 50)
    s = np.sort(np.append(x, [np.nan] * 3))
    probs = [0.0, 0.1, 0.5, 0.9]
    h = [p * (len(s) - 1) for p in probs]
    want = [s[int(np.floor(v))] if v == int(v) else (np.ceil(v) - v) * s[int(np.floor(v))] + (v - np.floor(v)) * s[int(np.ceil(v))] for v in h]
    assert quantiles.refine_quantiles(df, "v", probs) == want
    assert np.isnan(quantiles.refine_quantiles(df, "v", [1.0])[0])
    assert quantiles.refine_quantiles(df.limit(0), "v", [0.5, 1.0]) == [None, None]
    ints = spark.range(101).selectExpr("cast(id as int) v")
    assert quantiles.refine_quantiles(ints, "v", [0.25, 0.5]) == [25.0, 50.0]


def test_grouped_prefix_sums_across_buckets(spark):
    from dyad.operators.order import prefix_totals

    rows = [(g, i, float(i % 5)) for g in ("a", "b", "c") for i in range(40 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, i long, w double")
    got = {(r["g"], r["i"]): r["lt"] for r in prefix_totals(df, ["i"], "g", weight="w", out="lt", buckets=4).collect()}
    for g in ("a", "b", "c"):
        acc = 0.0
        for i in range(40 if g == "a" else 7):
            assert got[(g, i)] == acc
            acc += float(i % 5)


def test_hot_group_without_values_and_null_key_stay(spark):
    rows = [("null", None)] * 60 + [(None, float(i)) for i in range(61)] + [("c", 1.0), ("c", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    cold = {tuple(r) for r in group_quantiles(df, ["k"], "v", [0.37], count_col="n").collect()}
    hot = {tuple(r) for r in group_quantiles(df, ["k"], "v", [0.37], count_col="n", hot_rows=10).collect()}
    assert cold == hot and ("null", None, 60) in hot and len(hot) == 3


def test_rank_buckets_follow_rows_not_compressed_bytes(spark, monkeypatch):
    from dyad.operators import order
    from dyad.session import cut_lineage

    monkeypatch.setattr(order, "RANK_ROWS", 100)
    df = cut_lineage(spark.range(5000).selectExpr("id % 2 g", "cast(id % 7 as double) v"))  # a few bytes a row
    assert order.rank_buckets(df) == 50
    ranged = order._ranged(order.with_row_id(df), ["g"], "v", "_id", [], None)
    sizes = [len(p) for p in ranged.rdd.glom().collect()]
    assert max(sizes) <= 400 and sum(sizes) == 5000
    ranks = {(r.g, r.v): r.v_rank for r in order.average_ranks(df, "v", "g").distinct().collect()}
    want = {}
    for g in (0, 1):
        vs = sorted(float(i % 7) for i in range(5000) if i % 2 == g)
        want |= {(g, v): vs.index(v) + (vs.count(v) + 1) / 2 for v in set(vs)}
    assert ranks == want


def test_ordinary_group_quantiles_exchange_raw_rows_once(spark):
    rows = [(k, v) for k, vs in {"a": [3.0, None, 1.0, 2.0, float("nan")], "b": [None, None], None: [4.0], "c": [-1.0, 0.0, 5.0, 5.0]}.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    out = group_quantiles(df, ["k"], "v", [0.0, 0.37, 1.0], count_col="n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1 and "percentile" not in plan
    from pyspark.sql import functions as F

    plain = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(f"q{i}") for i, p in enumerate([0.0, 0.37, 1.0])], F.count(F.lit(1)).alias("n"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, plain.select(*out.columns).collect())))
    hot = group_quantiles(df, ["k"], "v", [0.0, 0.37, 1.0], count_col="n", hot_rows=1)
    assert sorted(map(repr, map(tuple, hot.collect()))) == sorted(map(repr, map(tuple, out.collect())))


def test_group_positions_over_few_and_many_buckets(spark):
    from dyad.operators.order import group_positions

    rows = [(g, (i * 37) % 101, f"{i}") for g, n in ((1, 90), (2, 3), (None, 20), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, o long, other string")
    for by, key in (("g", lambda r: r[0]), (None, lambda r: 0)):
        order = ["o"] if by else ["o", "g", "other"]
        want = []
        for r in rows:
            mine = [(x[1],) if by else (x[1], x[0] is not None, x[0] or 0, x[2]) for x in rows if key(x) == key(r)]
            own = (r[1],) if by else (r[1], r[0] is not None, r[0] or 0, r[2])
            want.append((r[2], r[0], sum(m < own for m in mine), len(mine)))
        for buckets in (1, 2, 13):
            made = group_positions(df, order, by, out="at", total="n", keep=["other", "g"], buckets=buckets)
            assert sorted(map(repr, ((r.other, r.g, r.at, r.n) for r in made.collect()))) == sorted(map(repr, want))
    assert group_positions(df.limit(0), "o", "g").count() == 0
