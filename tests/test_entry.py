import __spark_entry__ as entry_mod


def test_entry_and_registry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"cell_id", "drug_id", "drug_name", "smiles", "tissue", "dataset", "n", "ln_ic50"}
    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 75


def test_plan_pushes_filters_and_prunes(spark, sf_dir):
    from dyad.plans import fixtures as fx

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = li.filter("l_extendedprice > 1000").select("l_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,1000.0)]" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan
    resp = fx.responses(spark, sf_dir)
    rplan = resp._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(l_extendedprice)" in rplan


def test_ranks_have_no_single_partition_exchange(spark):
    from dyad.operators.order import average_ranks

    df = spark.range(1000).selectExpr("id", "cast(id % 13 as double) v")
    plan = average_ranks(df, "v", out="r")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_registered_plans_have_no_cartesian_steps(spark, sf_dir):
    import __spark_entry__ as entry_mod

    qs = entry_mod.queries()
    for name in ["clean_pairs", "describe", "avg_rank", "group_split", "resolve_priority", "wl_fingerprint",
                 "token_pad_mask", "assemble"]:
        plan = qs[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
