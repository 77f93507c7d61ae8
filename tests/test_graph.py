from pyspark.sql import functions as F

from dyad.operators import graph as gr

TYPES = {"A": 6, "N": 7, "R": 8}


def graphs(spark):
    # graph 1: triangle, graph 2: path of 3, graph 3: single node
    nodes = spark.createDataFrame(
        [(1, 0, "A", 0, 0, 0), (1, 1, "A", 0, 0, 0), (1, 2, "A", 0, 0, 0),
         (2, 0, "A", 1, 0, 0), (2, 1, "N", 0, 0, 1), (2, 2, "A", 1, 0, 0), (3, 0, "R", 2, 1, 0)],
        "graph_id long, node_id long, atom string, hydrogens long, charge long, aromatic long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (2, 0, 1), (2, 1, 2)], "graph_id long, src long, dst long")
    return nodes, gr.undirected(edges)


def test_undirected_and_degree(spark):
    nodes, ue = graphs(spark)
    assert ue.count() == 10
    x = {(r["graph_id"], r["node_id"]): r["x"] for r in gr.node_features(nodes, ue, TYPES).collect()}
    assert x[(1, 0)][1] == 2 and x[(2, 1)][1] == 2 and x[(2, 0)][1] == 1 and x[(3, 0)][1] == 0


def test_placeholder_for_empty_graph(spark):
    nodes, ue = graphs(spark)
    ents = spark.createDataFrame([(1,), (2,), (3,), (4,)], "drug_id long")
    x = gr.with_placeholders(ents, gr.node_features(nodes, ue, TYPES), "drug_id")
    four = x.filter(F.col("graph_id") == 4).collect()
    assert len(four) == 1 and four[0]["x"] == [0.0] * 5


def test_wl_symmetry_and_propagation(spark):
    nodes, ue = graphs(spark)
    labs = gr.wl_labels(nodes, ue, F.concat("atom", F.lit(":"), F.col("hydrogens").cast("string")), rounds=2)
    last = {(r["graph_id"], r["node_id"]): r["lab"] for r in labs.filter("round = 2").collect()}
    assert last[(1, 0)] == last[(1, 1)] == last[(1, 2)]      # triangle nodes are equivalent
    assert last[(2, 0)] == last[(2, 2)] != last[(2, 1)]      # path ends vs middle
    prop = gr.propagate(gr.node_features(nodes, ue, TYPES), ue, layers=1)
    v = {(r["graph_id"], r["node_id"]): r["x"] for r in prop.collect()}
    assert v[(2, 1)][0] == 7 + 6 + 6  # own type id plus both neighbours
    pooled = {r["graph_id"]: r["pooled"] for r in gr.mean_pool(prop).collect()}
    assert len(pooled[3]) == 5


def test_fingerprint_is_the_same_in_one_exchange_and_by_joins(spark, monkeypatch):
    rows = [(g, i, None if (g, i) == (2, 1) else "AB"[i * g % 3 % 2]) for g in (1, 2, 3) for i in range(9 * g)] + [(None, 0, "A"), (1, 2, "B"), (3, None, "A")]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, atom string")
    edges = gr.undirected(spark.createDataFrame(
        [(g, i, (i * 5 + 1) % (9 * g)) for g in (1, 2, 3) for i in range(9 * g)] + [(None, 0, 1), (1, 3, None), (1, 2, 99), (4, 0, 1)],
        "graph_id long, src long, dst long"))
    bits = lambda: sorted(map(repr, map(tuple, gr.circular_fingerprint(nodes, edges, F.col("atom"), 2, 64).collect())))
    once = bits()
    monkeypatch.setattr(gr, "GRAPH_ROWS", 60)  # graphs 2 and 3 go by joins
    assert bits() == once and len(once) > 20
    monkeypatch.setattr(gr, "GRAPH_ROWS", 0)
    assert bits() == once


def test_ordinary_graphs_take_one_exchange_and_no_join(spark):
    nodes, ue = graphs(spark)
    plan = gr.circular_fingerprint(nodes, ue, F.col("atom"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    items = spark.createDataFrame([(1, 5, "A"), (1, 3, "N"), (2, 1, "R"), (None, 1, "R"), (None, 2, "R")], "g long, o long, atom string")
    chain, edges = gr.chain_graphs(items, "g", "o", ["atom"])
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in edges.collect()] == [(1, 0, 1)] and chain.count() == 5


def test_token_graphs_of_single_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b a c".split()), (2, []), (3, "b b c".split()), (3, "c b d".split()), (None, ["x"]), (None, ["x", "y"])],
                                 "graph_id long, w array<string>")
    nodes, ue = gr.token_graphs(docs, "w")
    names = {(r.graph_id, r.node_id): r.token for r in nodes.filter("graph_id is not null").collect()}
    assert sorted((r.graph_id or 0, r.token) for r in nodes.collect()) == sorted(
        [(1, "a"), (1, "b"), (1, "c"), (3, "b"), (3, "c"), (3, "b"), (3, "c"), (3, "d"), (0, "x"), (0, "x"), (0, "y")])
    got = sorted((r.graph_id, names[r.graph_id, r.src], names[r.graph_id, r.dst]) for r in ue.filter("graph_id is not null").collect())
    assert got == sorted((g, *e) for g, x, y in [(1, "a", "b"), (1, "a", "c"), (3, "b", "c"), (3, "b", "d")] for e in [(x, y), (y, x)])
    plan = gr.token_graphs(docs.filter("graph_id < 3"), "w")[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def odd_graphs(spark):
    rows = [(g, i, "ANRA"[i * g % 4], i % 3, None if (g, i) == (2, 1) else i % 2, 1) for g in (1, 2, 3) for i in range(5 * g)]
    rows += [(None, 0, "A", 1, 0, 0), (1, 2, "R", 1, 0, 0), (3, None, "A", 0, 0, 0), (7, 0, None, None, 0, 0)]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, atom string, hydrogens long, charge long, aromatic long")
    edges = [(g, i, (i * 3 + 1) % (5 * g)) for g in (1, 2, 3) for i in range(5 * g)] + [(None, 0, 1), (1, 3, None), (1, None, 2), (1, 2, 99), (4, 0, 1), (2, 1, 1)]
    return nodes, gr.undirected(spark.createDataFrame(edges, "graph_id long, src long, dst long"))


def test_steps_are_the_same_in_one_exchange_and_by_joins(spark, monkeypatch):
    nodes, ue = odd_graphs(spark)
    x = nodes.select("graph_id", "node_id", F.when(F.col("atom").isNotNull(), F.array(F.col("charge") * 1.5, F.col("hydrogens") - 1.0)).alias("x"))

    def steps():
        made = [gr.node_features(nodes, ue, TYPES), gr.descriptors(nodes, ue, "atom", {"A": 12.0}, {"N": 0.5}, ["N", "R"]), gr.propagate(x, ue, 2, 2)]
        made[1] = made[1].withColumn("mol_weight", F.round("mol_weight", 6))
        return [sorted(map(repr, map(tuple, df.collect()))) for df in made]

    once = steps()
    assert len(once[0]) == len(once[2]) == 34 and len(once[1]) == 5
    for limit in (25, 0):  # some, and all, go by joins
        monkeypatch.setattr(gr, "GRAPH_ROWS", limit)
        assert steps() == once


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    nodes, ue = odd_graphs(spark)
    monkeypatch.setattr(gr, "PARTITION_ROWS", 2)
    for df in (gr.node_features(nodes, ue, TYPES), gr.descriptors(nodes, ue, "atom", {"A": 1.0}, {"A": 1.0}, ["N"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "REPARTITION_BY_NUM" in plan and "hashpartitioning(graph_id" in plan
    rows, large = gr._split(nodes, ue, [])
    assert large is None and rows.rdd.getNumPartitions() > 40


def test_drug_matrix_has_the_whole_fingerprint_and_all_descriptors(spark, tmp_path):
    from dyad.plans import q_graph

    rows = [(g, s, "ANR"[(g + s) % 3], float(s % 4), 0.09 if s == 2 else 0.0, 0.01 * s) for g in (1, 2) for s in range(3 * g)] + [(5, 1, None, 2.0, 0.0, 0.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double, l_tax double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (2,), (3,), (5,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.drug_id: r.asDict() for r in q_graph.q_drug_matrix(spark, str(tmp_path)).collect()}
    bits, told = {}, {r.graph_id: r for r in q_graph.q_graph_descriptors(spark, str(tmp_path)).collect()}
    for r in q_graph.q_wl_fingerprint(spark, str(tmp_path)).filter("bit is not null").collect():
        bits.setdefault(r.graph_id, []).append(r.bit)
    assert set(got) == {1, 2, 3, 5}
    for g in (1, 2):
        assert got[g]["fingerprint"] == ",".join(map(str, sorted(bits[g]))) and got[g]["n_bits"] == len(bits[g]) > 3
    assert got[3]["fingerprint"] == got[5]["fingerprint"] == "" and got[3]["n_bits"] == 0
    for g in (1, 2, 5):
        assert all(got[g][c] == told[g][c] for c in ("mol_weight", "logp", "tpsa", "donors", "acceptors", "rot_bonds"))
    assert got[2]["tpsa"] > 0 and got[2]["acceptors"] > 0 and all(got[3][c] == 0 for c in ("mol_weight", "logp", "tpsa", "donors", "acceptors", "rot_bonds"))


def test_fingerprints_of_whole_rows_need_no_exchange_of_them(spark, monkeypatch):
    texts = [(1, "a b a c d".split()), (2, []), (2, None), (3, "b b c".split()), (3, "c b d".split()), (None, ["x", "y"]), (None, ["x", "z"]),
             (4, None), (5, ["a", "b"]), (6, [f"w{i * i % 17}" for i in range(60)])]
    docs = spark.createDataFrame(texts, "graph_id long, w array<string>")

    def bits(made):
        return sorted(map(repr, map(tuple, made.collect())))

    want = bits(gr.circular_fingerprint(*gr.token_graphs(docs, "w"), F.col("token"), 2, 64))
    for limit in (200_000, 20, 0):  # all rows, some and none
        monkeypatch.setattr(gr, "GRAPH_ROWS", limit)
        nodes, ue, rows = gr.token_graph_rows(docs, "w")
        assert bits(gr.circular_fingerprint(nodes, ue, F.col("token"), 2, 64, rows=rows)) == want and len(want) > 30
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert nodes.filter("graph_id in (1, 6)").count() == (0 if limit > 20 else nodes.filter("graph_id = 6").count() + 4 * (limit == 0))
