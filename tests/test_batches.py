"""Disjoint-union batches and training samples against a plain assembly."""

from dyad.operators.batches import assign_batches, disjoint_union, pair_samples


def test_batches_equal_a_plain_union(spark):
    graphs = {1: (["n0", "n1", "n2"], [("n0", "n1"), ("n1", "n0"), ("n1", "n2"), ("n2", "n1")]), 2: (["z"], []),
              5: (["a", "b"], [("a", "b"), ("b", "a"), ("a", "ghost")])}
    nodes = spark.createDataFrame([(g, n, float(i + g)) for g, (ns, _) in graphs.items() for i, n in enumerate(ns)], "graph_id long, node_id string, x double")
    edges = spark.createDataFrame([(g, s, d) for g, (_, es) in graphs.items() for s, d in es], "graph_id long, src string, dst string")
    drugs = [1, 5, 2, 1, 9, None, 5, 5, 1, 2, 1]
    pairs = spark.createDataFrame([(i, d, f"c{i}") for i, d in enumerate(drugs)], "i long, drug_id long, other string").repartition(3)
    slots = assign_batches(pairs, ["i"], size=4)
    made = disjoint_union(slots, nodes, edges)
    want_nodes, want_edges, want_slots = [], [], []
    for b in range(0, len(drugs), 4):
        offset = 0
        for slot, d in enumerate(drugs[b : b + 4]):
            ns, es = graphs.get(d, ([], []))
            want_slots.append((b // 4, slot, b + slot, len(ns), offset))
            want_nodes += [(b // 4, offset + i, slot, float(i + d)) for i in range(len(ns))]
            want_edges += [(b // 4, offset + ns.index(s), offset + ns.index(t)) for s, t in es if t in ns]
            offset += len(ns)
    assert sorted(tuple(r) for r in made.slots.select("batch", "slot", "i", "n_nodes", "offset").collect()) == want_slots
    assert sorted(tuple(r) for r in made.nodes.collect()) == sorted(want_nodes) and made.nodes.columns == ["batch", "node", "slot", "x"]
    assert sorted(tuple(r) for r in made.edges.collect()) == sorted(want_edges)
    empty = disjoint_union(slots.limit(0), nodes, edges)
    assert empty.nodes.count() == empty.edges.count() == empty.slots.count() == 0
    bare = disjoint_union(slots, nodes.limit(0), edges)
    assert bare.nodes.count() == 0 and bare.slots.agg({"n_nodes": "max"}).first()[0] == 0


def test_shuffled_batches_are_a_seeded_permutation(spark):
    pairs = spark.range(50).withColumnRenamed("id", "i")
    a = {r.i: (r.batch, r.slot) for r in assign_batches(pairs, ["i"], 8, seed=1).collect()}
    b = {r.i: (r.batch, r.slot) for r in assign_batches(pairs.repartition(7), ["i"], 8, seed=1).collect()}
    assert a == b and sorted(a.values()) == [(i // 8, i % 8) for i in range(50)]
    assert a != {r.i: (r.batch, r.slot) for r in assign_batches(pairs, ["i"], 8, seed=2).collect()}


def test_samples_with_and_without_tissue(spark):
    pairs = spark.createDataFrame([("c1", 1, 0.5), ("c2", 1, None), ("c1", 7, 2.0), (None, 1, 1.0)], "cell_id string, drug_id long, ln_ic50 double")
    drugs = spark.createDataFrame([(1, [1.0, 2.0])], "drug_id long, vec array<double>")
    cells = spark.createDataFrame([("c1", [3.0]), ("c2", None)], "cell_id string, vec array<double>")
    rows = {r.cell_id: r["sample"] for r in pair_samples(pairs, drugs, cells).collect()}
    assert rows["c1"].asDict() == {"drug": [1.0, 2.0], "expr": [3.0], "y": 0.5}
    assert rows["c2"].asDict() == {"drug": [1.0, 2.0], "expr": None, "y": None} and len(rows) == 2
    (with_t,) = pair_samples(pairs, drugs, cells, cells.filter("cell_id = 'c1'")).collect()
    assert with_t["sample"].tissue == [3.0]


def test_graphs_of_many_packs_and_large_graphs(spark, monkeypatch):
    from dyad.operators import batches, graph

    nodes = spark.createDataFrame([(g, n, float(n)) for g in (1, 2) for n in range(3, 3 + 7 * g)] + [(1, 4, 0.5), (None, 1, 1.0), (2, None, 2.0)],
                                  "graph_id long, node_id long, x double")
    edges = spark.createDataFrame([(g, n, n + 1) for g in (1, 2) for n in range(2, 3 + 7 * g)] + [(1, 4, 4)], "graph_id long, src long, dst long")
    slots = assign_batches(spark.createDataFrame([(i, d) for i, d in enumerate([2, 1, 1, 9, 2])], "i long, drug_id long"), ["i"], size=3)

    def told():
        made = disjoint_union(slots, nodes, edges)
        spread = sorted((r.batch, r.slot, r.node) for r in made.nodes.collect())
        return spread, sorted(map(tuple, made.edges.collect())), sorted((r.batch, r.slot, r.n_nodes, r.offset) for r in made.slots.collect()), made

    whole = told()
    assert len(whole[0]) == 2 * 15 + 2 * 8 and len(whole[1]) == 2 * 13 + 2 * (6 + 2 + 4) and whole[2][1] == (0, 1, 8, 15)
    monkeypatch.setattr(batches, "PACK", 2)
    *packed, made = told()
    assert packed == list(whole[:3])
    assert made.edges._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    monkeypatch.setattr(graph, "GRAPH_ROWS", 20)
    assert list(told()[:3]) == packed
