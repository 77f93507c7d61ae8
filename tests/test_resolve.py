import pytest

from dyad.operators.resolve import lookup_strict, name_candidates, resolve_names, upsert_cache


def test_priority_resolution(spark):
    screened = spark.createDataFrame([(1, "Alpha", "beta; gamma"), (2, "Delta", "")], "drug_id long, drug_name string, synonyms string")
    d = spark.createDataFrame([
        ("name::alpha", "ChEMBL", None, "X", True),      # negative: skipped
        ("name::beta", "PubChem", None, "B-pub", False),
        ("name::beta", "ChEMBL", "C1", "B-chembl", False),
        ("name::gamma", "ChEMBL", "C2", "G", False),
    ], "name_key string, source string, chembl_id string, smiles string, is_negative boolean")
    out = {r["drug_id"]: r for r in resolve_names(name_candidates(screened), d).collect()}
    assert set(out) == {1}
    assert out[1]["smiles"] == "B-chembl" and out[1]["pos"] == 1


def test_lookup_strict_raises(spark):
    df = spark.createDataFrame([(1,), (2,)], "drug_id long")
    store = spark.createDataFrame([(1, [0.1])], "drug_id long, embedding array<double>")
    with pytest.raises(ValueError):
        lookup_strict(df, store, "drug_id")


def test_upsert(spark):
    old = spark.createDataFrame([("k1", 1), ("k2", 2)], "name_key string, v int")
    new = spark.createDataFrame([("k2", 20), ("k3", 30)], "name_key string, v int")
    assert sorted(upsert_cache(old, new).collect()) == sorted([("k1", 1), ("k2", 20), ("k3", 30)])


def test_small_file_of_wide_rows_is_not_broadcast(spark, tmp_path):
    from pyspark.sql import functions as F

    from dyad.operators.joins import BROADCAST_BYTES, broadcastable, estimated_bytes

    path = str(tmp_path / "wide")
    spark.range(20_000).select("id", F.array_repeat(F.lit(1.5), 600).alias("v")).write.parquet(path)
    wide = spark.read.parquet(path)
    assert estimated_bytes(wide) < BROADCAST_BYTES and not broadcastable(wide) and not broadcastable(wide, known_rows=20_000)
    assert broadcastable(wide.select("id"))


def test_search_best_equals_best_match_over_all_hits(spark):
    import random

    from pyspark.sql import functions as F

    from dyad.operators.resolve import best_match, search_best

    r = random.Random(0)
    words = ["acid", "sodium", "beta", "oxide", "Salt", "x1", "x2"]
    mols = [(i, " ".join(r.sample(words, r.randrange(1, 4))), None if i == 7 else i % 9) for i in range(80)] + [(90, None, 0), (91, "", 0)]
    asked = [(" ".join(r.sample(words, r.randrange(1, 3))),) for _ in range(30)] + [("nothing",), ("",), (None,), ("ACID",)]
    m = spark.createDataFrame(mols, "molecule_id long, pref_name string, rank long")
    q = spark.createDataFrame(asked, "query string")
    tokens = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    got = {r_.query: tuple(r_) for r_ in search_best(q, m, tokens).collect()}
    want = {}
    for text in {a for (a,) in asked if a}:
        hits = [(n.lower() != text.lower(), k is None, k or 0, i, n, k) for i, n, k in mols
                if n and set(n.lower().split()) & set(text.lower().split())]
        if hits:
            ne, _, _, i, n, k = min(hits)
            want[text] = (text, i, n, k, int(not ne))
    assert got == want
    pairs = spark.createDataFrame([(t, i, n, k) for t in want for i, n, k in mols if n and k is not None
                                   and set(n.lower().split()) & set(t.lower().split())], "query string, molecule_id long, pref_name string, rank long")
    ranked = {r_.query: (r_.rank, r_.is_exact) for r_ in best_match(pairs).collect()}
    assert {t: (v[3], v[4]) for t, v in got.items()} == ranked
    assert search_best(q, m.limit(0), tokens).count() == 0 and search_best(q.limit(0), m, tokens).count() == 0
