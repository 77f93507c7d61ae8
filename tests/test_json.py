"""JSON documents: typed rows, null negatives, rejects, round trip."""

from pyspark.sql import functions as F

from dyad.sources import json_docs as jd


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, document string")


def test_cache_documents_and_rejects(spark):
    texts = ['{"name::a": null, "name::b": {"source": "PubChem", "smiles": "C", "more": 1}}', "{}", '{"name::c": {"source": "ChEMBL", "chembl_id": "X"',
             "[1]", "null", "", None, "   ", '{"name::d": 5}', '{"name::é": {"source": null, "chembl_id": null, "smiles": null}}']
    rows, bad = jd.cache_entries(docs(spark, *texts))
    got = {r.name_key: tuple(r)[1:] for r in rows.collect()}
    assert got == {"name::a": (None, None, None, True), "name::b": ("PubChem", None, "C", False), "name::é": (None, None, None, False)}
    assert {r.id: r.document for r in bad.collect()} == {i: texts[i] for i in (2, 3, 4, 5, 6, 7, 8)}
    none, nobad = jd.cache_entries(docs(spark, "{}").limit(0))
    assert none.count() == nobad.count() == 0


def test_cache_round_trip_through_files(spark, tmp_path):
    rows = [(f"name::{i}\n\"'{{", None if i % 3 else "ChEMBL", None, f"S{i}" if i % 2 else None, i % 4 == 0) for i in range(50)]
    cache = spark.createDataFrame(rows, "name_key string, source string, chembl_id string, smiles string, is_negative boolean")
    path = str(tmp_path / "cache")
    jd.write_cache(cache, path)
    again, bad = jd.cache_entries(jd.read_documents(spark, path))
    want = {r[0]: (None, None, None, True) if r[4] else (*r[1:4], False) for r in rows}
    assert {r.name_key: tuple(r)[1:] for r in again.collect()} == want and bad.count() == 0
    assert jd.cache_documents(cache, shards=5).count() <= 5
    whole, _ = jd.cache_entries(jd.read_documents(spark, path, lines=False))
    assert whole.count() == 50


def test_nested_payloads_keep_their_schema(spark):
    good = '{"molecules": [{"molecule_chembl_id": "A", "pref_name": "x", "molecule_structures": {"canonical_smiles": "C"}}, {"molecule_structures": null}, {}]}'
    parsed, bad = jd.parse(docs(spark, good, '{"molecules": []}', "{}", '{"molecules": 3}', good[:-4]), jd.SEARCH_PAYLOAD)
    assert parsed.schema["parsed"].dataType["molecules"].dataType.elementType["molecule_structures"].dataType.names == ["canonical_smiles", "standard_inchi_key"]
    hits = [tuple(r) for r in jd.search_hits(parsed).orderBy("id", "rank").collect()]
    assert hits == [(0, 0, "A", "x", "C", None), (0, 1, None, None, None, None), (0, 2, None, None, None, None)]
    assert sorted(r.id for r in bad.collect()) == [3, 4] and parsed.count() == 3
    props, worse = jd.parse(docs(spark, '{"PropertyTable": {"Properties": [{"CID": 1, "CanonicalSMILES": "CC"}, {"CID": 2}]}}', '{"PropertyTable": {}}',
                                 '{"PropertyTable": {"Properties": [{"CID": "one"}]}}'), jd.PROPERTY_PAYLOAD)
    got = {r.id: r.s for r in props.select("id", jd.first_property(F.col("parsed")).alias("s")).collect()}
    assert got == {0: "CC", 1: None} and [r.id for r in worse.collect()] == [2]
