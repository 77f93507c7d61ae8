import os
import tempfile
import zipfile

import pytest

from dyad.sources.readers import load_cells, load_compounds, load_responses, read_matrix
from dyad.sources.writers import write_report


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_cells_header_discovery(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "cells.csv")
    _write(p, "Sample Name,COSMIC identifier,GDSC Tissue descriptor 1,GDSC Tissue descriptor 2\n"
              "a,1,lung,NSCLC\nb,2,skin,\nc,3,,\nc,3,,\n")
    got = sorted(tuple(r) for r in load_cells(spark, p).collect())
    assert got == [("1", "lung / NSCLC"), ("2", "skin"), ("3", "unknown")]
    _write(p, "name,tissue\na,x\n")
    with pytest.raises(KeyError):
        load_cells(spark, p)


def test_responses_and_compounds(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "r.csv")
    _write(p, "cell_line_name,Cosmic_Id,DRUG_ID,drug_name,ln_ic50,extra\nA,1,10,x,0.5,z\nB,2,11,y,bad,z\n")
    rows = load_responses(spark, p, "GDSC1").collect()
    assert rows[0]["COSMIC_ID"] == 1 and rows[0]["dataset"] == "GDSC1" and rows[1]["LN_IC50"] is None
    c = os.path.join(d, "c.csv")
    _write(c, "DRUG_ID,NAME\n1,a\n")
    with pytest.raises(KeyError):
        load_compounds(spark, c)


def test_matrix_plain_and_zip(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    body = "GENE_SYMBOLS\tGENE_title\tDATA.1\tDATA.2\ng1\tt\t1.5\tx\ng2\tt\t2\t3\n"
    plain = os.path.join(d, "expr.txt")
    _write(plain, body)
    got = sorted((r["cell_id"], r["gene"], r["value"]) for r in read_matrix(spark, plain).collect())
    assert got == [("1", "g1", 1.5), ("1", "g2", 2.0), ("2", "g1", None), ("2", "g2", 3.0)]
    zpath = os.path.join(d, "expr2.txt.zip")
    with zipfile.ZipFile(zpath, "w") as zf:
        zf.writestr("expr2.txt", body)
    got_zip = sorted((r["cell_id"], r["gene"], r["value"]) for r in read_matrix(spark, os.path.join(d, "expr2.txt")).collect())
    assert got_zip == got


def test_report_rejects_unknown_format(spark):
    with pytest.raises(ValueError):
        write_report(spark.range(1), "/tmp/never", fmt="xlsx")


def test_writer_round_trips(spark):
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.linalg import Vectors

    from dyad.operators.profile import observed_counts
    from dyad.sources.readers import read_feature_store, read_graph_store, read_table
    from dyad.sources.writers import (params_frame, save_model, write_feature_store, write_graph_store, write_parquet,
                                      write_table_csv)

    d = tempfile.mkdtemp(dir="/tmp")
    pairs = spark.createDataFrame([("1", 10, 0.5, "train"), ("2", 11, 1.5, "test")],
                                  "cell_id string, drug_id long, ln_ic50 double, split string")
    observed, obs = observed_counts(pairs)
    write_parquet(observed, f"{d}/pairs", partition_by=["split"])
    assert obs.get["rows"] == 2
    assert read_table(spark, f"{d}/pairs").count() == 2
    write_table_csv(pairs, f"{d}/pairs_csv")
    assert spark.read.option("header", True).csv(f"{d}/pairs_csv").count() == 2
    store = spark.createDataFrame([(10, "CC", [0.1, 0.2])], "drug_id long, smiles string, embedding array<double>")
    write_feature_store(store, f"{d}/store", "hashing-256")
    back = read_feature_store(spark, f"{d}/store").first()
    assert back["model_name"] == "hashing-256" and len(back["embedding"]) == 2
    nodes = spark.createDataFrame([(1, 0, "A")], "graph_id long, node_id long, atom string")
    edges = spark.createDataFrame([], "graph_id long, src long, dst long")
    write_graph_store(nodes, edges, f"{d}/graphs")
    n2, e2 = read_graph_store(spark, f"{d}/graphs")
    assert n2.count() == 1 and e2.count() == 0
    train = spark.createDataFrame([(Vectors.dense([1.0]), 2.0), (Vectors.dense([2.0]), 4.0)], ["features", "label"])
    model = LinearRegression().fit(train)
    save_model(model, f"{d}/model", {"input_dim": 1, "lr": 0.01}, spark)
    meta = spark.read.json(f"{d}/model/meta").first()["params"]
    assert meta["input_dim"] == "1"
    assert params_frame(spark, {"a": 1}).count() == 1


def test_archives_are_told_by_content_and_read_member_by_member(spark, monkeypatch):
    from dyad.sources import readers

    monkeypatch.setattr(readers, "CHUNK_CELLS", 8)  # two rows a chunk
    d = tempfile.mkdtemp(dir="/tmp")
    table = lambda tag: "GENE_SYMBOLS\tGENE_title\tDATA.1\tDATA.2\n" + "".join(f"{tag}{i}\tt\t{i}\tbad\n" for i in range(7))
    named_text = os.path.join(d, "expr.txt")  # an archive without the name of one
    with zipfile.ZipFile(named_text, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("a.tsv", table("a"))
        zf.writestr("folder/", "")
        zf.writestr("folder/b.tsv", table("b"))
        zf.writestr("empty.tsv", "")
    named_zip = os.path.join(d, "plain.zip")  # a text with the name of an archive
    _write(named_zip, table("c"))
    want = lambda *tags: sorted((c, f"{t}{i}", float(i) if c == "1" else None) for t in tags for i in range(7) for c in "12")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    archive = read_matrix(spark, named_text)
    assert rows(archive) == want("a", "b") and archive.rdd.getNumPartitions() >= 2
    assert rows(read_matrix(spark, named_zip)) == want("c")
    assert rows(read_matrix(spark, os.path.join(d, "plain"))) == want("c")
    assert rows(read_matrix(spark, d)) == want("a", "b", "c") and rows(read_matrix(spark, f"{d}/*.txt")) == want("a", "b")
    with zipfile.ZipFile(os.path.join(d, "none.txt"), "w"):
        pass
    assert read_matrix(spark, os.path.join(d, "none.txt")).count() == 0
    with pytest.raises(FileNotFoundError):
        read_matrix(spark, os.path.join(d, "absent"))


def test_descriptor_columns():
    from dyad.sources.readers import descriptor_columns

    assert descriptor_columns(["GDSC Tissue descriptor 2", "x", "GDSC\nTissue Descriptor"]) == ["GDSC\nTissue Descriptor", "GDSC Tissue descriptor 2"]
    assert descriptor_columns(["gdsc2 tissue descriptor"]) == ["gdsc2 tissue descriptor"] * 2
    assert descriptor_columns(["tissue descriptor 1", "gdsc tissue 1"]) == [None, None]


def test_bad_ids_are_null_not_a_failed_job(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "r.csv")
    _write(p, "CELL_LINE_NAME,COSMIC_ID,DRUG_ID,DRUG_NAME,LN_IC50\nA,one,10,x,0.5\nB,2,,y,1.5\n")
    assert [(r.COSMIC_ID, r.DRUG_ID) for r in load_responses(spark, p, "G").orderBy("CELL_LINE_NAME").collect()] == [(None, 10), (2, None)]
