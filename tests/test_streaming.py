import os
import tempfile

from dyad.operators.learn import early_stop
from dyad.streaming.early_stop import early_stop_stream


def test_stream_equals_batch(spark):
    rows = []
    for run in range(3):
        for e in range(1, 30):
            rows.append((run, e, e, float(((run + 3) * e * 7919) % 97) / (e + 1)))
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double")
    d = tempfile.mkdtemp(dir="/tmp")
    df.write.parquet(os.path.join(d, "ev"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "ev"))
    q = (early_stop_stream(stream, "user_id", "value", ["ts", "event_id"], patience=4, min_delta=1e-4)
         .writeStream.outputMode("update").format("memory").queryName("es_test")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["run"]: (r["best_epoch"], r["stop_epoch"], r["n_epochs"]) for r in spark.table("es_test").collect()}
    batch = early_stop(df.selectExpr("user_id run", "ts epoch", "value v"), "run", "epoch", "v", 4, 1e-4)
    exp = {r["run"]: (r["best_epoch"], r["stop_epoch"], r["n_epochs"]) for r in batch.collect()}
    assert got == exp


def test_stream_orders_runs_longer_than_an_arrow_chunk(spark):
    import random

    n = 12_000
    rows = [(run, e, e, float(n - e) if run else float(-min(e, 7919))) for run in (0, 1) for e in range(1, n + 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double").coalesce(1)
    d = tempfile.mkdtemp(dir="/tmp")
    df.write.parquet(os.path.join(d, "ev"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "ev"))
    q = (early_stop_stream(stream, "user_id", "value", ["ts", "event_id"], patience=400)
         .writeStream.outputMode("update").format("memory").queryName("es_long")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["run"]: (r["best_epoch"], r["stop_epoch"], r["n_epochs"]) for r in spark.table("es_long").collect()}
    assert got == {0: (7919, 8319, 8319), 1: (n, 0, n)}
