"""Search, early-stopping and model queries.

Metric histories and trials come from ``events``: run = user_id, epoch = the
event's 1-based position in ``(ts, event_id)`` order within the run, score =
value; trials are all events numbered in ``(ts, event_id)`` order,
value = value, started at ts and finished ``value`` seconds later, with the
categorical parameter ``props.k mod 3``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.operators import learn
from dyad.operators.order import dense_index
from dyad.plans import fixtures as fx
from dyad.plans.registry import r6, register
from dyad.session import cut_lineage

PATIENCE = 8
MIN_DELTA = 1e-4

# Search space of the tuned hybrid model (fixed values of the reference study):
# n_layers int 1..3; hidden_i log-int 128..1024 present when n_layers > i;
# dropout 0..0.4; lr log 1e-4..5e-3; weight_decay log 1e-8..1e-3;
# batch_size one of 256, 512, 1024.
SPACE = [
    learn.Param("n_layers", "int", 1, 3),
    learn.Param("hidden_0", "logint", 128, 1024, parent="n_layers", min_parent=1),
    learn.Param("hidden_1", "logint", 128, 1024, parent="n_layers", min_parent=2),
    learn.Param("hidden_2", "logint", 128, 1024, parent="n_layers", min_parent=3),
    learn.Param("dropout", "float", 0.0, 0.4),
    learn.Param("lr", "logfloat", 1e-4, 5e-3),
    learn.Param("weight_decay", "logfloat", 1e-8, 1e-3),
    learn.Param("batch_size", "cat", choices=(256, 512, 1024)),
]

HIST_SQL = """h AS (SELECT user_id run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) epoch, value v FROM events)"""
TRIALS_SQL = """trials AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 number, value, ts datetime_start,
       make_timestamp(epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT)) datetime_complete,
       CAST(json_extract(props, '$.k') AS INTEGER) % 3 cat
  FROM events)"""


def history_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    h = dense_index(ev, ["ts", "event_id"], out="_e", by="user_id")
    return h.select(F.col("user_id").alias("run"), (F.col("_e") + 1).alias("epoch"), F.col("value").alias("v"))


def trials_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.table(spark, sf_dir, "events")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    t = dense_index(ev.select("ts", "event_id", "value", "props"), ["ts", "event_id"], out="number")
    return t.select(
        "number", "value", F.col("ts").alias("datetime_start"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1e6).cast("bigint")).alias("datetime_complete"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(3)).alias("cat"),
    )


ORACLE_EARLY_STOP = f"""WITH RECURSIVE {HIST_SQL},
 st AS (SELECT DISTINCT run, 0::BIGINT epoch, 'inf'::DOUBLE best, 0::BIGINT be, 0 w, 0::BIGINT stop FROM h
        UNION ALL
        SELECT h.run, h.epoch, CASE WHEN h.v < best - {MIN_DELTA} THEN h.v ELSE best END,
               CASE WHEN h.v < best - {MIN_DELTA} THEN h.epoch ELSE be END,
               CASE WHEN h.v < best - {MIN_DELTA} THEN 0 ELSE w + 1 END,
               CASE WHEN h.v < best - {MIN_DELTA} THEN 0 WHEN w + 1 >= {PATIENCE} THEN h.epoch ELSE 0 END
          FROM st JOIN h ON h.run = st.run AND h.epoch = st.epoch + 1 WHERE stop = 0)
SELECT run, round(best, 6) best, be best_epoch, stop stop_epoch, epoch n_epochs FROM st
QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1"""


@register("early_stop", ORACLE_EARLY_STOP)
def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early-stopping replay per run (patience 8, min_delta 1e-4)."""
    out = learn.early_stop(history_df(spark, sf_dir), "run", "epoch", "v", PATIENCE, MIN_DELTA)
    return out.select("run", r6("best").alias("best"), "best_epoch", "stop_epoch", "n_epochs")


@register("trial_running_best", f"""WITH {TRIALS_SQL}
SELECT number, round(value, 6) value, round(min(value) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING), 6) best_so_far,
       round((epoch_us(datetime_complete) - epoch_us(datetime_start)) / 1e6, 6) duration_s FROM trials""")
def q_trial_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value so far in trial order and each trial's duration."""
    h = learn.trial_history(trials_df(spark, sf_dir), start="datetime_start", complete="datetime_complete")
    return h.select("number", r6("value").alias("value"), r6("best_so_far").alias("best_so_far"),
                    r6("duration_s").alias("duration_s"))


@register("trial_best", f"""WITH {TRIALS_SQL}
SELECT number, round(value, 6) value, cat FROM trials ORDER BY value, number LIMIT 1""")
def q_trial_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmin trial."""
    b = learn.best_trial(trials_df(spark, sf_dir).select("number", "value", "cat"))
    return b.select("number", r6("value").alias("value"), "cat")


@register("trial_best_by_category", f"""WITH {TRIALS_SQL}
SELECT cat, round(min(value), 6) best, count(*) n_trials FROM trials GROUP BY cat""")
def q_trial_best_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value per categorical parameter level."""
    b = learn.best_by_category(trials_df(spark, sf_dir), "cat")
    return b.select("cat", r6("best").alias("best"), "n_trials")


def _u(name: str) -> str:
    return f"(('0x' || substr(md5('42:' || CAST(number AS VARCHAR) || ':{name}'), 1, 13))::BIGINT / {float(16 ** 13)})"


SPACE_SQL = f"""SELECT number,
  least(floor(1 + {_u('n_layers')} * 3), 3)::BIGINT n_layers,
  {{h0}}::DOUBLE hidden_0, {{h1}}::DOUBLE hidden_1, {{h2}}::DOUBLE hidden_2,
  round(0.0 + {_u('dropout')} * 0.4, 6) dropout,
  round(exp(ln(1e-4) + {_u('lr')} * (ln(5e-3) - ln(1e-4))), 9) lr,
  round(exp(ln(1e-8) + {_u('weight_decay')} * (ln(1e-3) - ln(1e-8))), 12) weight_decay,
  [256, 512, 1024][least(floor({_u('batch_size')} * 3), 2)::INTEGER + 1] batch_size
FROM trials"""


def _hidden(i: int) -> str:
    draw = f"least(greatest(floor(exp(ln(128) + {_u(f'hidden_{i}')} * (ln(1025) - ln(128)))), 128), 1024)::BIGINT"
    return f"CASE WHEN least(floor(1 + {_u('n_layers')} * 3), 3) >= {i + 1} THEN {draw} END"


@register("sample_space", f"WITH {TRIALS_SQL} " + SPACE_SQL.format(h0=_hidden(0), h1=_hidden(1), h2=_hidden(2)))
def q_sample_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: seeded draws of the search space (float, log-float, int, log-int,
    categorical, conditional) for every trial."""
    drawn = learn.draw(trials_df(spark, sf_dir).select("number"), SPACE, seed=42)
    hidden = [F.col(f"hidden_{i}").cast("double").alias(f"hidden_{i}") for i in range(3)]
    return drawn.select("number", "n_layers", *hidden, r6("dropout").alias("dropout"),
                        F.round("lr", 9).alias("lr"), F.round("weight_decay", 12).alias("weight_decay"),
                        F.col("batch_size").cast("int").alias("batch_size"))


# ------------------------------------------------------------------ MLlib (rows-only checks)
def training_frame(spark: SparkSession, sf_dir: str, with_folds: bool = False, group: str = "drug_id") -> DataFrame:
    """Pairs with split (and group folds) and an assembled feature vector
    ``[cell vector, drug descriptors (2), tissue one-hot]``."""
    from dyad.operators.joins import broadcastable, join_small
    from dyad.operators.matrix import assemble, fit_onehot, onehot
    from dyad.operators.splits import balanced_group_kfold
    from dyad.plans.q_eval import split_df

    sp = split_df(spark, sf_dir)
    if with_folds:
        sp = balanced_group_kfold(sp, group, 5)
    cellv = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("cell_vec"))
    drugd = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_size", "p_retailprice")
    # written narrow; the vectors are joined to it in every pass if they can be broadcast
    small = broadcastable(cellv)
    known = join_small(sp, cellv.select("cell_id"), "cell_id", how="left_semi").join(drugd, "drug_id")
    pairs = cut_lineage(known.withColumnRenamed("ln_ic50", "label").select(
        "cell_id", "drug_id", "dataset", "split", *(["fold"] if with_folds else []), "label", "tissue", "p_size", "p_retailprice"))
    df = pairs.join(F.broadcast(cellv) if small else cellv, "cell_id")
    df = onehot(df, "tissue", fit_onehot(pairs, "tissue"))
    df = assemble(df, ["cell_vec", "p_size", "p_retailprice", "tissue_onehot"])
    df = df.select("cell_id", "drug_id", "dataset", "split", *(["fold"] if with_folds else []), "label", "features")
    return df if small else cut_lineage(df)


def metrics_rows(pred: DataFrame, by: str) -> DataFrame:
    from dyad.operators.evaluate import evaluate

    return evaluate(pred, "label", "prediction", by=by, metrics=("rmse", "mae", "spearman", "pearson", "n"))


#: patience of the registered fit (the library's default is the reference's 200); its most rounds are the reference's 5000
GBT_PATIENCE = 10
GBT_PARAMS = {"maxDepth": 3, "stepSize": 0.3}


def boosted(spark: SparkSession, sf_dir: str):
    from dyad.operators.staged import MAX_ROUNDS, fit_with_patience

    tf = training_frame(spark, sf_dir)
    fit_rows = tf.filter(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    return tf, fit_with_patience(fit_rows, "is_val", GBT_PARAMS, MAX_ROUNDS, GBT_PATIENCE)


@register("gbt_early_stop")
def q_gbt_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T9: boosted trees trained on train, stopped by patience on val, scored on every split."""
    tf, model = boosted(spark, sf_dir)
    return metrics_rows(model.ensemble.predict(tf), "split")


@register("gbt_rounds")
def q_gbt_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation loss after every round, and which round was best and which the stop."""
    _, model = boosted(spark, sf_dir)
    rows = [(i, loss, i == model.best_round, i == model.stop_round) for i, loss in enumerate(model.losses, 1)]
    return spark.createDataFrame(rows, "round int, loss double, is_best boolean, is_stop boolean")


#: rounds and trials of the boosted searches (README: times)
SEARCH_ROUNDS = 5
SEARCH_TRIALS = 3


@register("gbt_cv")
def q_gbt_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + T5: group 5-fold CV over sampled trials; mean fold RMSE per trial."""
    tf = training_frame(spark, sf_dir, with_folds=True)
    est = learn.gbt({"maxIter": SEARCH_ROUNDS, "maxDepth": 3})
    grid_space = [learn.Param("stepSize", "logfloat", 0.05, 0.5), learn.Param("maxDepth", "int", 2, 4)]
    trials = learn.sample_space(spark, SEARCH_TRIALS, grid_space, seed=42)
    maps = learn.param_maps_from_trials(trials, est, {"stepSize": "stepSize", "maxDepth": "maxDepth"})
    _, avg = learn.cross_validate(tf, est, maps, "fold", parallelism=3)
    rows = [(i, float(v)) for i, v in enumerate(avg)]
    return spark.createDataFrame(rows, "number long, value double")


@register("refit_best")
def q_refit_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best trial on val -> refit on train + val with a fixed iteration
    count -> test metrics once."""
    tf = training_frame(spark, sf_dir)
    space = [learn.Param("stepSize", "logfloat", 0.05, 0.5), learn.Param("maxDepth", "int", 2, 4)]
    trials = learn.sample_space(spark, SEARCH_TRIALS, space, seed=7).collect()
    results = []
    for t in trials:
        est = learn.gbt({"maxIter": SEARCH_ROUNDS, "maxDepth": int(t["maxDepth"]), "stepSize": float(t["stepSize"])})
        m = learn.fit_on_split(tf, est)
        val = metrics_rows(learn.score(m, tf.filter(F.col("split") == "val")), "split").first()
        results.append((t["number"], val["rmse"], t))
    best = min(results, key=lambda r: (r[1], r[0]))[2]
    est = learn.gbt({"maxIter": SEARCH_ROUNDS, "maxDepth": int(best["maxDepth"]), "stepSize": float(best["stepSize"])})
    final = learn.fit_on_split(tf, est, train=("train", "val"))
    return metrics_rows(learn.score(final, tf.filter(F.col("split") == "test")), "split")


@register("early_stop_stream", ORACLE_EARLY_STOP)
def q_early_stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 as a Structured Streaming job: the events table is replayed as a
    file stream into a stateful per-run operator whose updates are appended to
    a durable table; the last update of each run equals the batch replay."""
    import uuid

    from dyad.session import ensure_checkpoint_dir
    from dyad.streaming.early_stop import early_stop_stream

    events = fx.table(spark, sf_dir, "events")
    # a file stream watches a directory; the glob picks the events file out of it
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = early_stop_stream(stream, "user_id", "value", ["ts", "event_id"], PATIENCE, MIN_DELTA)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/early_stop_{uuid.uuid4().hex[:12]}"

    def append(batch: DataFrame, batch_id: int) -> None:
        # each micro-batch's updated runs go to a durable table, tagged by batch
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{root}/updates")

    q = (out.writeStream.outputMode("update").foreachBatch(append)
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    updates = spark.read.parquet(f"{root}/updates")
    last = updates.groupBy("run").agg(F.max_by(F.struct("best", "best_epoch", "stop_epoch", "n_epochs"),
                                               F.struct("batch_id", "n_epochs")).alias("s"))
    return last.select("run", r6("s.best").alias("best"), "s.best_epoch", "s.stop_epoch", "s.n_epochs")
