"""Splits, folds, profiling and evaluation queries.

Predictions come from the group-mean baseline: the training mean of
``ln_ic50`` per ``(smiles, tissue)`` with the global training mean as fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.plans import fixtures as fx
from dyad.plans.registry import CELLS_SQL, PAIRS_SQL, pairs_df, r6, register
from dyad.session import cut_lineage

SPLIT_SQL = """g1 AS (SELECT drug_id, row_number() OVER (ORDER BY md5('42:' || CAST(drug_id AS VARCHAR)), drug_id) - 1 r1,
                count(*) OVER () n FROM (SELECT DISTINCT drug_id FROM pairs)),
 nt AS (SELECT any_value(n) n, ceil(round(0.2 * any_value(n), 9)) nt FROM g1),
 nv AS (SELECT ceil(round(0.1 / (1 - 0.2) * (n - nt), 9)) nv FROM nt),
 g2 AS (SELECT drug_id, row_number() OVER (ORDER BY md5('43:' || CAST(drug_id AS VARCHAR)), drug_id) - 1 r2
          FROM g1 CROSS JOIN nt WHERE r1 >= nt),
 split AS (SELECT g1.drug_id, CASE WHEN r1 < nt THEN 'test' WHEN r2 < nv THEN 'val' ELSE 'train' END split
             FROM g1 CROSS JOIN nt CROSS JOIN nv LEFT JOIN g2 USING (drug_id))"""
PRED_SQL = f"""{PAIRS_SQL},
 {SPLIT_SQL},
 sp AS (SELECT pairs.*, split FROM pairs JOIN split USING (drug_id)),
 tr AS (SELECT smiles, tissue, avg(ln_ic50) m FROM sp WHERE split = 'train' GROUP BY 1, 2),
 gm AS (SELECT avg(ln_ic50) gm FROM sp WHERE split = 'train'),
 pred AS (SELECT sp.*, coalesce(tr.m, gm.gm) pred FROM sp LEFT JOIN tr USING (smiles, tissue) CROSS JOIN gm)"""


def rank_select(src: str, by: str, y: str = "ln_ic50", p: str = "pred") -> str:
    return f"""SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0 ry,
                rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0 rp
           FROM {src}"""


def rank_sql(src: str, by: str, y: str = "ln_ic50", p: str = "pred") -> str:
    return f"rk AS ({rank_select(src, by, y, p)})"


def split_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyad.operators.splits import group_split

    return group_split(pairs_df(spark, sf_dir, materialize=True), "drug_id")


def predictions_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyad.operators.baseline import fit_group_mean, predict_group_mean

    sp = cut_lineage(split_df(spark, sf_dir))
    model = fit_group_mean(sp.filter(F.col("split") == "train"), ["smiles", "tissue"])
    return predict_group_mean(sp, model, ["smiles", "tissue"])


# ------------------------------------------------------------------ splits
@register("group_split", f"""WITH {PAIRS_SQL}, {SPLIT_SQL} SELECT drug_id, split FROM split""")
def q_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K5: two-stage leave-drug-out split (fractions of groups)."""
    return split_df(spark, sf_dir).select("drug_id", "split").distinct()


@register("split_counts", f"""WITH {PAIRS_SQL}, {SPLIT_SQL}
SELECT split, count(*) n FROM pairs JOIN split USING (drug_id) GROUP BY split""")
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split."""
    from dyad.operators.splits import rows_per_split

    return rows_per_split(split_df(spark, sf_dir))


@register("assignment_table", f"""WITH {PAIRS_SQL}, {SPLIT_SQL}
SELECT row_number() OVER (ORDER BY cell_id, drug_id, dataset) - 1 idx, cell_id, drug_id, dataset, split
  FROM pairs JOIN split USING (drug_id)""")
def q_assignment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + P20: ``(idx, cell_id, drug_id, split)`` keyed by business key, with a
    stable row index built from range partitions (no single-partition window)."""
    from dyad.operators.splits import stable_index

    sp = split_df(spark, sf_dir).select("cell_id", "drug_id", "dataset", "split")
    return stable_index(sp, ["cell_id", "drug_id", "dataset"]).select("idx", "cell_id", "drug_id", "dataset", "split")


KFOLD_SQL = """WITH RECURSIVE gs AS (SELECT l_partkey g, count(*) n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) i
                      FROM lineitem GROUP BY 1),
 st AS (SELECT 0::BIGINT i, NULL::BIGINT g, NULL::INTEGER f, [0, 0, 0, 0, 0]::BIGINT[] loads
        UNION ALL
        SELECT gs.i, gs.g, list_position(loads, list_min(loads)) - 1,
               list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN gs.n ELSE 0 END)
          FROM st JOIN gs ON gs.i = st.i + 1)
SELECT g l_partkey, f fold FROM st WHERE i > 0"""


@register("group_kfold", KFOLD_SQL)
def q_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: balanced group 5-fold over drugs (size desc -> lightest fold)."""
    from dyad.operators.splits import balanced_group_kfold

    li = fx.table(spark, sf_dir, "lineitem").select("l_partkey")
    return balanced_group_kfold(li, "l_partkey", 5).select("l_partkey", "fold").distinct()


@register("kfold_plain", f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, dataset,
       CAST((row_number() OVER (ORDER BY md5('42:' || CAST(cell_id AS VARCHAR) || ':' || CAST(drug_id AS VARCHAR) || ':' || dataset),
                                cell_id, drug_id, dataset) - 1) % 5 AS INTEGER) fold
  FROM pairs""")
def q_kfold_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: ungrouped 5-fold from a seeded stable index."""
    from dyad.operators.splits import plain_kfold

    return plain_kfold(pairs_df(spark, sf_dir), ["cell_id", "drug_id", "dataset"], 5).select(
        "cell_id", "drug_id", "dataset", "fold")


@register("leakage_audit", f"""WITH {PAIRS_SQL}, {SPLIT_SQL}
SELECT count(*) n_leaking FROM (SELECT drug_id FROM pairs JOIN split USING (drug_id)
 GROUP BY drug_id HAVING count(DISTINCT split) > 1)""")
def q_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: number of groups found in more than one split (0 when leakage-free)."""
    from dyad.operators.splits import leakage_audit

    return leakage_audit(split_df(spark, sf_dir), "drug_id").agg(F.count(F.lit(1)).alias("n_leaking"))


@register("subsample", f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, dataset, round(ln_ic50, 6) ln_ic50 FROM pairs
 ORDER BY md5('42:' || CAST(cell_id AS VARCHAR) || ':' || CAST(drug_id AS VARCHAR) || ':' || dataset), cell_id, drug_id, dataset
 LIMIT 1000""")
def q_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: seeded subsample of exactly 1,000 pairs (a sampling operator: the
    row count is the feature)."""
    from dyad.operators.splits import subsample

    s = subsample(pairs_df(spark, sf_dir), 1000, ["cell_id", "drug_id", "dataset"])
    return s.select("cell_id", "drug_id", "dataset", r6("ln_ic50").alias("ln_ic50"))


# ------------------------------------------------------------------ profiling
@register("coverage", "WITH " + CELLS_SQL + """
SELECT round(avg(CASE WHEN coalesce(p.p_type, '') <> '' THEN 1.0 ELSE 0.0 END), 6) smiles_coverage,
       round(avg(CASE WHEN coalesce(tissue, 'unknown') <> 'unknown' THEN 1.0 ELSE 0.0 END), 6) tissue_coverage
  FROM lineitem LEFT JOIN (SELECT *, CASE WHEN p_size > 5 THEN p_partkey END p_key FROM part) p ON l_partkey = p_key
  LEFT JOIN cells ON l_suppkey = cells.cell_id""")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: share of rows with a structure and with a known tissue."""
    from dyad.operators.profile import coverage
    from dyad.plans.dataset import attach_dimensions

    j = attach_dimensions(fx.responses(spark, sf_dir), fx.compounds_with_gaps(spark, sf_dir), fx.cells(spark, sf_dir))
    cov = coverage(j, {"smiles_coverage": F.coalesce("smiles", F.lit("")) != "",
                       "tissue_coverage": F.coalesce("tissue", F.lit("unknown")) != "unknown"})
    return cov.select(*[r6(c).alias(c) for c in cov.columns])


@register("value_counts", f"""WITH {PAIRS_SQL}
SELECT tissue, count(*) n FROM pairs GROUP BY tissue ORDER BY n DESC, tissue LIMIT 20""")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 tissues by pair count (a top-k report)."""
    from dyad.operators.profile import value_counts

    return value_counts(pairs_df(spark, sf_dir), "tissue", 20)


@register("describe", f"""WITH {PAIRS_SQL}
SELECT count(ln_ic50) count, round(avg(ln_ic50), 6) mean, round(stddev_samp(ln_ic50), 6) std, round(min(ln_ic50), 6) min,
       round(quantile_cont(ln_ic50, 0.25), 6) p25, round(quantile_cont(ln_ic50, 0.5), 6) p50,
       round(quantile_cont(ln_ic50, 0.75), 6) p75, round(max(ln_ic50), 6) max FROM pairs""")
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, sd, min, exact quartiles, max."""
    from dyad.operators.profile import describe

    d = describe(pairs_df(spark, sf_dir, materialize=True), "ln_ic50")
    return d.select("count", *[r6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@register("distinct_counts", f"""WITH {PAIRS_SQL}
SELECT count(DISTINCT cell_id) n_cell_id, count(DISTINCT drug_id) n_drug_id, count(*) n_rows, 8 n_columns FROM pairs""")
def q_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A14: distinct cells and drugs, and the table's shape."""
    from dyad.operators.profile import distinct_counts

    pairs = pairs_df(spark, sf_dir)
    counts = distinct_counts(pairs, ["cell_id", "drug_id"], with_rows=True)
    return counts.withColumn("n_columns", F.lit(len(pairs.columns)))


# ------------------------------------------------------------------ metrics
@register("predictions", f"""WITH {PRED_SQL}
SELECT cell_id, drug_id, dataset, split, round(ln_ic50, 6) ln_ic50, round(pred, 6) pred FROM pred""")
def q_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 stand-in: keyed predictions of the group-mean baseline for every pair."""
    p = predictions_df(spark, sf_dir)
    return p.select("cell_id", "drug_id", "dataset", "split", r6("ln_ic50").alias("ln_ic50"), r6("pred").alias("pred"))


@register("eval_all_by_split", f"""WITH {PRED_SQL}, {rank_sql('pred', 'split')}
SELECT split, round(sqrt(avg(power(ln_ic50 - pred, 2))), 6) rmse, round(avg(abs(ln_ic50 - pred)), 6) mae,
       round(corr(ry, rp), 6) spearman, round(corr(ln_ic50, pred), 6) pearson, count(*) n FROM rk GROUP BY split""")
def q_eval_all_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 + U4: rmse, mae, spearman, pearson for val/test/train in one pass."""
    from dyad.operators.evaluate import evaluate

    m = evaluate(predictions_df(spark, sf_dir), by="split", metrics=("rmse", "mae", "spearman", "pearson", "n"))
    return m.select("split", *[r6(c).alias(c) for c in ["rmse", "mae", "spearman", "pearson"]], "n")


@register("rmse_mae", f"""WITH {PRED_SQL}
SELECT round(sqrt(avg(power(ln_ic50 - pred, 2))), 6) rmse, round(avg(abs(ln_ic50 - pred)), 6) mae FROM pred
 WHERE split = 'test'""")
def q_rmse_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E2 on the test split."""
    from dyad.operators.evaluate import mae, rmse

    t = predictions_df(spark, sf_dir).filter(F.col("split") == "test")
    return t.agg(r6(rmse("ln_ic50", "pred")).alias("rmse"), r6(mae("ln_ic50", "pred")).alias("mae"))


@register("spearman", f"""WITH {PRED_SQL}, {rank_sql("(SELECT 1 one, * FROM pred)", 'one')}
SELECT round(corr(ry, rp), 6) spearman FROM rk""")
def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 over all pairs (one global group: ranks from range partitions)."""
    from dyad.operators.evaluate import spearman

    return spearman(predictions_df(spark, sf_dir), "ln_ic50", "pred").select(r6("spearman").alias("spearman"))


@register("pearson", f"""WITH {PRED_SQL} SELECT dataset, round(corr(ln_ic50, pred), 6) pearson FROM pred GROUP BY dataset""")
def q_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 per dataset."""
    from dyad.operators.evaluate import pearson

    return predictions_df(spark, sf_dir).groupBy("dataset").agg(r6(pearson("ln_ic50", "pred")).alias("pearson"))


@register("avg_rank", f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, dataset,
       rank() OVER (PARTITION BY dataset ORDER BY ln_ic50) + (count(*) OVER (PARTITION BY dataset, ln_ic50) - 1) / 2.0 rank
  FROM pairs""")
def q_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks with ties (the clip bounds are heavy ties) per dataset."""
    from dyad.operators.order import average_ranks

    r = average_ranks(pairs_df(spark, sf_dir), "ln_ic50", "dataset", out="rank")
    return r.select("cell_id", "drug_id", "dataset", "rank")


FOLD_PRED_SQL = f"""{PAIRS_SQL},
 gs AS (SELECT drug_id g, count(*) n, row_number() OVER (ORDER BY count(*) DESC, drug_id) i FROM pairs GROUP BY 1),
 st AS (SELECT 0::BIGINT i, NULL::BIGINT g, NULL::INTEGER f, [0, 0, 0, 0, 0]::BIGINT[] loads
        UNION ALL
        SELECT gs.i, gs.g, list_position(loads, list_min(loads)) - 1,
               list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN gs.n ELSE 0 END)
          FROM st JOIN gs ON gs.i = st.i + 1),
 fp AS (SELECT pairs.*, st.f fold FROM pairs JOIN st ON st.g = pairs.drug_id AND st.i > 0),
 pf AS (SELECT fold, smiles, tissue, sum(ln_ic50) fs, count(*) fn FROM fp GROUP BY ALL),
 pk AS (SELECT smiles, tissue, sum(fs) ts, sum(fn) tn FROM pf GROUP BY ALL),
 ft AS (SELECT fold, sum(fs) gfs, sum(fn) gfn FROM pf GROUP BY fold),
 gt AS (SELECT sum(gfs) gs, sum(gfn) gn FROM ft),
 oof AS (SELECT pf.fold, pf.smiles, pf.tissue,
                CASE WHEN tn - fn > 0 THEN (ts - fs) / (tn - fn) ELSE (gs - gfs) / (gn - gfn) END m
           FROM pf JOIN pk USING (smiles, tissue) JOIN ft USING (fold) CROSS JOIN gt),
 pred AS (SELECT fp.*, oof.m pred FROM fp JOIN oof USING (fold, smiles, tissue)),
 fm AS (SELECT fold, sqrt(avg(power(ln_ic50 - pred, 2))) rmse, avg(abs(ln_ic50 - pred)) mae, corr(ry, rp) spearman
          FROM ({rank_select('pred', 'fold')}) GROUP BY fold)"""


def fold_metrics_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyad.operators.baseline import out_of_fold_group_mean
    from dyad.operators.evaluate import evaluate
    from dyad.operators.splits import balanced_group_kfold

    folds = cut_lineage(balanced_group_kfold(pairs_df(spark, sf_dir, materialize=True), "drug_id", 5))
    pred = out_of_fold_group_mean(folds, ["smiles", "tissue"])
    return evaluate(pred, by="fold", metrics=("rmse", "mae", "spearman"))


@register("eval_by_fold", f"""WITH RECURSIVE {FOLD_PRED_SQL}
SELECT fold, round(rmse, 6) rmse, round(mae, 6) mae, round(spearman, 6) spearman FROM fm""")
def q_eval_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2/U3 stand-in: group 5-fold CV of the baseline, per-fold metrics (each
    row predicted once, from the other folds)."""
    m = fold_metrics_df(spark, sf_dir)
    return m.select("fold", *[r6(c).alias(c) for c in ["rmse", "mae", "spearman"]])


@register("fold_summary", f"""WITH RECURSIVE {FOLD_PRED_SQL}
SELECT round(avg(rmse), 6) rmse_mean, round(stddev_pop(rmse), 6) rmse_sd, round(avg(mae), 6) mae_mean,
       round(stddev_pop(mae), 6) mae_sd, round(avg(spearman), 6) spearman_mean, round(stddev_pop(spearman), 6) spearman_sd
  FROM fm""")
def q_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean +- population sd of the per-fold metrics."""
    from dyad.operators.evaluate import fold_summary

    s = fold_summary(fold_metrics_df(spark, sf_dir))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@register("batch_loss", f"""WITH {PRED_SQL},
 b AS (SELECT split, drug_id % 16 batch, avg(power(ln_ic50 - pred, 2)) mse FROM pred GROUP BY 1, 2)
SELECT split, round(avg(mse), 6) loss FROM b GROUP BY split""")
def q_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted mean of per-batch MSE (batch = drug_id mod 16)."""
    from dyad.operators.evaluate import batch_loss

    p = predictions_df(spark, sf_dir).withColumn("batch", F.pmod("drug_id", F.lit(16)))
    return batch_loss(p, "ln_ic50", "pred", "batch", by="split").withColumn("loss", r6("loss"))


@register("weighted_loss", f"""WITH {PRED_SQL},
 b AS (SELECT split, drug_id % 16 batch, avg(power(ln_ic50 - pred, 2)) mse, count(*) n FROM pred GROUP BY 1, 2)
SELECT split, round(sum(mse * n) / sum(n), 6) loss FROM b GROUP BY split""")
def q_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-weighted running loss over batches."""
    from dyad.operators.evaluate import weighted_loss

    p = predictions_df(spark, sf_dir).withColumn("batch", F.pmod("drug_id", F.lit(16)))
    b = p.groupBy("split", "batch").agg(F.avg(F.pow(F.col("ln_ic50") - F.col("pred"), 2)).alias("mse"),
                                        F.count(F.lit(1)).alias("n"))
    return weighted_loss(b, "mse", "n", by="split").withColumn("loss", r6("loss"))


@register("split_subset", f"""WITH {PAIRS_SQL}, {SPLIT_SQL}
SELECT cell_id, drug_id, dataset, round(ln_ic50, 6) ln_ic50 FROM pairs WHERE drug_id IN (SELECT drug_id FROM split WHERE split = 'val')""")
def q_split_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one split selected through the assignment table."""
    from dyad.operators.resolve import subset

    pairs = pairs_df(spark, sf_dir, materialize=True)
    assign = split_df(spark, sf_dir).select("drug_id", "split").distinct()
    return subset(pairs, assign, ["drug_id"], "val").select("cell_id", "drug_id", "dataset", r6("ln_ic50").alias("ln_ic50"))


@register("train_val_union", f"""WITH {PRED_SQL}
SELECT split, count(*) n, round(avg(ln_ic50), 6) mean_y FROM pred WHERE split IN ('train', 'val') GROUP BY split
UNION ALL SELECT 'train+val', count(*), round(avg(ln_ic50), 6) FROM pred WHERE split IN ('train', 'val')""")
def q_train_val_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and val recombined for the final refit (with per-part counts)."""
    sp = split_df(spark, sf_dir)
    parts = sp.filter(F.col("split").isin("train", "val"))
    per = parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ln_ic50")).alias("mean_y"))
    both = parts.agg(F.lit("train+val").alias("split"), F.count(F.lit(1)).alias("n"), r6(F.avg("ln_ic50")).alias("mean_y"))
    return per.unionByName(both)
