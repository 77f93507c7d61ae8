"""Linear-model queries from sufficient statistics.

Features of a pair: the cell's whole vector, the drug's two descriptors and the
tissue one-hot.  The oracle forms the same sums in SQL, solves the standardised
ridge system by Gauss-Jordan elimination in a recursive query, and predicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.operators import learn, regression
from dyad.operators.ledger import Trial, TrialLedger
from dyad.plans.q_eval import SPLIT_SQL, rank_select
from dyad.plans.q_learn import metrics_rows, training_frame
from dyad.plans.registry import PAIRS_SQL, r6, register
from dyad.session import cut_lineage, new_table_path

L2 = 0.01
N_TRIALS = 25
#: ridge penalties that the search draws from
SPACE = [learn.Param("l2", "logfloat", 1e-4, 10.0)]
METRICS = ("rmse", "mae", "spearman", "pearson")

# ``base(cell_id, drug_id, dataset, tissue, grp, y, d1, d2)`` and ``use_(m, grp, l2)``: model m
# is fitted on the rows of its groups
RIDGE_SQL = """lev AS (SELECT list(DISTINCT tissue ORDER BY tissue) l FROM base),
 cu AS (SELECT c.cell_id, list_concat([1.0::DOUBLE], embedding::DOUBLE[],
               list_transform(l, lambda t: CASE WHEN t = tissue THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) e
          FROM (SELECT DISTINCT cell_id, tissue FROM base) c JOIN embeddings ON vec_id = cell_id CROSS JOIN lev),
 pp AS (SELECT any_value(len(e)) p FROM cu),
 gc AS (SELECT grp, cell_id, count(*)::DOUBLE n, [sum(d1), sum(d2), sum(y)] s FROM base GROUP BY grp, cell_id),
 el AS (SELECT cell_id, unnest(range(len(e))) i, unnest(e) v FROM cu),
 ks AS (SELECT unnest([0, 1, 2]) k),
 edge AS (SELECT grp, i, p + k j, sum(v * s[k + 1]) s FROM gc JOIN el USING (cell_id) CROSS JOIN pp CROSS JOIN ks GROUP BY ALL),
 g AS (SELECT grp, a.i, b.i j, sum(n * a.v * b.v) s FROM gc JOIN el a USING (cell_id) JOIN el b USING (cell_id) GROUP BY ALL
       UNION ALL SELECT grp, i, j, s FROM edge UNION ALL SELECT grp, j, i, s FROM edge
       UNION ALL SELECT grp, p + a.k, p + b.k, sum([d1, d2, y][a.k + 1] * [d1, d2, y][b.k + 1])
                   FROM base CROSS JOIN pp CROSS JOIN ks a CROSS JOIN ks b GROUP BY ALL),
 tg AS (SELECT m, l2, i, j, sum(s) s FROM g JOIN use_ USING (grp) GROUP BY ALL),
 nn AS (SELECT m, s n FROM tg WHERE i = 0 AND j = 0),
 mu AS (SELECT m, j i, s / n mean FROM tg JOIN nn USING (m) WHERE i = 0),
 cov AS (SELECT tg.m, l2, tg.i, tg.j, s / n - a.mean * b.mean c
           FROM tg JOIN nn ON nn.m = tg.m JOIN mu a ON a.m = tg.m AND a.i = tg.i JOIN mu b ON b.m = tg.m AND b.i = tg.j
          WHERE tg.i > 0 AND tg.j > 0),
 sd AS (SELECT m, i, sqrt(greatest(c, 0)) sd FROM cov WHERE i = j),
 line AS (SELECT cov.m, cov.i, list(coalesce(c / nullif(a.sd * CASE WHEN j = p + 2 THEN 1 ELSE b.sd END, 0), CASE WHEN cov.i = j THEN 1 ELSE 0 END)
                                  + CASE WHEN cov.i = j THEN l2 ELSE 0 END ORDER BY j) r
            FROM cov JOIN sd a ON a.m = cov.m AND a.i = cov.i JOIN sd b ON b.m = cov.m AND b.i = cov.j CROSS JOIN pp
           WHERE cov.i < p + 2 GROUP BY cov.m, cov.i),
 gj AS (SELECT m, 1::BIGINT k, list(r ORDER BY i) mat FROM line GROUP BY m
        UNION ALL
        SELECT m, k + 1, list_transform(mat, lambda r, q: CASE WHEN q = k THEN prow ELSE list_transform(r, lambda x, c: x - r[k] * prow[c]) END)
          FROM (SELECT m, k, mat, list_transform(mat[k], lambda x: x / mat[k][k]) prow FROM gj WHERE k <= len(mat))),
 sol AS (SELECT m, list_transform(mat, lambda r: r[len(r)]) w FROM gj WHERE k = len(mat) + 1),
 beta AS (SELECT u.m, u.i, coalesce(u.w / nullif(sd, 0), 0) b, mean FROM (SELECT m, unnest(range(1, len(w) + 1)) i, unnest(w) w FROM sol) u
            JOIN sd ON sd.m = u.m AND sd.i = u.i JOIN mu ON mu.m = u.m AND mu.i = u.i),
 icept AS (SELECT m, any_value(y.mean) - sum(b * beta.mean) b0, max(CASE WHEN beta.i = p THEN b END) b1, max(CASE WHEN beta.i = p + 1 THEN b END) b2
             FROM beta JOIN pp ON true JOIN mu y USING (m) WHERE y.i = p + 2 GROUP BY m),
 part_c AS (SELECT m, cell_id, sum(b * v) bc FROM beta JOIN el USING (i) GROUP BY m, cell_id),
 model AS (SELECT m, cell_id, b0 + bc b0, b1, b2 FROM part_c JOIN icept USING (m))"""

BASE_SQL = """base AS (SELECT s.cell_id, s.drug_id, s.dataset, s.tissue, s.grp, s.ln_ic50 y, p_size::DOUBLE d1, p_retailprice::DOUBLE d2
            FROM src s JOIN part ON p_partkey = s.drug_id JOIN embeddings ON vec_id = s.cell_id)"""


def fold_sql(group: str) -> str:
    """``src``: the pairs with ``grp``, their balanced group fold of five."""
    return f"""gs AS (SELECT {group} g, count(*) n, row_number() OVER (ORDER BY count(*) DESC, {group}) i FROM pairs GROUP BY 1),
 st AS (SELECT 0::BIGINT i, NULL::BIGINT g, NULL::INTEGER f, [0, 0, 0, 0, 0]::BIGINT[] loads
        UNION ALL
        SELECT gs.i, gs.g, list_position(loads, list_min(loads)) - 1,
               list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN gs.n ELSE 0 END)
          FROM st JOIN gs ON gs.i = st.i + 1),
 src AS (SELECT pairs.*, st.f grp FROM pairs JOIN st ON st.g = pairs.{group} AND st.i > 0)"""


SPLIT_SRC_SQL = f"{SPLIT_SQL},\n src AS (SELECT pairs.*, split grp FROM pairs JOIN split USING (drug_id))"
METRIC_SQL = """round(sqrt(avg(power(y - pred, 2))), 6) rmse, round(avg(abs(y - pred)), 6) mae,
       round(corr(ry, rp), 6) spearman, round(corr(y, pred), 6) pearson, count(*) n"""


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("split", *[r6(c).alias(c) for c in METRICS], "n")


@register("fit_eval_split", f"""WITH RECURSIVE {PAIRS_SQL}, {SPLIT_SRC_SQL}, {BASE_SQL},
 use_ AS (SELECT 'fit' m, 'train' grp, {L2}::DOUBLE l2), {RIDGE_SQL},
 pred AS (SELECT grp split, y, b0 + b1 * d1 + b2 * d2 pred FROM base JOIN model USING (cell_id) WHERE grp IN ('val', 'test'))
SELECT split, {METRIC_SQL} FROM ({rank_select('pred', 'split', 'y', 'pred')}) GROUP BY split""")
def q_fit_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on train, report val + test."""
    tf = training_frame(spark, sf_dir)
    model = regression.fit_groups(regression.moments(tf, by="split"), ["train"], L2)
    return _rounded(metrics_rows(regression.predict(tf.filter(F.col("split").isin("val", "test")), model), "split"))


@register("oof_predictions", f"""WITH RECURSIVE {PAIRS_SQL}, {fold_sql('drug_id')}, {BASE_SQL},
 use_ AS (SELECT m, grp, {L2}::DOUBLE l2 FROM (SELECT unnest(range(5)) m) CROSS JOIN (SELECT unnest(range(5)) grp) WHERE m <> grp), {RIDGE_SQL}
SELECT base.cell_id, drug_id, dataset, grp fold, round(y, 6) AS label, round(b0 + b1 * d1 + b2 * d2, 4) prediction
  FROM base JOIN model ON model.cell_id = base.cell_id AND m = grp""")
def q_oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair predicted once, by the model of the other drug folds."""
    tf = training_frame(spark, sf_dir, with_folds=True)
    models = regression.fit_without_each(regression.moments(tf, by="fold"), L2)
    out = regression.predict(tf, models, "fold")
    return out.select("cell_id", "drug_id", "dataset", "fold", r6("label").alias("label"), r6("prediction", 4).alias("prediction"))


def _trial_sql(n: int) -> str:
    u = f"(('0x' || substr(md5('42:' || CAST(number AS VARCHAR) || ':l2'), 1, 13))::BIGINT / {float(16 ** 13)})"
    return f"trial AS (SELECT number, exp(ln(1e-4) + {u} * (ln(10.0) - ln(1e-4))) l2 FROM (SELECT unnest(range({n})) number))"


CV_SQL = f"""{fold_sql('cell_id')}, {BASE_SQL}, {_trial_sql(N_TRIALS)},
 use_ AS (SELECT number * 5 + fold m, grp, l2 FROM trial CROSS JOIN (SELECT unnest(range(5)) fold) CROSS JOIN (SELECT unnest(range(5)) grp)
           WHERE fold <> grp), {RIDGE_SQL},
 cv AS (SELECT m // 5 number, grp fold, sqrt(avg(power(y - (b0 + b1 * d1 + b2 * d2), 2))) rmse
          FROM base JOIN model ON model.cell_id = base.cell_id AND m % 5 = grp GROUP BY m, grp)"""


@register("ridge_cv", f"""WITH RECURSIVE {PAIRS_SQL}, {CV_SQL}
SELECT number, round(l2, 9) l2, fold, round(rmse, 6) rmse FROM cv JOIN trial USING (number)""")
def q_ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + T4 + T5 + K5: leave-cell-out group 5-fold CV of every trial, from one pass over the pairs."""
    tf = training_frame(spark, sf_dir, with_folds=True, group="cell_id")
    stats = regression.moments(tf, by="fold")
    trials = [(r.number, r.l2) for r in learn.sample_space(spark, N_TRIALS, SPACE).orderBy("number").collect()]
    rows = spark.createDataFrame(regression.search(stats, trials), "number long, l2 double, fold int, rmse double")
    return rows.select("number", F.round("l2", 9).alias("l2"), "fold", r6("rmse").alias("rmse"))


@register("trial_ledger", f"""WITH RECURSIVE {PAIRS_SQL}, {CV_SQL}
SELECT number, 'COMPLETE' state, round(any_value(l2), 9) l2, round(avg(rmse), 6) AS value FROM cv JOIN trial USING (number) GROUP BY number""")
def q_trial_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 + T6: the search as a ledger of trials, stopped half way and resumed by a second ledger on the same table."""
    stats = regression.moments(training_frame(spark, sf_dir, with_folds=True, group="cell_id"), by="fold")

    def mean_fold_rmse(params: dict[str, str]) -> float:
        scores = regression.cross_validated_rmse(stats, float(params["l2"])).values()
        return sum(scores) / len(scores)

    path = new_table_path(spark)
    trials = [Trial(r.number, {"l2": repr(r.l2)}) for r in learn.sample_space(spark, N_TRIALS, SPACE).orderBy("number").collect()]
    TrialLedger(spark, path).run(trials, mean_fold_rmse, max_new=N_TRIALS // 2)
    table = TrialLedger(spark, path).run(trials, mean_fold_rmse)
    return table.select("number", "state", F.round(F.col("params")["l2"].cast("double"), 9).alias("l2"), r6("value").alias("value"))


@register("ridge_refit", f"""WITH RECURSIVE {PAIRS_SQL}, {SPLIT_SRC_SQL}, {BASE_SQL}, {_trial_sql(N_TRIALS)},
 use_ AS (SELECT number m, 'train' grp, l2 FROM trial UNION ALL SELECT number + {N_TRIALS}, unnest(['train', 'val']), l2 FROM trial), {RIDGE_SQL},
 tuned AS (SELECT m, sqrt(avg(power(y - (b0 + b1 * d1 + b2 * d2), 2))) v FROM base JOIN model USING (cell_id)
            WHERE grp = 'val' AND m < {N_TRIALS} GROUP BY m ORDER BY v, m LIMIT 1),
 pred AS (SELECT grp split, y, b0 + b1 * d1 + b2 * d2 pred FROM base JOIN model USING (cell_id)
           WHERE grp = 'test' AND model.m = (SELECT m + {N_TRIALS} FROM tuned))
SELECT split, {METRIC_SQL} FROM ({rank_select('pred', 'split', 'y', 'pred')}) GROUP BY split""")
def q_ridge_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trial on val is refitted on train + val and scored once on test."""
    tf = training_frame(spark, sf_dir)
    stats = regression.moments(tf, by="split")
    trials = [(r.number, r.l2) for r in learn.sample_space(spark, N_TRIALS, SPACE).orderBy("number").collect()]
    held = stats["val"]
    _, _, l2 = min((held.squared_error(regression.fit_groups(stats, ["train"], l2)), number, l2) for number, l2 in trials)
    model = regression.fit_groups(stats, ["train", "val"], l2)
    return _rounded(metrics_rows(regression.predict(tf.filter("split = 'test'"), model), "split"))


CLIP = (0.01, 0.99)


@register("saved_scores", f"""WITH RECURSIVE {PAIRS_SQL}, {SPLIT_SRC_SQL},
 raw_base AS (SELECT s.cell_id, s.drug_id, s.dataset, s.tissue, s.grp, s.ln_ic50 y0, p_size::DOUBLE d1, p_retailprice::DOUBLE d2
                FROM src s JOIN part ON p_partkey = s.drug_id JOIN embeddings ON vec_id = s.cell_id),
 lim AS (SELECT quantile_cont(y0, {CLIP[0]}) lo, quantile_cont(y0, {CLIP[1]}) hi FROM raw_base WHERE grp = 'train'),
 base AS (SELECT raw_base.*, least(greatest(y0, lo), hi) y FROM raw_base CROSS JOIN lim),
 use_ AS (SELECT 'fit' m, 'train' grp, {L2}::DOUBLE l2), {RIDGE_SQL},
 pred AS (SELECT grp split, y0 y, least(greatest(b0 + b1 * d1 + b2 * d2, lo), hi) pred
            FROM base JOIN model USING (cell_id) CROSS JOIN lim WHERE grp <> 'train')
SELECT split, {METRIC_SQL} FROM ({rank_select('pred', 'split', 'y', 'pred')}) GROUP BY split""")
def q_saved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16 + T9: a pipeline fitted on train is saved, loaded and scores val and test."""
    from dyad.operators.joins import broadcastable, join_small
    from dyad.operators.scoring import ScoringPipeline, fit_pipeline
    from dyad.plans import fixtures as fx
    from dyad.plans.q_eval import split_df

    cells = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding")
    drugs = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), "p_size", "p_retailprice")
    # written narrow; the vectors are joined to it in every pass if they can be broadcast
    small = broadcastable(cells)
    known = join_small(split_df(spark, sf_dir), cells.select("cell_id"), "cell_id", how="left_semi").join(drugs, "drug_id")
    pairs = cut_lineage(known.select("cell_id", "split", "tissue", "ln_ic50", "p_size", "p_retailprice"))
    rows = pairs.join(F.broadcast(cells), "cell_id") if small else cut_lineage(pairs.join(cells, "cell_id"))
    path = new_table_path(spark)
    train = rows.filter("split = 'train'")
    fit_pipeline(train, "embedding", "ln_ic50", ["p_size", "p_retailprice"], "tissue", L2, *CLIP, stored=True).save(spark, path)
    scored = ScoringPipeline.load(spark, path).score(rows.filter("split <> 'train'"), keep=["split", "ln_ic50"])
    return _rounded(metrics_rows(scored.withColumnRenamed("ln_ic50", "label"), "split"))
