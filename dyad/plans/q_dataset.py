"""Dataset-build queries: the flagship and the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.plans import fixtures as fx
from dyad.plans.registry import CELLS_SQL, PAIRS_SQL, pairs_df, r6, register


# ------------------------------------------------------------ 7.2 flagship
@register(
    "clean_pairs",
    f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, drug_name, smiles, tissue, dataset, n, round(ln_ic50, 6) ln_ic50 FROM pairs""",
)
def q_clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_df(spark, sf_dir).withColumn("ln_ic50", r6("ln_ic50"))


# ------------------------------------------------------------ sources, projections, cleaning
@register(
    "load_union_tag",
    """SELECT l_suppkey COSMIC_ID, l_partkey DRUG_ID, round(ln(l_extendedprice), 6) LN_IC50, 'GDSC1' dataset
  FROM lineitem WHERE l_linestatus = 'F'
UNION ALL
SELECT l_suppkey, l_partkey, round(ln(l_extendedprice), 6), 'GDSC2' FROM lineitem WHERE l_linestatus <> 'F'""",
)
def q_load_union_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P4 + U1: two response sources read separately, tagged, unioned by name."""
    from dyad.sources.readers import union_tagged

    li = fx.table(spark, sf_dir, "lineitem")

    def source(cond, tag):
        return li.filter(cond).select(
            F.col("l_suppkey").alias("COSMIC_ID"), F.col("l_partkey").alias("DRUG_ID"),
            r6(F.ln("l_extendedprice")).alias("LN_IC50"), F.lit(tag).alias("dataset"),
        )

    return union_tagged([source(F.col("l_linestatus") == "F", "GDSC1"), source(F.col("l_linestatus") != "F", "GDSC2")])


@register(
    "ci_columns",
    """SELECT l_suppkey COSMIC_ID, l_partkey DRUG_ID, l_extendedprice LN_IC50 FROM lineitem""",
)
def q_ci_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P3: headers in another case resolved case-insensitively, renamed positionally."""
    from dyad.functions.columns import ci_select

    li = fx.table(spark, sf_dir, "lineitem")
    shouted = li.toDF(*[c.upper() for c in li.columns])
    return ci_select(shouted, ["l_suppkey", "l_partkey", "l_extendedprice"], ["COSMIC_ID", "DRUG_ID", "LN_IC50"])


@register(
    "tissue_combine",
    "WITH " + CELLS_SQL + """
SELECT cell_id, tissue FROM cells""",
)
def q_tissue_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 + P12: two descriptors -> ``t1 / t2`` when t2 adds information."""
    return fx.cells(spark, sf_dir)


@register(
    "numeric_coerce",
    """SELECT p_partkey, TRY_CAST(trim(substr(p_brand, 7)) AS DOUBLE) brand_no, TRY_CAST(trim(p_name) AS DOUBLE) name_no,
       TRY_CAST(trim(CAST(p_size AS VARCHAR)) AS DOUBLE) size_no FROM part""",
)
def q_numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are not numbers become NULL instead of failing the job."""
    from dyad.functions.strings import numeric

    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", numeric(F.substring("p_brand", 7, 100)).alias("brand_no"),
                    numeric("p_name").alias("name_no"), numeric("p_size").alias("size_no"))


@register(
    "sentinel_null",
    """SELECT p_partkey, coalesce(CASE WHEN p_type IN ('', 'nan', 'SMALL') THEN NULL ELSE p_type END, 'unknown') p_type
  FROM part""",
)
def q_sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + P9: sentinel strings to NULL, then a constant fill."""
    from dyad.functions.strings import null_if

    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.coalesce(null_if("p_type", ("", "nan", "SMALL")), F.lit("unknown")).alias("p_type"))


@register(
    "replicate_median",
    f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, drug_name, smiles, tissue, dataset, n, round(y, 6) ln_ic50 FROM rep""",
)
def q_replicate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: exact median per 6 keys, NULL keys dropped (Q1)."""
    from dyad.plans.dataset import replicate_medians

    rep = replicate_medians(fx.responses(spark, sf_dir), fx.compounds(spark, sf_dir), fx.cells(spark, sf_dir))
    return rep.withColumn("ln_ic50", r6("ln_ic50"))


@register(
    "replicate_median_hot",
    f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, drug_name, smiles, tissue, dataset, n, round(y, 6) ln_ic50 FROM rep""",
)
def q_replicate_median_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with every group above the hot threshold: the distributed path must
    give the same medians as the aggregate path."""
    from dyad.plans.dataset import replicate_medians

    rep = replicate_medians(fx.responses(spark, sf_dir), fx.compounds(spark, sf_dir), fx.cells(spark, sf_dir), hot_rows=1)
    return rep.withColumn("ln_ic50", r6("ln_ic50"))


@register(
    "strict_clean",
    """SELECT l_suppkey cell_id, l_partkey drug_id, p_type smiles,
       CASE WHEN l_linestatus='F' THEN 'GDSC1' ELSE 'GDSC2' END dataset, round(ln(l_extendedprice), 6) ln_ic50
  FROM lineitem LEFT JOIN (SELECT *, CASE WHEN p_size > 5 THEN p_partkey END p_key FROM part) p ON l_partkey = p_key
 WHERE p_type IS NOT NULL AND l_extendedprice IS NOT NULL""",
)
def q_strict_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: the strict cleaning mode (NULL structure dropped, no median, no winsorise)."""
    from dyad.operators.clean import strict_clean
    from dyad.operators.joins import join_small

    cmpd = fx.compounds_with_gaps(spark, sf_dir).select("drug_id", "smiles")
    resp = join_small(fx.responses(spark, sf_dir), cmpd, "drug_id", how="left")
    return strict_clean(resp).select("cell_id", "drug_id", "smiles", "dataset", r6("ln_ic50").alias("ln_ic50"))


@register(
    "winsorize",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, ln(l_extendedprice) y FROM lineitem),
 q AS (SELECT quantile_cont(y, 0.005) lo, quantile_cont(y, 0.995) hi FROM r)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(least(greatest(y, lo), hi), 6) y FROM r CROSS JOIN q""",
)
def q_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: clip to global exact 0.5% / 99.5% quantiles."""
    from dyad.operators.clean import winsorize

    li = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.ln("l_extendedprice").alias("y")
    )
    return winsorize(li, "y").withColumn("y", r6("y"))


@register(
    "left_join_dims",
    "WITH " + CELLS_SQL + """
SELECT CASE WHEN l_linestatus='F' THEN 'GDSC1' ELSE 'GDSC2' END dataset, coalesce(tissue, 'none') tissue,
       count(*) n, count(p.p_type) n_with_smiles
  FROM lineitem LEFT JOIN (SELECT *, CASE WHEN p_size > 5 THEN p_partkey END p_key FROM part) p ON l_partkey = p_key
  LEFT JOIN cells ON l_suppkey = cells.cell_id
 GROUP BY 1, 2""",
)
def q_left_join_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2: left joins to both dimensions (size-checked broadcast), rows kept when unmatched."""
    from dyad.plans.dataset import attach_dimensions

    joined = attach_dimensions(fx.responses(spark, sf_dir), fx.compounds_with_gaps(spark, sf_dir), fx.cells(spark, sf_dir))
    return joined.groupBy("dataset", F.coalesce("tissue", F.lit("none")).alias("tissue")).agg(
        F.count(F.lit(1)).alias("n"), F.count("smiles").alias("n_with_smiles")
    )


SCORES_SQL = """scores AS (SELECT vec_id cell_id, embedding::DOUBLE[] pcs FROM embeddings)"""


def scores_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("pcs"))


@register(
    "inner_join_scores",
    f"""WITH {PAIRS_SQL}, {SCORES_SQL},
 digest AS (SELECT cell_id, len(pcs) k, round(list_sum([abs(x) FOR x IN pcs]), 6) norm1,
                   round(list_sum(list_transform(pcs, lambda x, i: x * i)), 6) by_place FROM scores)
SELECT cell_id, drug_id, dataset, round(ln_ic50, 6) ln_ic50, k, norm1, by_place FROM pairs JOIN digest USING (cell_id)""",
)
def q_inner_join_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without a score row drop out; every component is joined (told by
    their count, the sum of their sizes and their sum weighted by place)."""
    from dyad.plans.dataset import merge_scores

    m = merge_scores(pairs_df(spark, sf_dir), scores_df(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return m.select("cell_id", "drug_id", "dataset", r6("ln_ic50").alias("ln_ic50"), F.size("pcs").cast("long").alias("k"),
                    r6(total(F.transform("pcs", F.abs))).alias("norm1"), r6(total(F.transform("pcs", lambda x, i: x * (i + 1)))).alias("by_place"))


@register(
    "map_distinct",
    """SELECT nullif(regexp_replace(trim(p_name), '\\s+', '', 'g'), '') canon, count(*) n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def q_map_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + P22: canonical form computed once per distinct string, joined back to every row."""
    from dyad.functions.strings import default_canonical
    from dyad.operators.clean import map_distinct

    li = fx.table(spark, sf_dir, "lineitem").select("l_partkey")
    rows = li.join(fx.table(spark, sf_dir, "part").select("p_partkey", "p_name"), li.l_partkey == F.col("p_partkey"))
    mapped = map_distinct(rows, "p_name", "canon", expr=default_canonical, fill=None)
    return mapped.groupBy("canon").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fanout_audit",
    """SELECT p_name, count(*) n FROM part GROUP BY p_name HAVING count(*) > 1""",
)
def q_fanout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a dimension that would fan out a join."""
    from dyad.operators.joins import duplicate_keys

    return duplicate_keys(fx.table(spark, sf_dir, "part"), "p_name")


@register(
    "distinct_keep_first",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) rn
  FROM lineitem) WHERE rn = 1""",
)
def q_distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: one row per key, first in a declared order (min_by, merged map-side)."""
    from dyad.operators.profile import first_by_key

    li = fx.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return first_by_key(li, "l_partkey", ["l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"])


@register(
    "entity_list",
    f"""WITH {PAIRS_SQL} SELECT DISTINCT drug_id, smiles FROM pairs""",
)
def q_entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2/A4: distinct entity list ``(drug_id, smiles)``."""
    from dyad.operators.profile import distinct_rows

    return distinct_rows(pairs_df(spark, sf_dir), ["drug_id", "smiles"])


@register("compound_table", """SELECT p_partkey DRUG_ID, p_type SMILES FROM part""")
def q_compound_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound table with the required-column check."""
    from dyad.sources.readers import compounds_from_frame

    p = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("DRUG_ID"), F.col("p_type").alias("SMILES"),
                                                F.col("p_name").alias("DRUG_NAME"))
    return compounds_from_frame(p)


@register("load_cells", """SELECT CAST(s_suppkey AS VARCHAR) COSMIC_ID,
       trim(coalesce(CASE WHEN trim(coalesce(n_name, '')) <> '' AND lower(trim(n_name)) <> lower(trim(coalesce(r_name, '')))
                          THEN concat(trim(coalesce(r_name, '')), ' / ', trim(n_name))
                          ELSE nullif(trim(coalesce(r_name, '')), '') END, 'unknown')) tissue
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 GROUP BY ALL""")
def q_load_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P2: cell metadata with header discovery over sheet-style headers."""
    from dyad.sources.readers import cells_from_frame

    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    n = fx.table(spark, sf_dir, "nation")
    r = fx.table(spark, sf_dir, "region")
    sheet = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    sheet = sheet.select(F.col("s_name").alias("Sample Name"), F.col("s_suppkey").cast("string").alias("COSMIC identifier"),
                         F.col("r_name").alias("GDSC\nTissue descriptor 1"), F.col("n_name").alias("GDSC\nTissue\ndescriptor 2"))
    return cells_from_frame(sheet)


@register("preview_head", f"""WITH {PAIRS_SQL}
SELECT cell_id, drug_id, dataset, tissue FROM pairs ORDER BY cell_id, drug_id, dataset LIMIT 5""")
def q_preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the first rows in key order (a preview: the limit is the operator)."""
    return pairs_df(spark, sf_dir).select("cell_id", "drug_id", "dataset", "tissue").orderBy(
        "cell_id", "drug_id", "dataset").limit(5)
