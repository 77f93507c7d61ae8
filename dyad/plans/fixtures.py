"""How the shared test tables stand in for the reference's inputs.

Every query reads the given parquet tables (or data Spark derives from them),
so its work grows with the scale factor.  The mapping:

* response row: ``lineitem`` -- cell = l_suppkey, drug = l_partkey,
  response = ln(l_extendedprice), dataset GDSC1 when l_linestatus = 'F'
* drug dimension: ``part`` -- name = p_name, structure string = p_type,
  synonyms = ``p_brand;p_type,p_name``
* cell dimension: ``supplier -> nation -> region`` -- descriptor 1 = r_name,
  descriptor 2 = n_name
* expression matrix: ``embeddings`` (vec_id = cell, 64 features)
* graphs: ``lineitem`` positions per order; token graphs from ``documents``
* metric histories and trials: ``events``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.functions.strings import combine_descriptors

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


#: below this (compressed) size a table is a dimension: one split is fine
SPREAD_MIN_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Fan a large scan out to the cluster's parallelism when its files give
    fewer splits (one big unsplittable file or row group).  A no-op for small
    dimension tables and for a normal multi-file table, whose scan already has
    enough splits."""
    from dyad.operators.joins import estimated_bytes

    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target and estimated_bytes(df) >= SPREAD_MIN_BYTES:
        return df.repartition(target)
    return df


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dose-response rows: ``cell_id, drug_id, dataset, ln_ic50``."""
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_extendedprice").isNotNull()).select(
        F.col("l_suppkey").alias("cell_id"),
        F.col("l_partkey").alias("drug_id"),
        F.when(F.col("l_linestatus") == "F", F.lit("GDSC1")).otherwise(F.lit("GDSC2")).alias("dataset"),
        F.ln("l_extendedprice").alias("ln_ic50"),
    )


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound dictionary: ``drug_id, drug_name, smiles``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("drug_name"), F.col("p_type").alias("smiles")
    )


def compounds_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All compounds; small parts (p_size up to 5) have no usable key: nothing joins to them."""
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") > 5, F.col("p_partkey"))
    return p.select(key.alias("drug_id"), F.col("p_name").alias("drug_name"), F.col("p_type").alias("smiles"))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened-compound list with synonyms: ``drug_id, drug_name, synonyms``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug_id"),
        F.col("p_name").alias("drug_name"),
        F.concat_ws(";", "p_brand", F.concat_ws(",", "p_type", "p_name")).alias("synonyms"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell metadata: ``cell_id, tissue`` from supplier -> nation -> region."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation/region are fixed 25/5-row dimensions.
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("cell_id"), combine_descriptors("r_name", "n_name").alias("tissue"))
