"""Writers (S11-S17).  Row-level tables are written partitioned as they are;
only small report tables (metrics, params) are coalesced to one file."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.sources.readers import FEATURE_STORE_SCHEMA

REPORT_FORMATS = ("json", "csv", "parquet")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Pairs, scores, merged tables, predictions."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Small report tables (metrics, splits summary, trials) as one
    file; unknown formats are rejected."""
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.coalesce(1).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S12 for row-level tables (OOF predictions, assignments): one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def params_frame(spark: SparkSession, params: Mapping[str, object]) -> DataFrame:
    """A params/metrics dict as a one-row ``map<string,string>`` table."""
    return spark.createDataFrame([({k: json.dumps(v) for k, v in params.items()},)], "params map<string,string>")


def write_feature_store(df: DataFrame, path: str, model_name: str, mode: str = "overwrite") -> None:
    """``(drug_id, smiles, embedding array<float>, model_name)``."""
    out = df.select(
        F.col("drug_id").cast("long"), F.col("smiles").cast("string"),
        F.col("embedding").cast("array<float>"), F.lit(model_name).alias("model_name"),
    )
    assert [f.name for f in out.schema] == [f.name for f in FEATURE_STORE_SCHEMA]
    out.write.mode(mode).parquet(path)


def write_graph_store(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Graph store as two tables."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def save_model(model, path: str, meta: Mapping[str, object], spark: SparkSession) -> None:  # noqa: ANN001
    """Fitted MLlib model plus params and input width as metadata JSON."""
    model.write().overwrite().save(f"{path}/model")
    write_report(params_frame(spark, meta), f"{path}/meta", fmt="json")
