"""Query registry and the SQL fragments the oracle queries share.

Floats are rounded to 6 places in both engines (sums of large numbers to 4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.plans import fixtures as fx
from dyad.plans.dataset import clean_pairs
from dyad.session import cut_lineage

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# ---------------------------------------------------------------- shared SQL
RAW_SQL = """raw AS (SELECT l_suppkey cell_id, l_partkey drug_id,
       CASE WHEN l_linestatus='F' THEN 'GDSC1' ELSE 'GDSC2' END AS dataset, ln(l_extendedprice) y
  FROM lineitem WHERE l_extendedprice IS NOT NULL)"""
CELLS_SQL = """cells AS (SELECT s_suppkey cell_id,
       CASE WHEN n_name IS NOT NULL AND trim(n_name) <> '' AND lower(trim(n_name))<>lower(trim(r_name))
            THEN concat(trim(r_name),' / ',trim(n_name)) ELSE trim(r_name) END AS tissue
  FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"""
REP_SQL = """rep AS (SELECT raw.cell_id, raw.drug_id, p_name drug_name, coalesce(p_type,'') smiles, tissue, dataset,
       median(y) y, count(*) n
  FROM raw LEFT JOIN part ON raw.drug_id=p_partkey LEFT JOIN cells ON raw.cell_id=cells.cell_id
  WHERE tissue IS NOT NULL GROUP BY 1,2,3,4,5,6)"""
PAIRS_SQL = f"""{RAW_SQL},
 {CELLS_SQL},
 {REP_SQL},
 q AS (SELECT quantile_cont(y, 0.005) lo, quantile_cont(y, 0.995) hi FROM rep),
 pairs AS (SELECT cell_id, drug_id, drug_name, smiles, tissue, dataset, n, least(greatest(y, lo), hi) ln_ic50
  FROM rep CROSS JOIN q)"""


def pairs_df(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Clean pairs; ``materialize`` writes them once to the checkpoint directory
    when several jobs of one query reuse them."""
    pairs = clean_pairs(fx.responses(spark, sf_dir), fx.compounds(spark, sf_dir), fx.cells(spark, sf_dir))
    return cut_lineage(pairs) if materialize else pairs
