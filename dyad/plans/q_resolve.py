"""Resolution and lookup queries.

The dictionary stands in for the name services' answers: one entry per
``(name_key, source)`` from ``part`` names (ChEMBL when ``p_size`` is even,
else PubChem; negative when any size is a multiple of 5 or at most 5)
and one PubChem entry per brand (negative for brand numbers up to 12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.functions.strings import cache_key
from dyad.plans import fixtures as fx
from dyad.plans.registry import PAIRS_SQL, pairs_df, r6, register

DICT_SQL = """dict AS (
  SELECT 'name::' || lower(p_name) name_key, CASE WHEN p_size % 2 = 0 THEN 'ChEMBL' ELSE 'PubChem' END source,
         min('CHEMBL' || CAST(p_partkey AS VARCHAR)) chembl_id, min(p_type || ':' || CAST(p_partkey AS VARCHAR)) smiles,
         bool_or(p_size % 5 = 0 OR p_size <= 5) is_negative
    FROM part GROUP BY 1, 2
  UNION ALL
  SELECT 'name::' || lower(p_brand), 'PubChem', NULL, min('BRAND:' || p_brand),
         bool_or(TRY_CAST(substr(p_brand, 7) AS INTEGER) <= 12)
    FROM part GROUP BY 1)"""
CAND_SQL = r"""cand AS (
  SELECT drug_id, unnest(range(len(arr))) pos, unnest(arr) name FROM (
    SELECT p_partkey drug_id,
           list_filter(list_concat([trim(regexp_replace(coalesce(p_name, ''), '\s+', ' ', 'g'))],
             list_transform(string_split_regex(p_brand || ';' || p_type || ',' || p_name, '[;,]'),
                            lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> '') arr
      FROM part))"""


def dictionary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    names = p.groupBy(
        cache_key("p_name").alias("name_key"),
        F.when(F.col("p_size") % 2 == 0, F.lit("ChEMBL")).otherwise(F.lit("PubChem")).alias("source"),
    ).agg(
        F.min(F.concat(F.lit("CHEMBL"), F.col("p_partkey").cast("string"))).alias("chembl_id"),
        F.min(F.concat("p_type", F.lit(":"), F.col("p_partkey").cast("string"))).alias("smiles"),
        F.bool_or((F.col("p_size") % 5 == 0) | (F.col("p_size") <= 5)).alias("is_negative"),
    )
    brands = p.groupBy(cache_key("p_brand").alias("name_key")).agg(
        F.min(F.concat(F.lit("BRAND:"), "p_brand")).alias("smiles"),
        F.bool_or(F.substring("p_brand", 7, 100).try_cast("int") <= 12).alias("is_negative"),
    ).select("name_key", F.lit("PubChem").alias("source"), F.lit(None).cast("string").alias("chembl_id"),
             "smiles", "is_negative")
    return names.unionByName(brands)


@register(
    "synonym_candidates",
    f"""WITH {CAND_SQL} SELECT drug_id, pos, name FROM cand""",
)
def q_synonym_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name first, then synonyms split on ``;``/``,``, normalised, empties dropped."""
    from dyad.operators.resolve import name_candidates

    return name_candidates(fx.screened(spark, sf_dir)).select("drug_id", F.col("pos").cast("bigint"), "name")


@register(
    "resolve_priority",
    f"""WITH {DICT_SQL}, {CAND_SQL},
 hits AS (SELECT cand.*, dict.source, dict.chembl_id, dict.smiles,
                 row_number() OVER (PARTITION BY drug_id ORDER BY pos, CASE dict.source WHEN 'ChEMBL' THEN 0 ELSE 1 END) rn
            FROM cand JOIN dict ON dict.name_key = 'name::' || lower(cand.name) WHERE NOT dict.is_negative)
SELECT drug_id, pos, name, source, chembl_id, smiles FROM hits WHERE rn = 1""",
)
def q_resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + P19: names in order, per name ChEMBL then PubChem, negatives skipped, first hit wins."""
    from dyad.operators.resolve import name_candidates, resolve_names

    cand = name_candidates(fx.screened(spark, sf_dir))
    out = resolve_names(cand, dictionary_df(spark, sf_dir))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@register(
    "unmatched_report",
    f"""WITH {DICT_SQL}, {CAND_SQL},
 ok AS (SELECT DISTINCT drug_id FROM cand JOIN dict ON dict.name_key = 'name::' || lower(cand.name) WHERE NOT is_negative)
SELECT DISTINCT p_partkey drug_id, p_name drug_name FROM part WHERE p_partkey NOT IN (SELECT drug_id FROM ok)""",
)
def q_unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened compounds no dictionary entry resolves."""
    from dyad.operators.resolve import name_candidates, resolve_names, unmatched

    screened = fx.screened(spark, sf_dir)
    resolved = resolve_names(name_candidates(screened), dictionary_df(spark, sf_dir))
    return unmatched(screened, resolved, "drug_id", ["drug_id", "drug_name"])


@register(
    "best_match",
    """WITH q AS (SELECT DISTINCT CASE WHEN p_size > 5 THEN p_name || ' salt' ELSE p_name END query FROM part),
 hits AS (SELECT q.query, p.p_partkey molecule_id, p.p_name pref_name, p.p_partkey rank
            FROM q JOIN part p ON split_part(p.p_name, ' ', 2) = split_part(q.query, ' ', 2)),
 o AS (SELECT *, CAST(lower(pref_name) = lower(query) AS INTEGER) is_exact,
              row_number() OVER (PARTITION BY query ORDER BY CAST(lower(pref_name) = lower(query) AS INTEGER) DESC, rank) rn
         FROM hits)
SELECT query, molecule_id, pref_name, rank, is_exact FROM o WHERE rn = 1""",
)
def q_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name is searched among all parts that share its second
    word: exact preferred name first, else the best search rank."""
    from dyad.operators.resolve import search_best

    p = fx.table(spark, sf_dir, "part")
    queries = p.select(F.when(F.col("p_size") > 5, F.concat("p_name", F.lit(" salt"))).otherwise(F.col("p_name")).alias("query"))
    molecules = p.select(F.col("p_partkey").alias("molecule_id"), F.col("p_name").alias("pref_name"), F.col("p_partkey").alias("rank"))
    return search_best(queries, molecules, lambda name: F.slice(F.split(name, " "), 2, 1))


@register(
    "structure_fallback",
    """SELECT p_partkey drug_id, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END, 'IK-' || p_brand) smiles,
       CASE WHEN p_size % 3 <> 0 THEN 'smiles' ELSE 'inchi_key' END smiles_kind FROM part""",
)
def q_structure_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical structure, else the alternate identifier, labelled (Q22)."""
    from dyad.operators.resolve import structure_of

    p = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug_id"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("canonical_smiles"),
        F.concat(F.lit("IK-"), "p_brand").alias("standard_inchi_key"),
    )
    return structure_of(p).select("drug_id", "smiles", "smiles_kind")


@register(
    "overrides",
    """SELECT p_partkey drug_id, CASE WHEN p_size = 1 THEN 'OVR-' || p_type ELSE p_type END smiles,
       CAST(p_size = 1 AS INTEGER) override_used FROM part""",
)
def q_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual overrides take precedence over resolved structures."""
    from dyad.operators.resolve import apply_overrides

    p = fx.table(spark, sf_dir, "part")
    resolved = fx.compounds(spark, sf_dir).select("drug_id", "smiles")
    ov = p.filter(F.col("p_size") == 1).select(F.col("p_partkey").alias("drug_id"),
                                                F.concat(F.lit("OVR-"), "p_type").alias("smiles"))
    out = apply_overrides(resolved, ov)
    return out.withColumn("override_used", F.col("override_used").cast("int"))


@register(
    "cache_upsert",
    f"""WITH {DICT_SQL},
 new AS (SELECT 'name::' || lower(CASE WHEN p_size > 45 THEN p_name ELSE 'alt ' || p_name END) name_key, 'PubChem' source, NULL chembl_id,
                min('NEW:' || p_type) smiles, false is_negative FROM part GROUP BY 1)
SELECT name_key, source, chembl_id, smiles, CAST(is_negative AS INTEGER) is_negative
  FROM dict WHERE name_key NOT IN (SELECT name_key FROM new)
UNION ALL SELECT name_key, source, chembl_id, smiles, CAST(is_negative AS INTEGER) FROM new""",
)
def q_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-cache upsert (new entries replace old ones by key)."""
    from dyad.operators.resolve import upsert_cache

    p = fx.table(spark, sf_dir, "part")
    named = p.withColumn("name", F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(F.concat(F.lit("alt "), "p_name")))
    new = named.groupBy(cache_key("name").alias("name_key")).agg(
        F.min(F.concat(F.lit("NEW:"), "p_type")).alias("smiles")
    ).select("name_key", F.lit("PubChem").alias("source"), F.lit(None).cast("string").alias("chembl_id"), "smiles",
             F.lit(False).alias("is_negative"))
    out = upsert_cache(dictionary_df(spark, sf_dir), new)
    return out.withColumn("is_negative", F.col("is_negative").cast("int"))


STORE_SQL = """store AS (SELECT p_partkey drug_id, p_type smiles, embedding FROM part
  JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""


def store_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug feature store: each drug's vector is embeddings[drug_id mod n_embeddings]."""
    emb = fx.table(spark, sf_dir, "embeddings")
    n = emb.count()
    p = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_type").alias("smiles"))
    return p.withColumn("vec_id", F.pmod("drug_id", F.lit(n))).join(emb.select("vec_id", "embedding"), "vec_id").drop("vec_id")


@register(
    "lookup_guard",
    f"""WITH {PAIRS_SQL}, {STORE_SQL}
SELECT DISTINCT pairs.drug_id, round(list_sum([abs(x::DOUBLE) FOR x IN embedding]), 6) norm1, len(embedding) dim
  FROM pairs JOIN store USING (drug_id)""",
)
def q_lookup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id -> vector lookup that fails when an id has no vector."""
    from dyad.operators.resolve import lookup_strict

    drugs = pairs_df(spark, sf_dir).select("drug_id").distinct()
    out = lookup_strict(drugs, store_df(spark, sf_dir), "drug_id", what="drug id")
    norm1 = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.abs(x.cast("double")))
    return out.select("drug_id", r6(norm1).alias("norm1"), F.size("embedding").cast("bigint").alias("dim"))
