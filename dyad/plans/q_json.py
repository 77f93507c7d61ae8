"""JSON queries (S8, J9, J10): documents are made from ``part`` and ``events`` as
the services and the cache file would hold them, some of them broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.plans import fixtures as fx
from dyad.plans.q_resolve import DICT_SQL, dictionary_df
from dyad.plans.registry import register
from dyad.sources import json_docs

#: every eleventh part's payload is cut off before its end
BROKEN = 11


def cache_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's ChEMBL entries as cache documents of four shards, and one cut document per brand."""
    cache = dictionary_df(spark, sf_dir).filter("source = 'ChEMBL'")
    whole = json_docs.cache_documents(cache, shards=4).select(F.concat(F.lit("shard "), F.col("shard")).alias("id"), "document")
    cut = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.concat(F.lit('{"name::'), F.lower("p_brand"), F.lit('": {"source": '))
                                                 .alias("document")).distinct()
    return whole.unionByName(cut)


@register("json_cache", f"""WITH {DICT_SQL}
SELECT name_key, CASE WHEN NOT is_negative THEN source END source, CASE WHEN NOT is_negative THEN chembl_id END chembl_id,
       CASE WHEN NOT is_negative THEN smiles END smiles, is_negative::INTEGER is_negative FROM dict WHERE source = 'ChEMBL'""")
def q_json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache written as JSON maps with null negatives and read back, broken documents aside."""
    entries, _ = json_docs.cache_entries(cache_docs(spark, sf_dir))
    return entries.withColumn("is_negative", F.col("is_negative").cast("int"))


@register("json_rejects", """SELECT DISTINCT p_brand id, '{"name::' || lower(p_brand) || '": {"source": ' AS document FROM part""")
def q_json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are no cache, whole."""
    return json_docs.cache_entries(cache_docs(spark, sf_dir))[1]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search payload per part: two molecules, the second without structure when ``p_size`` is even; some cut off."""
    p = fx.table(spark, sf_dir, "part")
    null = F.lit(None).cast("string")
    structure = F.struct(F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("canonical_smiles"), F.concat(F.lit("IK-"), "p_brand").alias("standard_inchi_key"))
    one = F.struct(F.concat(F.lit("CHEMBL"), F.col("p_partkey")).alias("molecule_chembl_id"), F.col("p_name").alias("pref_name"), structure.alias("molecule_structures"))
    two = F.struct(F.concat(F.lit("ALT"), F.col("p_partkey")).alias("molecule_chembl_id"), null.alias("pref_name"),
                   F.when(F.col("p_size") % 2 == 1, structure).alias("molecule_structures"))
    text = F.to_json(F.struct(F.array(one, two).alias("molecules"), F.lit(2).alias("unread_field")), {"ignoreNullFields": "false"})
    broken = F.col("p_partkey") % BROKEN == 0
    return p.select(F.col("p_partkey").alias("drug_id"), F.when(broken, F.substr(text, F.lit(1), F.length(text) - 5)).otherwise(text).alias("document"))


@register("json_payload", f"""WITH m AS (SELECT p_partkey drug_id, 0 rank, 'CHEMBL' || p_partkey molecule_id, p_name pref_name,
       CASE WHEN p_size % 3 <> 0 THEN p_type END canonical, 'IK-' || p_brand alternate FROM part
  UNION ALL SELECT p_partkey, 1, 'ALT' || p_partkey, NULL, CASE WHEN p_size % 2 = 1 AND p_size % 3 <> 0 THEN p_type END,
       CASE WHEN p_size % 2 = 1 THEN 'IK-' || p_brand END FROM part)
SELECT drug_id, rank::INTEGER rank, molecule_id, pref_name, coalesce(canonical, alternate) smiles,
       CASE WHEN canonical IS NOT NULL THEN 'smiles' WHEN alternate IS NOT NULL THEN 'inchi_key' END smiles_kind
  FROM m WHERE drug_id % {BROKEN} <> 0""")
def q_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 + J10: nested search payloads parsed with their schema, structure or its alternate per molecule."""
    from dyad.operators.resolve import structure_of

    parsed, _ = json_docs.parse(payloads(spark, sf_dir), json_docs.SEARCH_PAYLOAD)
    return structure_of(json_docs.search_hits(parsed)).select("drug_id", "rank", "molecule_id", "pref_name", "smiles", "smiles_kind")


@register("json_props", """SELECT event_type, json_extract(props, '$.k')::BIGINT k, count(*) n FROM events GROUP BY ALL""")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON field access with a schema on every event; rejected documents would be missing here."""
    ev = fx.table(spark, sf_dir, "events").select("event_type", F.col("props").alias("document"))
    good, _ = json_docs.parse(ev, "k long")
    return good.groupBy("event_type", F.col("parsed.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
