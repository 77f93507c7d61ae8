"""JSON documents as tables (S8, J10, JSON functions).

Every reader takes a frame of documents (``id, document``) and a schema, and gives
two frames: the rows, typed as the schema says, and the rejected documents with
their whole text.  A document is rejected if it is no JSON of the schema's shape
(Spark's ``PERMISSIVE`` mode marks it: a syntax error, or a value that can't be
read as its type).  A null or blank document is rejected too.  Fields that the
schema lacks are ignored; missing fields and JSON nulls are null.

The name cache is a map ``key -> null | {source, chembl_id, smiles}``; a null is a
negative entry: the name was looked up and not found.  It is written in shards of
a bounded number of keys, dealt by a hash of the key, one JSON map a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: one entry of the name cache
CACHE_ENTRY = "source string, chembl_id string, smiles string"
#: the fields read of a molecule search and of a property lookup
SEARCH_PAYLOAD = ("molecules array<struct<molecule_chembl_id: string, pref_name: string, "
                  "molecule_structures: struct<canonical_smiles: string, standard_inchi_key: string>>>")
PROPERTY_PAYLOAD = "PropertyTable struct<Properties: array<struct<CID: long, CanonicalSMILES: string>>>"
SHARD_KEYS = 10_000
_BAD = "_bad_document"


def parse(docs: DataFrame, schema: str, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """``docs`` with the parsed struct as ``parsed`` in place of the document, and the rejected rows of ``docs``."""
    marked = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(_BAD, T.StringType())])
    read = F.from_json(F.col(document), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    blank = F.col(document).isNull() | (F.trim(document) == "")
    tried = docs.withColumn("parsed", read)
    bad = blank | F.col("parsed").isNull() | F.col(f"parsed.{_BAD}").isNotNull()
    good = tried.filter(~bad).withColumn("parsed", F.col("parsed").dropFields(_BAD)).drop(document)
    return good, tried.filter(bad).drop("parsed")


def parse_map(docs: DataFrame, entry: str, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """As :func:`parse`, for a document that is a map: one row per entry, ``key`` and
    ``value`` (null for a JSON null).  Entries are wrapped in a struct to be marked."""
    whole = docs.withColumn("_text", F.col(document)).withColumn(document, F.concat(F.lit('{"m":'), F.col(document), F.lit("}")))
    good, bad = parse(whole, f"m map<string, struct<{entry}>>", document)
    # a JSON null or no map at all is not a cache
    no_map = F.col("parsed.m").isNull()
    rows = good.filter(~no_map).drop("_text").select("*", F.explode("parsed.m").alias("key", "value")).drop("parsed")
    rejected = bad.drop(document).unionByName(good.filter(no_map).drop("parsed")).withColumnRenamed("_text", document)
    return rows, rejected.select(*docs.columns)


def cache_entries(docs: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """``name_key, source, chembl_id, smiles, is_negative`` of cache documents, and the rejected ones."""
    rows, rejected = parse_map(docs, CACHE_ENTRY, document)
    return rows.select(F.col("key").alias("name_key"), "value.*", F.col("value").isNull().alias("is_negative")), rejected


def read_documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """``id`` (the file) and ``document``: a line of a file each, or whole files."""
    return spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("id"), F.col("value").alias("document"))


def cache_documents(cache: DataFrame, shards: int | None = None) -> DataFrame:
    """The cache as documents, ``shard, document``; keys must be unique and not null."""
    shards = shards or max(1, -(-cache.count() // SHARD_KEYS))
    entry = F.when(~F.col("is_negative"), F.struct("source", "chembl_id", "smiles"))
    dealt = cache.filter(F.col("name_key").isNotNull()).withColumn("shard", F.pmod(F.xxhash64("name_key"), F.lit(shards)).cast("int"))
    pairs = F.array_sort(F.collect_list(F.struct("name_key", entry.alias("entry"))))
    return dealt.groupBy("shard").agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("document"))


def write_cache(cache: DataFrame, path: str, mode: str = "error") -> None:
    cache_documents(cache).select("document").write.mode(mode).text(path)


def search_hits(parsed: DataFrame) -> DataFrame:
    """The molecules of parsed search payloads with their rank (from 0) and structure fields."""
    keep = [c for c in parsed.columns if c != "parsed"]
    return parsed.select(*keep, F.posexplode("parsed.molecules").alias("rank", "m")).select(
        *keep, "rank", F.col("m.molecule_chembl_id").alias("molecule_id"), "m.pref_name",
        F.col("m.molecule_structures.canonical_smiles").alias("canonical_smiles"),
        F.col("m.molecule_structures.standard_inchi_key").alias("standard_inchi_key"))


def first_property(parsed: Column) -> Column:
    """The structure of a property payload: that of its first entry, null without one."""
    return F.try_element_at(parsed["PropertyTable"]["Properties"], F.lit(1))["CanonicalSMILES"]
