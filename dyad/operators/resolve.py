"""Entity resolution and lookups.

The reference resolves compound names against web services one row at a
time.  Here the services' answers are dictionary tables, and resolution is
joins: candidate names are exploded with their position, matched against the
dictionary, and the best hit per entity is chosen with ``min_by`` (merged
map-side, so an entity with many candidates is never one task's problem).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.functions.strings import cache_key, candidate_names
from dyad.operators.joins import join_small

#: source preference for a name found in several dictionaries (fixed: first service, then the fallback)
SOURCE_RANK = {"ChEMBL": 0, "PubChem": 1}


def lookup_strict(df: DataFrame, store: DataFrame, key: str, what: str = "id") -> DataFrame:
    """Inner join to a keyed store; raise if any key of ``df`` is missing."""
    missing = df.select(key).distinct().join(store.select(key), key, "left_anti")
    n_missing = missing.count()
    if n_missing:
        sample = [r[0] for r in missing.limit(5).collect()]
        raise ValueError(f"{n_missing} {what}s without an entry in the store, e.g. {sample}")
    return df.join(store, key, "inner")


def unmatched(entities: DataFrame, matched: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct entities with no match."""
    cols = list(cols or [key])
    return entities.select(*cols).join(matched.select(key), key, "left_anti").dropDuplicates([key])


def name_candidates(screened: DataFrame, id_col: str = "drug_id", name: str = "drug_name",
                    synonyms: str = "synonyms") -> DataFrame:
    """``(id, pos, name, name_key)``, name first then synonyms."""
    exploded = screened.select(id_col, F.posexplode(candidate_names(name, synonyms)).alias("pos", "name"))
    return exploded.withColumn("name_key", cache_key("name"))


def resolve_names(candidates: DataFrame, dictionary: DataFrame, id_col: str = "drug_id",
                  value_cols: Sequence[str] = ("source", "chembl_id", "smiles")) -> DataFrame:
    """First hit wins -- names in candidate order; per name source rank;
    negative entries skipped.  ``dictionary`` has ``name_key, source,
    is_negative`` plus ``value_cols``."""
    rank = F.create_map(*[x for k, v in SOURCE_RANK.items() for x in (F.lit(k), F.lit(v))])
    hits = candidates.join(dictionary.filter(~F.col("is_negative")), "name_key", "inner").withColumn(
        "_src_rank", F.coalesce(rank[F.col("source")], F.lit(len(SOURCE_RANK)))
    )
    keep = ["pos", "name", *value_cols]
    best = F.min_by(F.struct(*keep), F.struct("pos", "_src_rank"))
    return hits.groupBy(id_col).agg(best.alias("_b")).select(id_col, *[F.col(f"_b.{c}").alias(c) for c in keep])


def best_match(hits: DataFrame, query: str = "query", pref: str = "pref_name", rank: str = "rank",
               cols: Sequence[str] = ("molecule_id",)) -> DataFrame:
    """Per query, an exact (case-insensitive) preferred-name match first,
    else the best search rank."""
    exact = (F.lower(F.col(pref)) == F.lower(F.col(query))).cast("int")
    order = F.struct((F.lit(1) - exact).alias("_ne"), F.col(rank).alias("_rk"))
    keep = [*cols, pref, rank]
    best = F.min_by(F.struct(*keep, exact.alias("is_exact")), order)
    return hits.groupBy(query).agg(best.alias("_b")).select(
        query, *[F.col(f"_b.{c}").alias(c) for c in [*keep, "is_exact"]]
    )


def search_best(queries: DataFrame, molecules: DataFrame, tokens: Callable[[Column], Column], query: str = "query",
                pref: str = "pref_name", rank: str = "rank", cols: Sequence[str] = ("molecule_id",)) -> DataFrame:
    """J9 with its search: :func:`best_match` over the molecules that share a token
    (``tokens`` of the lower-cased name) with the query, without making the hits.

    An index keeps the best rank of each token and of each whole name, so a word
    that a third of all molecules share is one row, and a query meets as many rows
    as it has tokens.  Ranks that are null come last, equal ranks go by ``cols``.
    Queries are distinct; a null query, one without a token and one without a hit
    have no row."""
    keep = [*cols, pref, rank]
    order = F.struct(F.col(rank).isNull().alias("n"), F.col(rank).alias("r"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    known = molecules.select(F.struct(*keep).alias("_m"), order.alias("_o"), F.lower(pref).alias("_l"))
    first = [F.min_by("_m", "_o").alias("_m"), F.min("_o").alias("_o")]
    by_token = known.select("_m", "_o", F.explode(F.array_distinct(tokens(F.col("_l")))).alias("_t")).groupBy("_t").agg(*first)
    by_name = known.filter(F.col("_l").isNotNull()).groupBy("_l").agg(F.min_by("_m", "_o").alias("_exact"))
    asked = queries.select(query).distinct().select(query, F.lower(query).alias("_l"))
    words = asked.select(query, "_l", F.explode(F.array_distinct(tokens(F.col("_l")))).alias("_t"))
    found = join_small(words, by_token, "_t").groupBy(query, "_l").agg(F.min_by("_m", "_o").alias("_m"))
    both = found.join(by_name, "_l", "left")
    best = F.coalesce("_exact", "_m")
    return both.select(query, *[best[c].alias(c) for c in keep], F.col("_exact").isNotNull().cast("int").alias("is_exact"))


def structure_of(df: DataFrame, canonical: str = "canonical_smiles", alternate: str = "standard_inchi_key") -> DataFrame:
    """Canonical structure, else the alternate identifier, labelled (Q22)."""
    return df.withColumn("smiles", F.coalesce(F.col(canonical), F.col(alternate))).withColumn(
        "smiles_kind",
        F.when(F.col(canonical).isNotNull(), F.lit("smiles")).when(F.col(alternate).isNotNull(), F.lit("inchi_key")),
    )


def apply_overrides(resolved: DataFrame, overrides: DataFrame, key: str = "drug_id", col: str = "smiles") -> DataFrame:
    """Manual ``(key, col)`` overrides take precedence."""
    ov = overrides.select(key, F.col(col).alias("_ov"))
    return join_small(resolved, ov, key, how="left").withColumn(
        "override_used", F.col("_ov").isNotNull()
    ).withColumn(col, F.coalesce(F.col("_ov"), F.col(col))).drop("_ov")


def upsert_cache(cache: DataFrame, new: DataFrame, key: str = "name_key") -> DataFrame:
    """New entries replace old ones with the same key (anti-join + union);
    write the result to a new path."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def align_blocks(base: DataFrame, blocks: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Attach feature blocks by key (each block one row per key); the
    assembler later concatenates them in a fixed order."""
    out = base
    for block, key in blocks:
        out = out.join(block, key, "left")
    return out


def subset(df: DataFrame, assignment: DataFrame, keys: Sequence[str], split: str, split_col: str = "split") -> DataFrame:
    """Rows of one split via a join with the assignment table."""
    return df.join(assignment.filter(F.col(split_col) == split).select(*keys), list(keys), "left_semi")
