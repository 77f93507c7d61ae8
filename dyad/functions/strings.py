"""Scalar cleaning expressions (P8-P22).  Each returns a ``Column`` built from
Spark built-ins, so it stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   missing-value sentinel produced by str() of a float NaN: "nan"
#   separator between two tissue descriptors: " / "
#   fallback tissue label: "unknown"
#   synonym delimiters: ";" and ","
#   name-cache key prefix: "name::"
NAN_TEXT = "nan"
DESCRIPTOR_SEP = " / "
UNKNOWN = "unknown"
SYNONYM_DELIMS = "[;,]"
CACHE_PREFIX = "name::"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if(c: Column | str, sentinels: Sequence[str] = ("", NAN_TEXT)) -> Column:
    """Sentinel strings to NULL (P10)."""
    c = col_(c)
    return F.when(c.isin(*sentinels), F.lit(None).cast("string")).otherwise(c)


def numeric(c: Column | str) -> Column:
    """Numeric coercion; bad values become NULL instead of failing."""
    return F.trim(col_(c).cast("string")).try_cast("double")


def nan_to_null(c: Column | str) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def collapse_ws(c: Column | str) -> Column:
    """Whitespace runs to one space, then trim (P16); NULL -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(col_(c), F.lit("")), r"\s+", " "))


def split_names(c: Column | str) -> Column:
    """Split on ``;`` or ``,``, normalise each part, drop empties."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), SYNONYM_DELIMS)
    cleaned = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(cleaned, lambda p: p != F.lit(""))


def candidate_names(name: Column | str, synonyms: Column | str) -> Column:
    """Name first, then synonyms, empties removed."""
    both = F.concat(F.array(collapse_ws(name)), split_names(synonyms))
    return F.filter(both, lambda p: p != F.lit(""))


def cache_key(name: Column | str) -> Column:
    """Case-folded lookup key ``name::<lower name>``."""
    return F.concat(F.lit(CACHE_PREFIX), F.lower(col_(name)))


def combine_descriptors(t1: Column | str, t2: Column | str) -> Column:
    """``t1 / t2`` when t2 is non-empty and differs case-insensitively, else t1;
    empty result -> NULL (P11).  NULL descriptors count as absent."""
    a = F.trim(F.coalesce(col_(t1), F.lit("")))
    b = F.trim(F.coalesce(col_(t2), F.lit("")))
    both = (b != F.lit("")) & (F.lower(b) != F.lower(a))
    out = F.when(both, F.concat(a, F.lit(DESCRIPTOR_SEP), b)).otherwise(a)
    return F.when(out == F.lit(""), F.lit(None).cast("string")).otherwise(out)


def tissue_or_unknown(*candidates: Column | str) -> Column:
    """First non-null descriptor, else ``unknown``, trimmed."""
    return F.trim(F.coalesce(*[col_(c) for c in candidates], F.lit(UNKNOWN)))


def strip_literal(c: Column | str, prefix: str) -> Column:
    """Remove every literal occurrence of ``prefix`` (P13, like ``str.replace``)."""
    return F.replace(col_(c), F.lit(prefix), F.lit(""))


def valid_string(c: Column | str) -> Column:
    """True for a non-null, non-empty string."""
    c = col_(c)
    return c.isNotNull() & (F.length(c) > 0)


def default_canonical(c: Column | str) -> Column:
    """Built-in canonical form of an entity string: trimmed, inner whitespace
    removed; empty -> NULL (P22 default)."""
    s = F.regexp_replace(F.trim(col_(c)), r"\s+", "")
    return F.when(s == F.lit(""), F.lit(None).cast("string")).otherwise(s)
