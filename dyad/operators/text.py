"""Token sequences and batched encoding of distinct strings.

The vocabulary is built from whole texts with a distributed dense index
(range partitions, no single-partition ``dense_rank``).  Encoding runs once per
distinct string (J6): the default encoder is MLlib's ``HashingTF`` on the
token array (JVM-side); a user encoder runs in ``mapInPandas`` over Arrow
batches, as the reference's micro-batched encoder does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.operators.joins import join_small
from dyad.operators.order import dense_index

#: pad id, reserved below the first vocabulary id (fixed)
PAD_ID = 0


def tokens(c: str) -> F.Column:
    """Whitespace tokens of the whole text, empties dropped."""
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda t: t != F.lit(""))


def build_vocab(df: DataFrame, tokens_col: str = "tokens", first_id: int = PAD_ID + 1) -> DataFrame:
    """``(token, id)`` over all distinct tokens, ids in token order from ``first_id``."""
    distinct = df.select(F.explode(tokens_col).alias("token")).distinct()
    return dense_index(distinct, ["token"], out="_i").select("token", (F.col("_i") + first_id).alias("id"))


def encode_ids(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, max_len: int | None = None) -> DataFrame:
    """Token ids per row, truncated to ``max_len`` (the model input width).
    Returns ``(key, ids array<bigint>)``; a row without tokens gets ``[]``."""
    pos = df.select(key, F.posexplode(tokens_col).alias("pos", "token"))
    if max_len is not None:
        pos = pos.filter(F.col("pos") < max_len)
    ided = join_small(pos, vocab, "token", how="inner")
    seq = ided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_p"))
    seq = seq.select(key, F.transform("_p", lambda s: s["id"]).alias("ids"))
    return df.select(key).join(seq, key, "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def pad_batches(df: DataFrame, batch: str, ids: str = "ids") -> DataFrame:
    """Pad ``ids`` to the longest sequence of its batch with :data:`PAD_ID`
    and add the attention mask (1 = token, 0 = pad)."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_pad_len"))
    out = join_small(df, longest, batch, how="inner")
    n_pad = F.col("_pad_len") - F.size(ids)
    return out.select(
        *[c for c in df.columns if c != ids],
        F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID).cast("bigint"), n_pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n_pad)).alias("attention_mask"),
    )


def hashing_encoder(dims: int = 256) -> Callable[[DataFrame, str, str], DataFrame]:
    """Default encoder: hashed token counts, L2-normalised (JVM-side)."""

    def encode(distinct: DataFrame, text: str, out: str) -> DataFrame:
        toks = distinct.withColumn("_tok", tokens(text))
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims).transform(toks)
        normed = Normalizer(inputCol="_tf", outputCol="_n", p=2.0).transform(tf)
        return normed.select(text, vector_to_array("_n", "float32").alias(out))

    return encode


def pandas_encoder(fn: Callable[[pd.Series], list], dims: int) -> Callable[[DataFrame, str, str], DataFrame]:
    """Wrap a batch function ``texts -> list of vectors`` (e.g. a local model)
    as a ``mapInPandas`` stage; batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``."""

    def encode(distinct: DataFrame, text: str, out: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({text: pdf[text], out: list(fn(pdf[text]))})

        return distinct.mapInPandas(run, f"`{text}` string, `{out}` array<float>")

    return encode


def encode_distinct(df: DataFrame, text: str, out: str = "embedding",
                    encoder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Encode each distinct string once and join the vectors back."""
    encoder = encoder or hashing_encoder()
    src = df.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("_tk", F.sha2(F.col(text), 256))
    # one row per distinct text; the join back goes on the digest, not the text
    distinct = src.select("_tk", text).dropDuplicates(["_tk"])
    vecs = encoder(distinct, text, out).withColumn("_tk", F.sha2(F.col(text), 256)).drop(text)
    return src.join(vecs, "_tk", "left").drop("_tk")
