"""Token and encoding queries (G7, G8) over whole ``documents`` texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyad.plans import fixtures as fx
from dyad.plans.registry import register

MAX_LEN = 512
BATCH_DOCS = 32

TOKEN_SQL = r"""tok0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') t FROM documents),
 tok AS (SELECT doc_id, unnest(range(len(t))) pos, unnest(t) token FROM tok0),
 vocab AS (SELECT token, row_number() OVER (ORDER BY token) id FROM (SELECT DISTINCT token FROM tok)),
 seq AS (SELECT doc_id, count(*) seq_len, sum(id)::BIGINT id_sum, sum((pos + 1) * id)::BIGINT id_wsum
           FROM tok JOIN vocab USING (token) WHERE pos < 512 GROUP BY doc_id),
 docs AS (SELECT tok0.doc_id, tok0.doc_id // 32 batch, len(tok0.t) n_tokens, coalesce(seq_len, 0) seq_len,
                 coalesce(id_sum, 0) id_sum, coalesce(id_wsum, 0) id_wsum
            FROM tok0 LEFT JOIN seq USING (doc_id))"""


@register("token_pad_mask", f"""WITH {TOKEN_SQL}
SELECT doc_id, batch, n_tokens, seq_len, max(seq_len) OVER (PARTITION BY batch) pad_len,
       max(seq_len) OVER (PARTITION BY batch) - seq_len n_pad, id_sum, id_wsum FROM docs""")
def q_token_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text tokens -> vocabulary ids -> truncate to the 512-token
    model width -> pad to the batch maximum + attention mask."""
    from dyad.operators.text import build_vocab, encode_ids, pad_batches, tokens

    docs = fx.table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("tokens"))
    vocab = build_vocab(docs)
    ids = encode_ids(docs, "doc_id", "tokens", vocab, MAX_LEN)
    ids = ids.join(docs.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens")), "doc_id")
    padded = pad_batches(ids.withColumn("batch", F.floor(F.col("doc_id") / BATCH_DOCS).cast("bigint")), "batch")
    mask_sum = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m)
    return padded.select(
        "doc_id", "batch", "n_tokens", mask_sum.alias("seq_len"), F.size("input_ids").cast("bigint").alias("pad_len"),
        F.size(F.filter("attention_mask", lambda m: m == 0)).cast("bigint").alias("n_pad"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.aggregate(F.transform("input_ids", lambda x, i: (i + 1) * x), F.lit(0).cast("bigint"),
                    lambda a, x: a + x).alias("id_wsum"),
    )


@register("encode_distinct")
def q_encode_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 (rows-only): every distinct document text encoded once (hashed
    token counts, L2-normalised) and joined back to its documents."""
    from dyad.operators.text import encode_distinct

    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    enc = encode_distinct(docs, "text", "embedding")
    return enc.select("doc_id", F.size("embedding").alias("dim"),
                      F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("sq_norm"))
