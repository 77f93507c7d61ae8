"""Pairs inside buckets of any size, without emitting them all.

Rows that share a bucket key are compared in one task, but a bucket of more
than ``chunk_rows`` rows is cut into chunks by a hash of the row, and every
pair of chunks becomes a cell of its own: bounded memory in any task, all
pairs still compared, and the work of a hot bucket spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.session import cut_lineage

CHUNK_ROWS = 4096
#: hot buckets are at most rows / CHUNK_ROWS; their table is broadcast up to this many (16 bytes each)
HOT_BROADCAST_ROWS = 100_000


def cells(rows: DataFrame, key: str, spread: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` plus the ints ``_i``, ``_j`` and ``_side``, dealt out by
    (``key``, ``_i``, ``_j``) and sorted by them.

    A cell with ``_i = _j`` compares all its rows, another one only rows of
    side 0 with rows of side 1; every pair of rows that share a key meets in
    exactly one cell of that key."""
    hot = (
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_rows)
        .select(key, F.ceil(F.col("_n") / chunk_rows).cast("int").alias("_g"))
    )
    hot = cut_lineage(hot)
    n_hot = hot.count()
    zero = F.lit(0)
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= HOT_BROADCAST_ROWS else hot
        with_g = rows.join(hot, key, "left").withColumn(
            "_c", F.when(F.col("_g").isNull(), zero).otherwise(F.pmod(F.xxhash64(spread), F.col("_g"))).cast("int"))
        pairs = F.when(F.col("_g").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("_g") - 1))
        out = with_g.withColumn("_o", F.explode(pairs)).select(
            *rows.columns,
            F.least("_c", "_o").alias("_i"),
            F.greatest("_c", "_o").alias("_j"),
            (F.col("_c") > F.col("_o")).cast("int").alias("_side"),
        )
    else:
        out = rows.select("*", zero.alias("_i"), zero.alias("_j"), zero.alias("_side"))
    return out.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")
