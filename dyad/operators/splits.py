"""Leakage-free splits and folds (K1-K6, O3, P20).

Orders come from ``md5("<seed>:<key>")`` rather than a NumPy permutation, so
the same seed gives the same assignment in any engine and any partitioning.
Ranks are computed with :func:`dyad.operators.order.dense_index` (range
partitions + offsets), never with a window over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.operators.joins import join_null_safe, join_small
from dyad.operators.order import dense_index
from dyad.session import cut_lineage

SPLIT_GROUPS = ("drug_id", "cell_id")
#: slots made by one row of the slot table in :func:`balanced_group_kfold`
SLOT_RUN = 65_536


def order_key(cols: Sequence[str] | str, seed: int) -> Column:
    """``md5('<seed>:<k1>:<k2>...')`` -- a seeded, engine-independent shuffle key."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    body = F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
    return F.md5(F.concat(F.lit(f"{seed}:"), body))


def frac_count(frac: float, n: int) -> int:
    """``ceil(frac * n)`` robust to float noise (``0.1/0.8`` must not add a group)."""
    return int(math.ceil(round(frac * n, 9)))


def group_split(
    df: DataFrame, group: str = "drug_id", test: float = 0.2, val: float = 0.1, seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Two-stage group split (K1): ``ceil(test*G)`` groups to test, then
    ``ceil(val/(1-test) * rest)`` of the remaining groups to val (second stage
    uses ``seed + 1``), the rest to train.  Sizes are fractions of groups (Q11).
    Rows without a group (NULL) are one group, so that every row gets a split."""
    if group not in SPLIT_GROUPS:
        raise ValueError(f"cannot split by {group!r}: expected one of {SPLIT_GROUPS}")
    groups = cut_lineage(df.select(group).distinct())
    n_groups = groups.count()
    g1 = dense_index(groups.withColumn("_k", order_key(group, seed)), ["_k", group], out="_r1", known_rows=n_groups)
    n_test = frac_count(test, n_groups)
    n_val = frac_count(val / (1.0 - test), n_groups - n_test)
    rest = g1.filter(F.col("_r1") >= n_test).select(group).withColumn("_k", order_key(group, seed + 1))
    g2 = dense_index(rest, ["_k", group], out="_r2", known_rows=n_groups - n_test).select(group, "_r2")
    assign = join_null_safe(g1, g2, [group], "left").select(
        group,
        F.when(F.col("_r1") < n_test, F.lit("test")).when(F.col("_r2") < n_val, F.lit("val"))
        .otherwise(F.lit("train")).alias(out),
    )
    # One row per group; broadcast only when the group count allows it.
    return join_small(df, assign, group, how="inner", known_rows=n_groups, null_safe=True)


def _water_fill(loads: list[int], size: int, m: int) -> list[int]:
    """How many of ``m`` equal items of ``size`` each fold receives when every
    item goes to the lightest fold (ties: lowest index).  Exact, O(k log)."""
    def keys_le(x: int) -> int:
        return sum((x - L) // size + 1 for L in loads if x >= L)

    lo, hi = min(loads), min(loads) + m * size
    while lo < hi:
        mid = (lo + hi) // 2
        if keys_le(mid) >= m:
            hi = mid
        else:
            lo = mid + 1
    x = lo
    below = [((x - 1 - L) // size + 1) if x - 1 >= L else 0 for L in loads]
    left = m - sum(below)
    take = []
    for j, L in enumerate(loads):
        hit = x >= L and (x - L) % size == 0
        take.append(1 if hit and left > 0 else 0)
        left -= take[-1]
    return [b + t for b, t in zip(below, take)]


def balanced_group_kfold(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Balanced group k-fold (K3): groups by size descending go to the lightest
    fold (ties: group key ascending, then lowest fold).

    The greedy is exact but not run group by group: groups of equal size form a
    level, and within a level the i-th group (by key) takes the i-th smallest
    slot ``(load_j + t*size, j)``.  The driver only walks the size histogram to
    get each level's starting loads: one row per distinct group size, at most
    sqrt(2 * rows) of them.  Slots and group ranks are generated (in runs of
    :data:`SLOT_RUN`) and matched as distributed joins.  NULL is a group.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    hist = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_m")).orderBy(F.desc("_size")).collect()
    loads = [0] * k
    levels = []
    for row in hist:
        s, m = int(row["_size"]), int(row["_m"])
        take = _water_fill(loads, s, m)
        levels += [(s, j, loads[j], take[j]) for j in range(k) if take[j] > 0]
        loads = [L + t * s for L, t in zip(loads, take)]
    schema = T.StructType([T.StructField("_size", T.LongType()), T.StructField(out, T.IntegerType()),
                           T.StructField("_load", T.LongType()), T.StructField("_take", T.LongType())])
    level_df = spark.createDataFrame(levels, schema)
    last_run = F.floor((F.col("_take") - 1) / SLOT_RUN)
    runs = level_df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), last_run))).repartition("_size", out, "_run")
    slots = runs.select("_size", out, F.explode(F.sequence(
        F.col("_run") * SLOT_RUN, F.least(F.col("_take"), (F.col("_run") + 1) * SLOT_RUN) - 1)).alias("_t"), "_load",
    ).withColumn("_slot_key", F.col("_load") + F.col("_t") * F.col("_size"))
    slots = dense_index(slots, ["_slot_key", out], out="_i", by="_size").select("_size", "_i", out)
    ranked = dense_index(sizes, [group], out="_i", by="_size")
    assign = ranked.join(slots, ["_size", "_i"], "inner").select(group, out)
    return join_small(df, assign, group, how="inner", null_safe=True)


def plain_kfold(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Ungrouped k-fold (K4): stable index over the seeded md5 order, ``idx % k``."""
    keys = list(keys)
    keyed = df.withColumn("_k", order_key(keys, seed))
    return dense_index(keyed, ["_k", *keys], out="_idx").withColumn(
        out, F.pmod(F.col("_idx"), F.lit(k)).cast("int")
    ).drop("_k", "_idx")


def leakage_audit(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """K6: groups that appear in more than one split/fold (must be empty)."""
    return (
        df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter(F.col("n_splits") > 1)
    )


def stable_index(df: DataFrame, keys: Sequence[str], out: str = "idx") -> DataFrame:
    """P20: 0-based row index in business-key order (range partitions + offsets)."""
    return dense_index(df, list(keys), out=out)


def subsample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """O3: exactly ``n`` rows picked by seeded md5 order when the table is larger."""
    keys = list(keys)
    keyed = dense_index(df.withColumn("_k", order_key(keys, seed)), ["_k", *keys], out="_idx")
    return keyed.filter(F.col("_idx") < n).drop("_k", "_idx")


def rows_per_split(df: DataFrame, split: str = "split") -> DataFrame:
    """Row count per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
