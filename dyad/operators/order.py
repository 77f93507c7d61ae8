"""Order statistics without a window over a whole group.

Ranks, exact quantiles and stable row indices all need "how many values
come before this one".  A ``Window.partitionBy(group).orderBy(value)``
answers that, but pushes an entire group (or, without a partition key, the
entire table) through one task.  Here the ordered table is range-partitioned
instead: every range partition is a bucket, bucket totals form a small table
whose running sum gives each bucket's offset, and only the running sum
*inside* a bucket is a window (over one bucket, never over a group).

Inputs to :func:`prefix_totals` must have unique ``by + order`` keys
(distinct values with a weight); quantiles of groups build such tables with a
map-side-combined ``groupBy``, so a value that occurs in a third of all rows
is one row here, not a hot partition.  Ranks order the rows themselves, with a
row number after the value (:func:`average_ranks`); quantiles of a whole column
need no order at all (:mod:`dyad.operators.quantiles`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.operators.joins import broadcastable, input_bytes, join_null_safe, join_small
from dyad.operators.quantiles import ordered_bits, reads_a_table, refine_quantiles
from dyad.session import cut_lineage

#: groups above this many rows take the distributed path in :func:`group_quantiles`
HOT_GROUP_ROWS = 2_000_000
#: target input bytes per range bucket in :func:`prefix_agg`
BUCKET_BYTES = 64 * 1024 * 1024
#: target rows per range bucket that a Python task holds whole (:func:`average_ranks`, :func:`pair_sums`)
RANK_ROWS = 250_000
#: most range buckets: their summaries of an ungrouped ordering are folded on the driver
MAX_BUCKETS = 100_000


def _names(cols: Sequence[str] | str | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def prefix_agg(
    df: DataFrame,
    order: Sequence[str] | str,
    by: Sequence[str] | str | None = None,
    value: str | None = None,
    how: str = "sum",
    inclusive: bool = False,
    out: str = "prefix",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Running ``sum`` or ``min``/``max`` of ``value`` (1 per row for a sum with
    ``value=None``) in ``order`` within ``by`` groups, without a window over a group.

    Strictly-before rows only unless ``inclusive``.  ``total`` adds the group's
    total.  ``buckets`` defaults to :func:`bucket_count`.  A NULL in ``by`` is a group.
    """
    order, by = _names(order), _names(by)
    spark = df.sparkSession
    n_buckets = buckets or bucket_count(df)
    fn = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    w = F.col(value) if value else F.lit(1)
    # Range partitions are the buckets; the checkpoint pins each row's bucket so
    # the bucket summaries and the in-bucket running values agree even if a
    # stage is recomputed after an executor loss.
    ranged = cut_lineage(
        df.repartitionByRange(n_buckets, *[F.col(c) for c in by + order]).withColumn(
            "_bucket", F.spark_partition_id()
        )
    )
    bucket_tot = ranged.groupBy(*by, "_bucket").agg(fn(w).alias("_bt"))
    upto = -1 if not inclusive else 0
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = ranged.withColumn("_in", fn(w).over(inside))
    if not by:
        # One group: at most n_buckets summaries -- fold them on the driver and
        # broadcast the (bucket, offset) pairs.
        summary = {r["_bucket"]: r["_bt"] for r in bucket_tot.collect()}
        offs, acc, grand = [], None, None
        for b in range(n_buckets):
            offs.append(acc)
            v = summary.get(b)
            if v is not None:
                acc = v if acc is None else ({"sum": acc + v, "min": min(acc, v), "max": max(acc, v)}[how])
        grand = acc
        # (bucket, offset) has exactly n_buckets rows: a proven bound for a broadcast
        vtype = ranged.schema[value].dataType.simpleString() if value else "bigint"
        if how == "sum" and vtype in ("tinyint", "smallint", "int"):
            vtype = "bigint"
        cast = float if vtype in ("double", "float") else (lambda o: o)
        off_df = spark.createDataFrame([(b, None if o is None else cast(o)) for b, o in enumerate(offs)],
                                       f"_bucket int, _off {vtype}")
        res = local.join(F.broadcast(off_df), "_bucket", "left")
        if total:
            res = res.withColumn(total, F.lit(grand))
    else:
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = bucket_tot.withColumn("_off", fn("_bt").over(before))
        keep = ["_bucket", "_off"] + by
        if total:
            offsets = offsets.withColumn(total, fn("_bt").over(Window.partitionBy(*by)))
            keep.append(total)
        # both sides are hashed by (by, _bucket) already, so the join adds no shuffle
        res = join_null_safe(local, offsets.select(*keep), by + ["_bucket"])
    if how == "sum":
        combined = F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))
    else:
        combined = (F.least if how == "min" else F.greatest)(F.col("_off"), F.col("_in"))
    return res.withColumn(out, combined).drop("_off", "_in", "_bucket")


def prefix_totals(
    df: DataFrame,
    order: Sequence[str] | str,
    by: Sequence[str] | str | None = None,
    weight: str | None = None,
    out: str = "less_than",
    total: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` (1 per row if None) over rows of the same ``by`` group
    that sort strictly before this row on ``order`` (unique ``by + order`` keys)."""
    return prefix_agg(df, order, by, weight, "sum", False, out, total, buckets)


def _local_positions(n_by: int, kept: list[str]):
    """A bucket sorted by its first ``n_by`` columns and an order -> its ``kept`` columns with
    ``_at`` (place in the group's rows here), ``_rows`` (how many those are) and ``_edge`` (the
    group is the first or last one here, so it may lie in other buckets too)."""

    def run(batches):
        t = _whole_bucket(batches)
        if t is None:
            return
        group = np.zeros(t.num_rows, bool)
        group[0] = True
        for c in range(n_by):
            group |= _change(t.column(c))
        start = np.flatnonzero(group)
        size = np.diff(np.append(start, t.num_rows))
        edge = np.zeros(len(start), bool)
        edge[[0, -1]] = True
        t = t.select(kept)
        for name, made in (("_at", np.arange(len(group)) - np.repeat(start, size)), ("_rows", np.repeat(size, size)), ("_edge", np.repeat(edge, size))):
            t = t.append_column(name, pa.array(made))
        yield from t.to_batches(max_chunksize=65_536)

    return run


def group_positions(df: DataFrame, order: Sequence[str] | str, by: Sequence[str] | str | None = None, out: str = "idx",
                    total: str | None = None, keep: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (unique keys) within ``by``, a NULL in
    which is a group; ``total`` adds the rows of the group.  Columns other than
    ``by`` and ``keep`` (default: all) are left out.

    Like :func:`prefix_totals` of rows, but the rows are exchanged once: a range bucket
    numbers its rows in its task, and only groups that lie in several buckets
    get an offset, from a table of at most two rows a bucket."""
    order, by = _names(order), _names(by)
    src = df if reads_a_table(df) else cut_lineage(df)
    kept = [*by, *[c for c in (src.columns if keep is None else keep) if c not in by]]
    src = src.select(*by, *[c for c in src.columns if c not in by and c in {*kept, *order}])
    ranged = src.repartitionByRange(buckets or rank_buckets(src), *by, *order).sortWithinPartitions(*by, *order)
    schema = T.StructType([*[src.schema[c] for c in kept], T.StructField("_at", T.LongType()), T.StructField("_rows", T.LongType()),
                           T.StructField("_edge", T.BooleanType())])
    placed = cut_lineage(ranged.mapInArrow(_local_positions(len(by), kept), schema).withColumn("_bucket", F.spark_partition_id()))
    ends = placed.filter("_edge and _at = 0").select(*by, "_bucket", "_rows")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(ends.withColumns({"_off": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_all": F.sum("_rows").over(group),
                                            "_in": F.count(F.lit(1)).over(group)}).filter("_in > 1").drop("_rows", "_in"))
    n_offsets = offsets.count()
    at, rows = F.col("_at"), F.col("_rows")
    if n_offsets:
        placed = join_small(placed, offsets, [*by, "_bucket"], how="left", known_rows=n_offsets, null_safe=True)
        at, rows = at + F.coalesce("_off", F.lit(0)), F.coalesce("_all", "_rows")
    return placed.select(*[c for c in src.columns if c in kept], at.alias(out), *([rows.alias(total)] if total else []))


def value_counts(df: DataFrame, value: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """Distinct non-null ``(by, value)`` with multiplicity ``_c`` (map-side combined)."""
    by = _names(by)
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))


def bucket_count(df: DataFrame) -> int:
    """Range buckets for ``df``: one per :data:`BUCKET_BYTES` of input, at least the
    default parallelism (or the shuffle partitions, if fewer) and at most
    :data:`MAX_BUCKETS`; the shuffle partitions if the size is unknown."""
    spark = df.sparkSession
    partitions, size = int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    floor = min(partitions, spark.sparkContext.defaultParallelism)
    return partitions if size is None else max(1, floor, min(MAX_BUCKETS, -(-size // BUCKET_BYTES)))


def rank_buckets(df: DataFrame) -> int:
    """Range buckets of a stored table whose buckets are held whole in Python: at most
    about :data:`RANK_ROWS` rows each, however well the table is compressed."""
    return min(MAX_BUCKETS, max(bucket_count(df), -(-df.count() // RANK_ROWS)))


def with_row_id(df: DataFrame, name: str = "_id") -> DataFrame:
    """``df`` with a unique long that does not change when a task is repeated:
    it numbers the rows of stored files."""
    return (df if reads_a_table(df) else cut_lineage(df)).withColumn(name, F.monotonically_increasing_id())


def _change(column: pa.ChunkedArray) -> np.ndarray:
    """Rows whose value differs from the row before (nulls are equal)."""
    if pa.types.is_floating(column.type):
        null, bits = column.is_null().to_numpy(), ordered_bits(column.to_numpy().astype(float))
        return np.append(True, (null[1:] != null[:-1]) | (~null[1:] & (bits[1:] != bits[:-1])))
    code = column.combine_chunks().dictionary_encode(null_encoding="encode")
    code = (code if isinstance(code, pa.DictionaryArray) else code.combine_chunks()).indices.to_numpy(zero_copy_only=False)
    return np.append(True, code[1:] != code[:-1])


def _whole_bucket(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _places(t: pa.Table, n_by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket sorted by its first ``n_by`` columns and the next one, the value:
    first rows of the groups (the nulls of a group are one of their own), and per row
    the rows of its group before its value, the rows of its value, and the value as
    a number in order."""
    n, column = t.num_rows, t.column(n_by)
    group = np.zeros(n, bool)
    group[0] = True
    for c in range(n_by):
        group |= _change(t.column(c))
    null = column.is_null().to_numpy()
    bits = (ordered_bits(column.to_numpy().copy()) ^ np.uint64(1 << 63)).view(np.int64)
    group[1:] |= null[1:] != null[:-1]
    value = group.copy()
    value[1:] |= (bits[1:] != bits[:-1]) & ~null[1:]
    starts, groups = np.flatnonzero(value), np.flatnonzero(group)
    which = np.cumsum(value) - 1
    less = starts[which] - groups[np.cumsum(group) - 1]
    return groups, less, np.diff(np.append(starts, n))[which], bits


def _local_ranks(n_by: int):
    """A bucket's rows with ``_less``, ``_ties`` and ``_bits`` (see :func:`_places`)."""

    def run(batches):
        t = _whole_bucket(batches)
        if t is not None:
            for name, made in zip(("_less", "_ties", "_bits"), _places(t, n_by)[1:]):
                t = t.append_column(name, pa.array(made, pa.int64()))
            yield from t.to_batches(max_chunksize=65_536)

    return run


def _ranged(src: DataFrame, by: list[str], value: str, row_id: str, others: Sequence[str], buckets: int | None) -> DataFrame:
    """``by``, the value as ``_v`` and ``others`` in range buckets by group, value and row number, sorted."""
    typed = src.select(*by, F.col(value).cast("double").alias("_v"), *others)
    order = [*by, F.col("_v").isNull(), "_v"]
    return typed.repartitionByRange(buckets or rank_buckets(src), *order, row_id).sortWithinPartitions(*order)


def _bucket_limits(ends: DataFrame, by: list[str]) -> DataFrame:
    """From each bucket's groups (``_bucket, n, lo, hi, lo_n, hi_n``: rows, first and
    last value and their rows) ``_before`` (rows of the group in earlier buckets) and,
    over all buckets, ``_lo_p`` (earlier rows of the first value), ``_lo_t`` and
    ``_hi_t`` (all rows of the first and of the last value)."""
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sides = F.array_distinct(F.array(F.struct(F.col("lo").alias("e"), F.col("lo_n").alias("c")), F.struct(F.col("hi").alias("e"), F.col("hi_n").alias("c"))))
    edge = ends.withColumn("_s", F.explode(sides)).select("*", "_s.e", "_s.c")
    same = Window.partitionBy(*by, "e")
    earlier = same.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_t", F.sum("c").over(same)).withColumn("_p", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    kept = [F.first(c).alias(c) for c in ends.columns if c not in (*by, "_bucket")]
    return edge.groupBy(*by, "_bucket").agg(
        *kept, F.min_by("_t", "e").alias("_lo_t"), F.min_by("_p", "e").alias("_lo_p"), F.max_by("_t", "e").alias("_hi_t"))


def average_ranks(
    df: DataFrame, value: str, by: Sequence[str] | str | None = None, out: str | None = None,
    row_id: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """Average rank (1-based, ties share the mean of their positions) of ``value``
    within ``by``; null values get a null rank.  Same as ``scipy.stats.rankdata``.

    Rows are range-partitioned once by group, value and a row number, so rows of
    one value may fill many buckets.  A bucket ranks its own rows; a table of one
    row per bucket and group holds the rows before it, and how many rows of its
    first and last value lie in other buckets.  Nothing is joined on a value.
    ``row_id`` names a unique long column of ``df`` (default: made here)."""
    by = _names(by)
    out = out or f"{value}_rank"
    src = df if row_id else with_row_id(df, "_id")
    ranged = _ranged(src, by, value, row_id or "_id", [c for c in src.columns if c not in by], buckets)
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_less", "_ties", "_bits")]])
    placed = cut_lineage(ranged.mapInArrow(_local_ranks(len(by)), schema).withColumn("_bucket", F.spark_partition_id()))
    ends = placed.filter(F.col("_v").isNotNull()).groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("_bits").alias("lo"), F.max("_bits").alias("hi"),
        F.min_by("_ties", "_bits").alias("lo_n"), F.max_by("_ties", "_bits").alias("hi_n"))
    limits = cut_lineage(_bucket_limits(ends, by)).drop("n", "lo_n", "hi_n")
    rows = join_small(placed, limits, [*by, "_bucket"], how="left", null_safe=True)
    first, last = F.col("_bits") == F.col("lo"), F.col("_bits") == F.col("hi")
    less = F.col("_before") + F.when(first, -F.col("_lo_p")).otherwise(F.col("_less"))
    ties = F.when(first, F.col("_lo_t")).when(last, F.col("_hi_t")).otherwise(F.col("_ties"))
    rank = F.when(F.col("_v").isNotNull(), less + (ties + F.lit(1)) / F.lit(2.0))
    return rows.select(*[c for c in src.columns if row_id or c != "_id"], rank.alias(out))


#: what :func:`pair_sums` adds up per bucket and group
_PAIR_SUMS = ("r_lo", "r_mid", "r_hi", "r2", "l_mid", "l2_mid", "rl_mid", "n_mid", "se", "ae", "my", "mv", "cyy", "cvv", "cyv")


def _pair_sums(n_by: int):
    """A bucket sorted by group and value ``_v`` (then ``_y``, ``_r``) -> one row per group."""

    def run(batches):
        t = _whole_bucket(batches)
        if t is None:
            return
        groups, less, ties, bits = _places(t, n_by)
        size = np.diff(np.append(groups, t.num_rows))
        owner = np.repeat(np.arange(len(groups)), size)
        v, y, r = (t.column(n_by + i).to_numpy() for i in range(3))
        lo, hi = bits[groups], bits[groups + size - 1]
        first = bits == lo[owner]
        last = (bits == hi[owner]) & ~first
        mid = ~(first | last)
        local = less + (ties + 1) / 2

        def add(x):
            return np.add.reduceat(np.where(np.isnan(r), 0, x), groups)

        with np.errstate(invalid="ignore", over="ignore"):
            my, mv = (np.add.reduceat(x, groups) / size for x in (y, v))
            dy, dv = y - my[owner], v - mv[owner]
            made = (add(first * r), add(mid * r), add(last * r), add(r * r), add(mid * local), add(mid * local * local), add(mid * local * r),
                    np.add.reduceat(mid, groups, dtype=float), np.add.reduceat((y - v) ** 2, groups), np.add.reduceat(np.abs(y - v), groups),
                    my, mv, np.add.reduceat(dy * dy, groups), np.add.reduceat(dv * dv, groups), np.add.reduceat(dy * dv, groups))
        whole = ~t.column(n_by).is_null().to_numpy()[groups]
        at = pa.array(groups)
        ints = (np.where(whole, size, 0), lo, hi, ties[groups], ties[groups + size - 1])
        yield pa.RecordBatch.from_arrays(
            [*[t.column(c).combine_chunks().take(at) for c in range(n_by)], *[pa.array(x.astype(np.int64)) for x in ints],
             *[pa.array(x.astype(float)) for x in made]],
            names=[*t.schema.names[:n_by], "n", "lo", "hi", "lo_n", "hi_n", *_PAIR_SUMS])

    return run


def pair_sums(df: DataFrame, y: str, y_rank: str, value: str, by: Sequence[str], row_id: str, buckets: int | None = None) -> DataFrame:
    """Per ``by`` group over the rows with ``value``: ``n``, sums of products of the
    centred average ranks of ``y`` (given) and ``value`` (``rr, ry, rv``), of the
    centred numbers (``yv, yy, vv``), of squared and of absolute differences
    (``se, ae``).  A group without such rows has ``n`` 0.

    The rows are ordered by ``value`` once and added up in their range buckets;
    ranks of a bucket are off by a number that its limits tell, so only sums leave
    it and the ranks of ``value`` are never stored."""
    by = list(by)
    ranged = _ranged(df, by, value, row_id, [F.col(y).alias("_y"), F.col(y_rank).alias("_r"), row_id], buckets)
    ints = [T.StructField(c, T.LongType()) for c in ("n", "lo", "hi", "lo_n", "hi_n")]
    schema = T.StructType([*[ranged.schema[c] for c in by], *ints, *[T.StructField(c, T.DoubleType()) for c in _PAIR_SUMS]])
    sums = cut_lineage(ranged.drop(row_id).mapInArrow(_pair_sums(len(by)), schema).withColumn("_bucket", F.spark_partition_id()))
    parts = _bucket_limits(sums.filter("n > 0"), by)
    n, before = F.col("n"), F.col("_before")
    n_lo, n_hi = F.col("lo_n"), F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.col("hi_n"))
    c_lo = before - F.col("_lo_p") + (F.col("_lo_t") + 1) / F.lit(2.0)
    c_hi = before + n - F.col("hi_n") + (F.col("_hi_t") + 1) / F.lit(2.0)
    rank2 = n_lo * c_lo * c_lo + n_hi * c_hi * c_hi + F.col("l2_mid") + 2 * before * F.col("l_mid") + F.col("n_mid") * before * before
    cross = F.col("r_lo") * c_lo + F.col("r_hi") * c_hi + F.col("rl_mid") + before * F.col("r_mid")
    group = Window.partitionBy(*by)
    mean_y, mean_v = (F.sum(F.col(m) * n).over(group) / F.sum(n).over(group) for m in ("my", "mv"))
    apart = parts.select(*by, "n", "r2", "se", "ae", rank2.alias("v2"), cross.alias("rv"), "cyy", "cvv", "cyv",
                         (F.col("my") - mean_y).alias("dy"), (F.col("mv") - mean_v).alias("dv"))
    total = F.sum("n")
    off = total * ((total + 1) / F.lit(2.0)) * ((total + 1) / F.lit(2.0))
    done = apart.groupBy(*by).agg(
        total.alias("n"), (F.sum("rv") - off).alias("rr"), (F.sum("r2") - off).alias("ry"), (F.sum("v2") - off).alias("rv"),
        F.sum(F.col("cyv") + n * F.col("dy") * F.col("dv")).alias("yv"), F.sum(F.col("cyy") + n * F.col("dy") * F.col("dy")).alias("yy"),
        F.sum(F.col("cvv") + n * F.col("dv") * F.col("dv")).alias("vv"), F.sum("se").alias("se"), F.sum("ae").alias("ae"))
    if not by:
        return done.withColumn("n", F.coalesce("n", F.lit(0)))
    alone = sums.select(*by).distinct()
    return join_null_safe(alone, done, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _interp(lo: Column, hi: Column, above: Column, below: Column) -> Column:
    """Weights as in Spark's ``percentile``, so that both paths of
    :func:`group_quantiles` give the same bits: ``above`` is the distance to the
    upper position, ``below`` that to the lower one."""
    lo, hi = lo.cast("double"), hi.cast("double")
    return F.when(lo == hi, lo).otherwise(above * lo + below * hi)


def distributed_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] | str | None = None,
    names: Sequence[str] | None = None, count_col: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles (``quantile_cont``) per ``by`` group.

    Works for groups of any size: values are counted, ordered through
    :func:`prefix_totals`, and only the rows covering the wanted positions are
    kept.  One output row per group with one column per probability.
    ``count_col`` adds ``count(*)`` and keeps groups without values: a group's
    nulls are one row more, of weight 0.
    """
    by = _names(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    if count_col:
        counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_of"))
        counts = counts.withColumn("_c", F.when(F.col(value).isNotNull(), F.col("_of")).otherwise(F.lit(0)))
    else:
        counts = value_counts(df, value, by)
    pos = prefix_totals(counts, [value], by, weight="_c", out="_lt", total="_n")
    lt, c, n = F.col("_lt"), F.col("_c"), F.col("_n")
    hits, aggs, finals = [], [], []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (n - F.lit(1))
        lo, hi = F.floor(h), F.ceil(h)
        in_lo = (lt <= lo) & (lo < lt + c)
        in_hi = (lt <= hi) & (hi < lt + c)
        hits += [in_lo, in_hi]
        aggs += [F.max(F.when(in_lo, F.col(value))).alias(f"_lo{i}"), F.max(F.when(in_hi, F.col(value))).alias(f"_hi{i}"),
                 F.max(hi - h).alias(f"_ab{i}"), F.max(h - lo).alias(f"_be{i}")]
        finals.append(_interp(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_ab{i}"), F.col(f"_be{i}")).alias(names[i]))
    any_hit = hits[0]
    for cond in hits[1:]:
        any_hit = any_hit | cond
    if count_col:
        nulls = F.col(value).isNull()
        any_hit = any_hit | nulls
        aggs.append((F.max("_n") + F.coalesce(F.max(F.when(nulls, F.col("_of"))), F.lit(0))).alias("_all"))
        finals.append(F.col("_all").alias(count_col))
    # At most 2*len(probs) rows (and the nulls' one) per group survive the filter.
    picked = pos.filter(any_hit)
    return picked.groupBy(*by).agg(*aggs).select(*by, *finals)


def global_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a whole column, returned to the driver (a few scalars)."""
    return refine_quantiles(df, value, probs)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int, seed: int = 17) -> DataFrame:
    """Keys that may hold more than ``hot_rows`` rows, found from a Bernoulli
    sample (a scan, no shuffle of all keys).  The sample is sized so a group of
    ``hot_rows`` rows shows ~100 times; anything seen 25+ times is treated as
    hot.  Missing a group only routes it to the ordinary aggregate (still
    exact); flagging a smaller one only sends it down the distributed path."""
    frac = min(1.0, 100.0 / max(hot_rows, 1))
    sample = df.select(*keys).sample(withReplacement=False, fraction=frac, seed=seed)
    expected = frac * hot_rows
    return sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen")).filter(
        F.col("_seen") >= max(1.0, expected / 4)).select(*keys)


def _sorted_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str], count_col: str | None,
) -> DataFrame:
    """Quantiles per group from the rows in the order of their value.  Raw rows are
    exchanged once: buffers of ``percentile`` are larger than the few rows of a
    usual group, and its hash aggregate sorts by key on both sides anyway."""
    group = Window.partitionBy(*keys)
    placed = df.select(*keys, F.col(value).alias("_v")).withColumns({
        "_at": F.row_number().over(group.orderBy(F.col("_v").asc_nulls_last())) - F.lit(1),
        "_rows": F.count(F.lit(1)).over(group), "_n": F.count("_v").over(group)})
    wanted, aggs, finals = F.col("_at") == 0, [F.max("_rows").alias("_rows")], []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("_n") - F.lit(1))
        lo, hi = F.floor(h), F.ceil(h)
        at_lo, at_hi = F.col("_at") == lo, F.col("_at") == hi
        wanted = wanted | at_lo | at_hi
        aggs += [F.max(F.when(at_lo, F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(at_hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.max(hi - h).alias(f"_ab{i}"), F.max(h - lo).alias(f"_be{i}")]
        finals.append(_interp(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_ab{i}"), F.col(f"_be{i}")).alias(names[i]))
    counted = [F.col("_rows").alias(count_col)] if count_col else []
    return placed.filter(wanted).groupBy(*keys).agg(*aggs).select(*keys, *finals, *counted)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float] = (0.5,),
    names: Sequence[str] | None = None,
    count_col: str | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys`` group, skew-safe.

    Ordinary groups are sorted after one exchange by key (one task per group,
    fine for groups of bounded size).  Groups with more than ``hot_rows`` rows
    are split off and computed with :func:`distributed_quantiles`, so no single
    task ever holds a hot group's values.  Both paths give the same bits; a group
    without values (or with NULL keys) stays.  ``count_col`` adds ``count(*)``.
    """
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    plist = [float(p) for p in probs]
    # written once: the sample need not repeat, and a group must take exactly one path
    hot = cut_lineage(hot_keys(df, keys, hot_rows))
    n_hot = hot.count()

    def cold_agg(frame: DataFrame) -> DataFrame:
        return _sorted_quantiles(frame, keys, value, plist, names, count_col)

    if n_hot == 0:
        return cold_agg(df)
    marked = join_small(df.select(*keys, value), hot.withColumn("_hot", F.lit(True)), keys, how="left", known_rows=n_hot, null_safe=True)
    if not broadcastable(hot, known_rows=n_hot):
        marked = cut_lineage(marked)
    cold = cold_agg(marked.filter(F.col("_hot").isNull()))
    hot_part = distributed_quantiles(marked.filter("_hot"), value, plist, keys, names, count_col or "_all")
    return cold.unionByName(hot_part.select(*cold.columns))


#: a key table of at most this many rows (known by count) is numbered in one task
SMALL_ROWS = 100_000


def dense_index(
    df: DataFrame, order: Sequence[str] | str, out: str = "idx", by: Sequence[str] | str | None = None,
    known_rows: int | None = None,
) -> DataFrame:
    """0-based position of each row in ``order`` (unique keys) within ``by``;
    the distributed replacement for ``row_number() over (order by ...) - 1``,
    which it is itself for a frame counted to be at most :data:`SMALL_ROWS`.
    """
    if not _names(by) and known_rows is not None and known_rows <= SMALL_ROWS:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*_names(order))) - 1).cast("long"))
    return prefix_totals(df, order, by, out=out)
