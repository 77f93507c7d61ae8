"""Sharding by a k-d tree over document metadata (DataFrame operations only).

A node of the tree is split at the weighted median (weight: bytes) of its rows
along the widest of its metadata dimensions, until it holds the target bytes.
All nodes of a level are split together.  A median is found by refining
histograms: a few aggregations over the metadata table, each leaving at most
nodes x ``BINS`` rows, narrow every node's interval to one value; rows of that
value are split by their place in the order of document ids in the same way, so a
hot value (a source with a third of the rows) does not unbalance a split.  Places
are gapless and every row has its own, so rows without an id, many rows of one id
and ids of any size are split as evenly as others.

Null texts have size 1 (0 bytes plus 1) and crc32 0 as the empty text has; null
metadata is a value of its own below all others, null ids come first.  Equal texts
may lie in different shards.  An empty table gives an empty table.  Texts of any
length are one row's size.  Only ``doc_id, text, source, lang, n_chars`` are read,
so the names of other columns can't clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm.common import numbered
from dyad.operators.order import dense_index, with_row_id
from dyad.session import cut_lineage, scratch

BINS = 65_536
#: a node this much over the target (as a share of it) still is a leaf: splits are exact only up to a row
TOLERANCE = 0.05


def code(column: str) -> Column:
    """A categorical value as a number: the first 32 bits of its md5; null -1."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(-1))


def metadata(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``doc_id, size, text_crc32`` and the dimensions of every document; the
    last, ``tie``, is its place in the order of ids and is unique."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    far = 1 << 61  # differences of clamped values fit a long
    chars = F.greatest(F.least(F.col("n_chars").cast("long"), F.lit(far)), F.lit(-far))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        code("source").alias("d0"), code("lang").alias("d1"), F.coalesce(chars, F.lit(-1)).alias("d2"),
    )
    numbers = with_row_id(rows, "_row")
    return dense_index(numbers, ["doc_id", "_row"], out="tie").drop("_row"), ["d0", "d1", "d2", "tie"]


def kd_leaves(rows: DataFrame, dims: Sequence[str], target: int, max_depth: int) -> DataFrame:
    """``rows`` (``size``, ``tie`` and the longs ``dims``) plus ``node``: the
    leaf, numbered as in a heap (children of n: 2n + 1, 2n + 2)."""
    rows = cut_lineage(rows.withColumn("node", F.lit(0).cast("long")))
    spans = rows.agg(*[F.greatest(F.max(d) - F.min(d), F.lit(1)).alias(d) for d in dims]).first()
    for depth in range(max_depth):
        level = (1 << depth) - 1
        split = _split_nodes(rows.filter(F.col("node") >= level), dims, spans, target)
        if split is None:
            break
        value = _value(dims)
        joined = rows.join(F.broadcast(split), "node", "left")  # at most one row per node
        right = (value > F.col("cut")) | ((value == F.col("cut")) & (
            (F.col("tie") > F.col("tie_cut")) | ((F.col("tie") == F.col("tie_cut")) & ~F.col("cut_left"))))
        node = F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right.cast("long"))
        rows = cut_lineage(joined.withColumn("node", node).select(*rows.columns))
    return rows


def _value(dims: Sequence[str]) -> Column:
    return F.element_at(F.array(*dims), F.col("dim"))


def _split_nodes(rows: DataFrame, dims: Sequence[str], spans, target: int) -> DataFrame | None:
    """``node, dim, cut, tie_cut, cut_left`` of the nodes over the target."""
    stats = rows.groupBy("node").agg(F.sum("size").alias("total"), *[F.min(d).alias(f"lo_{d}") for d in dims],
                                     *[F.max(d).alias(f"hi_{d}") for d in dims])
    widths = [(F.col(f"hi_{d}") - F.col(f"lo_{d}")).cast("double") / F.lit(float(spans[d])) for d in dims]
    dim = F.array_position(F.array(*widths), F.array_max(F.array(*widths))).cast("int")  # the first of the widest
    pick = lambda side: F.element_at(F.array(*[f"{side}_{d}" for d in dims]), F.col("dim"))
    nodes = stats.filter(F.col("total") > target * (1 + TOLERANCE)).withColumn("dim", dim).select(
        "node", "dim", "total", pick("lo").alias("lo"), pick("hi").alias("hi"), F.lit(0).cast("long").alias("below"))
    nodes = cut_lineage(nodes)
    widest = nodes.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0]
    if widest is None:
        return None
    value = _value(dims)
    inside = rows.join(F.broadcast(nodes.select("node", "dim")), "node").select("node", value.alias("v"), "tie", "size")
    nodes = _narrow(inside, nodes, widest)
    inside = inside.join(F.broadcast(nodes.select("node", F.col("lo").alias("cut"))), "node").filter("v = cut").select(
        "node", F.col("tie").alias("v"), "size")
    ends = inside.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ties = cut_lineage(nodes.withColumnRenamed("lo", "cut").drop("hi").join(ends, "node"))
    ties = _narrow(inside, ties, ties.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0])
    return ties.select("node", "dim", "cut", F.col("lo").alias("tie_cut"), (2 * F.col("below") + F.col("mass") <= F.col("total")).alias("cut_left"))


def _narrow(inside: DataFrame, nodes: DataFrame, widest: int) -> DataFrame:
    """``nodes`` with the interval ``lo``-``hi`` of ``v`` narrowed to the
    weighted median: ``below`` bytes lie before it, ``mass`` on it."""
    while True:
        step = F.expr(f"(hi - lo + {BINS}) div {BINS}")
        bounds = F.broadcast(nodes.select("node", "lo", "hi", step.alias("step")))
        binned = inside.join(bounds, "node").filter("v >= lo and v <= hi").withColumn("bin", F.expr("(v - lo) div step"))
        masses = binned.groupBy("node", "bin").agg(F.sum("size").alias("mass"))  # at most nodes x BINS rows
        before = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = masses.withColumn("lower", F.coalesce(F.sum("mass").over(before), F.lit(0)))
        found = sums.join(F.broadcast(nodes.drop("mass")), "node").filter("2 * (below + lower + mass) >= total")
        first = found.groupBy("node").agg(F.min("bin").alias("bin"))
        nodes = cut_lineage(found.join(first, ["node", "bin"]).withColumn("step", step).select(
            *[c for c in nodes.columns if c not in ("lo", "hi", "below", "mass")],
            (F.col("lo") + F.col("bin") * F.col("step")).alias("lo"),
            F.least(F.col("lo") + (F.col("bin") + 1) * F.col("step") - 1, F.col("hi")).alias("hi"),
            (F.col("below") + F.col("lower")).alias("below"), "mass"))
        if widest <= BINS:  # bins were single values
            return nodes
        widest = -(-widest // BINS)


def kd_shards(rows: DataFrame, dims: Sequence[str], target: int, max_depth: int) -> DataFrame:
    """``rows`` plus ``shard``: the leaves from left to right, numbered from 0."""
    leaves = kd_leaves(rows, dims, target, max_depth)
    nodes = leaves.select("node").distinct()  # one row per shard
    depth = F.floor(F.log2(F.col("node") + 1.0))
    place = (F.col("node") + 1.0) / F.pow(F.lit(2.0), depth)  # 1 to 2 from left to right
    order = Window.partitionBy(F.lit(0)).orderBy(place)
    shards = nodes.withColumn("shard", (F.row_number().over(order) - 1).cast("int"))
    return leaves.join(F.broadcast(shards), "node").drop("node")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents in ``shards`` (a power of two) leaves of near equal bytes:
    ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    with scratch() as tables:
        rows, dims = metadata(docs)
        rows = cut_lineage(rows)
        total = rows.agg(F.sum("size")).first()[0] or 0
        placed = cut_lineage(kd_shards(rows, dims, max(-(-total // shards), 1), (shards - 1).bit_length())
                             .select("doc_id", "size", "text_crc32", "shard"))
        slots = tables.keep(cut_lineage(numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot")))
        return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                            F.lit(None).cast("int").alias("grown_shard"))
