"""Training batches of graphs and complete training samples.

A batch is the disjoint union of its pairs' graphs: node numbers of the graph in
slot ``i`` are shifted by the nodes of the slots before it, edges are shifted
alike, and every node carries its slot (the batch vector).  Offsets are running
sums inside a batch, which holds ``size`` pairs at most, so no window grows with
the table; graphs reach their pairs by key joins whose other side holds a graph's nodes
and edges in lists of at most ``PACK`` each, and a drug that many pairs share is spread by
adaptive skew splitting on the pairs' side.

A pair whose graph has no node takes its slot with no nodes; a null key is such a
pair.  Pairs must be unique in ``order``.  Edges with an end that is no node of
their graph are left out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.operators.graph import G, _Graphs, _split, _whole_graphs
from dyad.operators.joins import join_small
from dyad.operators.order import group_positions
from dyad.operators.quantiles import reads_a_table
from dyad.operators.splits import order_key
from dyad.session import cut_lineage

BATCH_SIZE = 512
#: nodes or edges of a graph in one row of :func:`packed_graphs`
PACK = 4096


@dataclass
class GraphBatches:
    """``slots``: the pairs with ``batch, slot, n_nodes, offset``; ``nodes``: ``batch,
    node, slot`` and the node columns; ``edges``: ``batch, src, dst``."""

    slots: DataFrame
    nodes: DataFrame
    edges: DataFrame


def assign_batches(pairs: DataFrame, order: Sequence[str], size: int = BATCH_SIZE, seed: int | None = None) -> DataFrame:
    """``pairs`` with ``batch`` and ``slot``: consecutive pairs in ``order``, or in an
    order shuffled by ``seed``, ``size`` a batch."""
    order = list(order)
    keyed = pairs if seed is None else pairs.withColumn("_k", order_key(order, seed))
    placed = group_positions(keyed, order if seed is None else ["_k", *order], out="_at", keep=pairs.columns)
    return placed.withColumns({"batch": F.floor(F.col("_at") / size).cast("long"), "slot": (F.col("_at") % size).cast("int")}).drop("_at")


def _taken(index: np.ndarray, first: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``index`` the ``times`` rows from ``first`` on: which of ``index``, and the row."""
    n = times[index]
    which = np.repeat(np.arange(len(index)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - first[index], n)


def _packs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the packs of rows sorted by ``owner``, and the offsets of lists of them."""
    new = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    start = np.flatnonzero(new)
    at = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    start = np.flatnonzero(at % PACK == 0)
    return start, np.append(start, len(owner)).astype(np.int32)


def packed_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, nodes, src, dst``: the nodes of graphs (``_n``, the place in the order of
    ``node_id``, and the other columns) or the places at both ends of their edges, at
    most ``PACK`` a row; nodes without a graph are left out."""
    nodes = nodes if reads_a_table(nodes) else cut_lineage(nodes)
    features = [c for c in nodes.columns if c not in (G, "node_id")]
    rows, large = _split(nodes.filter(F.col(G).isNotNull()), edges, features)
    node = T.StructType([T.StructField("_n", T.LongType()), *[nodes.schema[c] for c in features]])
    ends = T.ArrayType(T.LongType())
    schema = T.StructType([nodes.schema[G], T.StructField("nodes", T.ArrayType(node)), T.StructField("src", ends), T.StructField("dst", ends)])

    def made(t: pa.Table) -> pa.RecordBatch:
        ids = t.column(G).combine_chunks().dictionary_encode().indices
        order = pc.sort_indices(pa.table({"graph": ids, "a": t.column("a")}), [("graph", "ascending"), ("a", "ascending")], null_placement="at_start")
        g = _Graphs(t.take(order))
        first = np.flatnonzero(np.append(True, g.owner[1:] != g.owner[:-1])[: len(g.owner)])
        at = np.arange(len(g.owner)) - np.repeat(first, np.diff(np.append(first, len(g.owner))))
        start, offsets = _packs(g.owner)
        structs = pa.StructArray.from_arrays([pa.array(at), *[g.nodes.column(c).combine_chunks() for c in features]], ["_n", *features])
        # rows that repeat a node all take its edges
        times, by_place = np.bincount(g.place, minlength=g.n), np.argsort(g.place, kind="stable")
        begin = np.cumsum(times) - times
        real = np.flatnonzero(g.leaves & g.reaches)
        which, row = _taken(g.leave[real], begin, times)
        again, other = _taken(g.reach[real][which], begin, times)
        src, dst = by_place[row][again], by_place[other]
        order = np.argsort(g.owner[src], kind="stable")
        src, dst = src[order], dst[order]
        edge_start, edge_offsets = _packs(g.owner[src])
        n, m = len(start), len(edge_start)
        owners = pa.array(np.append(g.owner[start], g.owner[src][edge_start]))
        lists = [pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(edge_offsets, pa.array(at[e]))]) for e in (src, dst)]
        boxes = pa.ListArray.from_arrays(offsets, structs)
        return pa.RecordBatch.from_arrays([g.graph.dictionary.take(owners), pa.concat_arrays([boxes, pa.nulls(m, boxes.type)]), *lists],
                                          names=[G, "nodes", "src", "dst"])

    out = rows.mapInArrow(_whole_graphs(made), schema)
    if not large:
        return out
    numbered = group_positions(large[0], ["node_id"], by=G, out="_n")
    boxes = numbered.groupBy(G, F.floor(F.col("_n") / PACK).alias("_p")).agg(F.collect_list(F.struct("_n", *features)).alias("nodes")).select(G, "nodes")
    ends = numbered.select(G, "node_id", "_n")
    local = (large[1].join(ends.select(G, F.col("node_id").alias("src"), F.col("_n").alias("_s")), [G, "src"])
             .join(ends.select(G, F.col("node_id").alias("dst"), F.col("_n").alias("_d")), [G, "dst"]).select(G, F.array("_s").alias("src"), F.array("_d").alias("dst")))
    return out.unionByName(boxes.unionByName(local, allowMissingColumns=True))


def disjoint_union(slots: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "drug_id") -> GraphBatches:
    """The batches of ``slots`` (pairs with ``batch`` and ``slot``) over graphs
    ``nodes(graph_id, node_id, ...)`` and ``edges(graph_id, src, dst)``."""
    features = [c for c in nodes.columns if c not in (G, "node_id")]
    packed = cut_lineage(packed_graphs(nodes, edges))
    boxes = packed.filter(F.col("nodes").isNotNull()).select(G, "nodes")
    sizes = boxes.groupBy(F.col(G).alias(key)).agg(F.sum(F.size("nodes")).alias("n_nodes"))
    before = Window.partitionBy("batch").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sized = join_small(slots, sizes, key, how="left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
    placed = cut_lineage(sized.withColumn("offset", F.coalesce(F.sum("n_nodes").over(before), F.lit(0))))
    at = placed.select("batch", "slot", "offset", F.col(key).alias(G))
    batch_nodes = at.join(boxes, G).select("batch", "slot", "offset", F.inline("nodes")).select(
        "batch", (F.col("offset") + F.col("_n")).alias("node"), "slot", *features)
    ends = packed.filter(F.col("src").isNotNull()).select(G, F.arrays_zip("src", "dst").alias("ends"))
    batch_edges = at.join(ends, G).select("batch", "offset", F.inline("ends")).select(
        "batch", (F.col("offset") + F.col("src")).alias("src"), (F.col("offset") + F.col("dst")).alias("dst"))
    return GraphBatches(placed, batch_nodes, batch_edges)


def pair_samples(pairs: DataFrame, drugs: DataFrame, expression: DataFrame, tissues: DataFrame | None = None, drug: str = "drug_id",
                 cell: str = "cell_id", y: str = "ln_ic50") -> DataFrame:
    """Every pair with ``sample``, a struct of ``drug``, ``expr``, ``tissue``
    (only with ``tissues``) and ``y``, vectors as ``array<float>``.

    ``drugs``, ``expression`` and ``tissues`` hold one vector per key (the columns
    ``drug_id, vec`` and ``cell_id, vec``); a pair without one of them drops out."""
    out = join_small(pairs, drugs.select(drug, F.col("vec").cast("array<float>").alias("_drug")), drug)
    out = join_small(out, expression.select(cell, F.col("vec").cast("array<float>").alias("_expr")), cell)
    parts = [F.col("_drug").alias("drug"), F.col("_expr").alias("expr")]
    if tissues is not None:
        out = join_small(out, tissues.select(cell, F.col("vec").cast("array<float>").alias("_tissue")), cell)
        parts.append(F.col("_tissue").alias("tissue"))
    return out.withColumn("sample", F.struct(*parts, F.col(y).cast("float").alias("y"))).drop("_drug", "_expr", "_tissue")
