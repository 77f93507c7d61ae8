"""Connected components of a link table, distributed.

Alternating large-star / small-star rounds (Kiveris et al., 2014): every round
is two aggregations with map-side minimum and two equi-joins whose other side
has one row per node, so a hub's links are split by adaptive skew joins.
Nothing is collected but a count and a checksum per round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.session import cut_lineage, scratch


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local components of links ``a-b``: ``(node, smallest node of its
    component)`` for the nodes that are not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:  # pointer jumping
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``links``
    except the smallest of each component.  Links of a node with itself and
    null ends are ignored; an empty table gives an empty table."""
    with scratch() as tables:
        edges = cut_lineage(
            links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
        )
        state = _state(edges)
        while state[0]:
            edges = cut_lineage(_small_star(_large_star(edges)))
            state, last = _state(edges), state
            if state == last:
                break
        return tables.keep(edges).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours (``u > v`` in every row) to the smallest."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
