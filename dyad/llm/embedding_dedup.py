"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at squared distance 2 - 2c or less.  After a
fixed random rotation, vectors are split into blocks of a few dimensions; a
close pair is, in at least one block, within that block's share of the squared
distance (its share of the dimensions).  So a range join per block finds every
close pair: a block's leading coordinates are cut into cells wider than the
block's range, a vector goes to its own cell and to those that its range
reaches upwards, and a pair meets in the cell of its coordinate-wise larger
corner.  Inside a cell, block distances come from matrix products.  Candidates of all blocks are verified exactly, by cosine in double precision;
the first block that a pair is close in counts it, so it counts once.

Equal vectors of a label are one class: copies never meet each other.  Links
are counted where they are found and only their sums and star forests leave a
task.  Cells of any size are cut into chunks (:mod:`dyad.llm.buckets`).

Vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null label link with nothing: ``n_links`` 0, their own component,
kept.  Vectors of other length than most are compared with those of equal
length only.  Rows that repeat a ``vec_id`` count as separate vectors of that
id; a null ``vec_id`` stays, with a null component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm.buckets import cells
from dyad.llm.common import group_starts, ranges, sorted_groups
from dyad.llm.components import connected_components, stars
from dyad.session import cut_lineage, scratch

COSINE = 0.98
BLOCK_DIMS = 16
#: leading coordinates of a block that make its cells, and a cell's width in ranges
CELL_DIMS = 3
CELL_WIDTH = 2.0
#: rotation and rounding move squared distances by less than this
SLACK = 1e-6
ROWS_AT_ONCE = 256
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    if dims not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
        _ROTATIONS[dims] = q * np.sign(np.diag(r))
    return _ROTATIONS[dims]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # squares of very large or small values stay finite
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def block_ranges(dims: int, cosine: float) -> list[tuple[slice, float]]:
    """Each block's dimensions and its share of the squared distance."""
    n = max(1, round(dims / BLOCK_DIMS))
    cuts = [round(i * dims / n) for i in range(n + 1)]
    return [(slice(a, b), (2 - 2 * cosine) * (b - a) / dims + SLACK) for a, b in zip(cuts, cuts[1:])]


def usable(embedding: str = "embedding", label: str = "label") -> F.Column:
    """Can the row link: label, vector and every component there, finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)
            & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0))


def _cell_rows(cosine: float):
    """Classes -> one row per block and cell that the class is compared in."""

    def run(batches):
        for batch in batches:
            cls, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            size = pc.list_value_length(lists).to_numpy()
            for dims in np.unique(size).tolist():
                pick = np.flatnonzero(size == dims)
                own = lists.take(pa.array(pick))
                x = unit(own.flatten().to_numpy(zero_copy_only=False).reshape(len(pick), dims)) @ rotation(dims)
                for b, (part, budget) in enumerate(block_ranges(dims, cosine)):
                    reach = np.sqrt(budget)
                    lead = x[:, part][:, :CELL_DIMS]
                    width = CELL_WIDTH * reach
                    low = np.floor(lead / width).astype(np.int64)
                    high = np.floor((lead + reach) / width).astype(np.int64)  # at most low + 1
                    for corner in range(1 << lead.shape[1]):
                        bits = (corner >> np.arange(lead.shape[1])) & 1
                        reached = ((high > low) | (bits == 0)).all(1)
                        at = pick[reached]
                        n = len(at)
                        cell = low[reached] + bits
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cls[at]), pa.array(batch.column(2).to_numpy()[at]), pa.array(np.full(n, b, np.int32)),
                             pa.array(np.full(n, dims, np.int32)), pa.array(label[at]),
                             pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * lead.shape[1]), pa.array(cell.ravel())),
                             lists.take(pa.array(at))],
                            names=["cls", "copies", "block", "dims", "label", "cell", "vector"])

    return run


def _linker(cosine: float):
    """Sorted cells -> ``a, b, n``: star links (``b`` not null), and per class
    the number of vectors that it links with (``b`` null)."""

    def run(batches):
        for t in sorted_groups(batches, ("key", "_i", "_j")):
            t = t.combine_chunks()
            col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "copies", "block", "dims", "label", "key", "_i", "_j", "_side")}
            lists, cell = t.column("vector").combine_chunks(), t.column("cell").combine_chunks()
            starts = group_starts(col["key"], col["_i"], col["_j"])
            sizes = np.diff(np.append(starts, len(col["cls"])))
            for dims in np.unique(col["dims"]).tolist():
                # a key's rows have one length; groups of one row make no pair
                some = np.flatnonzero((sizes > 1) & (col["dims"][starts] == dims))
                if not len(some):
                    continue
                rows = ranges(starts[some], sizes[some])
                raw = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)
                u = unit(raw)
                x = u @ rotation(dims)
                cells_ = cell.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                own = {k: v[rows] for k, v in col.items()}
                found_a, found_b = [], []
                for i, j in _block_pairs(np.cumsum(sizes[some]), own["block"], x, block_ranges(dims, cosine)):
                    near = _verify(i, j, own, u, x, cells_, dims, cosine)
                    found_a.append(i[near])
                    found_b.append(j[near])
                if not found_a:
                    continue
                i, j = np.concatenate(found_a), np.concatenate(found_b)
                if not len(i):
                    continue
                cls, copies = own["cls"], own["copies"]
                node, at = np.unique(np.concatenate([cls[i], cls[j]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([copies[j], copies[i]])).astype(np.int64)
                a, b = stars(cls[i], cls[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(n)], names=["a", "b", "n"])

    return run


def _block_pairs(stops: np.ndarray, block: np.ndarray, x: np.ndarray, parts: list[tuple[slice, float]]):
    """Row pairs of each group (its rows end at ``stops``) that are within
    their block's budget, in bounded portions."""
    start = 0
    for stop in stops.tolist():
        for b in np.unique(block[start:stop]).tolist():  # one, but for colliding keys
            rows = start + np.flatnonzero(block[start:stop] == b)
            part, budget = parts[b]
            y = x[rows][:, part]
            square = (y * y).sum(1)
            for at in range(0, len(rows) - 1, ROWS_AT_ONCE):
                end = min(at + ROWS_AT_ONCE, len(rows))
                distance = square[at:end, None] + square[None, at:] - 2 * (y[at:end] @ y[at:].T)
                i, j = np.nonzero(distance <= budget)
                later = j > i
                yield rows[at + i[later]], rows[at + j[later]]
        start = stop


def _verify(i, j, own, u, x, cell, dims, cosine):
    """Which pairs are links that this cell and block have to count."""
    ok = (own["_i"][i] == own["_j"][i]) | (own["_side"][i] != own["_side"][j])
    ok &= (own["label"][i] == own["label"][j]) & (own["block"][i] == own["block"][j]) & (own["cls"][i] != own["cls"][j])
    ok &= (cell[i] == cell[j]).all(1)
    at = np.flatnonzero(ok)
    if not len(at):
        return ok
    p, q, block = i[at], j[at], own["block"][i[at]]
    first = np.full(len(at), -1)
    parts = block_ranges(dims, cosine)
    diff = x[p] - x[q]
    diff *= diff
    good = np.ones(len(at), bool)
    for b, (part, budget) in enumerate(parts):
        inside = diff[:, part].sum(1) <= budget - SLACK / 2
        first[(first < 0) & inside] = b
        # the pair's cell: that of the larger of its two coordinates, which both reach
        here = block == b
        if here.any():
            width = CELL_WIDTH * np.sqrt(budget)
            lead = np.maximum(x[p[here]][:, part], x[q[here]][:, part])[:, :CELL_DIMS]
            good[here] = (np.floor(lead / width).astype(np.int64) == cell[p[here]]).all(1)
    good &= first == block
    at, p, q = at[good], p[good], q[good]
    ok[:] = False
    ok[at[(u[p] * u[q]).sum(1) >= cosine]] = True
    return ok


def embedding_components(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows``
    (``vec_id, embedding, label``)."""
    with scratch() as tables:
        base = rows.select("vec_id", F.col("label").cast("string").alias("label"),
                           F.col("embedding").cast("array<double>").alias("embedding")).withColumn("ok", usable())
        classes = cut_lineage(
            base.filter("ok").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
            .withColumn("cls", F.monotonically_increasing_id()))
        spread = classes.select("cls", F.xxhash64("label").alias("label"), "copies", "embedding").mapInArrow(
            _cell_rows(cosine), "cls long, copies long, block int, dims int, label long, cell array<long>, vector array<double>")
        keyed = cut_lineage(spread.withColumn("key", F.xxhash64("dims", "block", "label", "cell")))
        found = cut_lineage(cells(keyed, "key", "cls").mapInArrow(_linker(cosine), "a long, b long, n long"))
        component = connected_components(found.filter("b is not null").select("a", "b"))
        linked = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
        rooted = classes.join(component.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left").select(
            "label", "embedding", "low", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cls").alias("root"))
        lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        known = tables.keep(cut_lineage(rooted.join(lowest, "root").select("label", "embedding", "n_links", "component_id")))
        alone = base.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = base.filter("ok").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionAll(alone)
        return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
