"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product.  Vectors get one more coordinate that brings all
of them to the same norm, so the largest inner product is the smallest distance.

1. Equal vectors become one class with its ``k + 1`` smallest ids: no search can
   return more of them.
2. A tree cuts at the median of one random direction per level; a tree's
   directions are orthonormal.  Medians come from a hash sample of at most about
   ``FIT_ROWS`` classes, and every class is put into its leaf of every tree.
3. A query walks all trees through one priority queue.  The priority of a branch
   is the sum of the squared margins by which the query lies on the other side,
   a lower bound of its squared distance to the branch.  Leaves are taken until
   they hold ``SEARCH_SHARE`` times the number of classes (a class counts in
   every tree), so recall does not fall as the table grows.
4. Classes and the queries that visit their leaves meet in cells (tree, block of
   neighbouring leaves, row chunk, query chunk) of bounded size.  A cell
   multiplies each leaf's vectors with its queries and keeps the ``k + 1`` best
   of each query, scored again exactly: products added in order of the
   components, in double precision.
5. The best of a query's cells are merged, its own row is left out, ``k`` stay.

The driver gets the fitting sample and one number per leaf.

Rows take no part if the id or the vector is null, the vector is empty, zero or
of another length than most (ties: the shorter), or a component is null or not
finite.  Rows equal in id and vector count once.  Rows that share an id but not
the vector are candidates of their own, and each is a query of its own under that
id.  Only these columns are read, so the names of others can't clash.  With
``k`` candidates or fewer all of them are found.  Empty tables give empty results."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm.common import group_starts
from dyad.session import cut_lineage, scratch

TOP = 20
TREES = 4
#: a leaf's rows, unless the sample can't fit that many levels
LEAF_ROWS = 8
MAX_LEVELS = 10
#: classes sampled to fit the medians; measured recall on 64 dimensions without structure is in the README
FIT_ROWS = 65_536
SEARCH_SHARE = 1.25
#: a cell's rows and queries
CELL_ROWS = 16_384
CELL_QUERIES = 8_192
PAIRS_AT_ONCE = 1 << 20
_FOUND = "query long, cls long, low long, score double"


def _measured(batches):
    """Rows that can take part, with the length and the norm of their vector."""
    for batch in batches:
        lists = batch.column(1)
        size = np.asarray(pc.list_value_length(lists))
        owner = np.repeat(np.arange(len(size)), size)
        x = lists.flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
        good = size > 0
        good[owner[~np.isfinite(x)]] = False
        some = np.flatnonzero(good)
        inside = good[owner]
        peak, norm = np.zeros(len(size)), np.zeros(len(size))
        np.maximum.at(peak, owner[inside], np.abs(x[inside]))
        scaled = x[inside] / np.where(peak[owner[inside]] > 0, peak[owner[inside]], 1)
        norm = np.sqrt(np.bincount(owner[inside], scaled * scaled, len(size))) * peak
        pick = pa.array(some[peak[some] > 0])
        yield pa.RecordBatch.from_arrays(
            [c.take(pick) for c in batch.columns] + [pa.array(size.astype(np.int32)).take(pick), pa.array(norm).take(pick)],
            names=["vec_id", "embedding", "asks", "dims", "norm"])


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Forest:
    """Directions and medians of all trees; leaves are numbered 0 to ``2 ** levels - 1``."""

    def __init__(self, sample: np.ndarray, norm: float, levels: int, trees: int = TREES, seed: int = 0):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1] + 1
        self.norm, self.levels, self.trees = norm, levels, trees
        self.directions, self.medians = [], []
        rows = self.lift(sample)
        for _ in range(trees):
            parts = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-levels // dims))]
            direction = np.concatenate(parts, axis=1)[:, :levels] if parts else np.zeros((dims, 0))
            medians = np.zeros(1 << levels)
            along, node = rows @ direction, np.ones(len(rows), np.int64)
            for level in range(levels):
                order = np.lexsort((along[:, level], node))
                cuts = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
                middle = np.minimum((cuts[:-1] + cuts[1:]) // 2, len(rows) - 1)
                medians[1 << level : 2 << level] = along[order[middle], level]
                node = 2 * node + (along[:, level] >= medians[node])
            self.directions.append(direction)
            self.medians.append(medians)

    def lift(self, rows: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere of one more dimension."""
        rows = rows / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (rows * rows).sum(1)))
        return np.column_stack([rows, rest])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Each row's leaf in every tree."""
        lifted = self.lift(rows)
        out = np.empty((len(rows), self.trees), np.int32)
        for t in range(self.trees):
            along, node = lifted @ self.directions[t], np.ones(len(rows), np.int64)
            for level in range(self.levels):
                node = 2 * node + (along[:, level] >= self.medians[t][node])
            out[:, t] = node - (1 << self.levels)
        return out

    def visits(self, queries: np.ndarray, sizes: np.ndarray, budget: float) -> list[list[tuple[int, int]]]:
        """``(tree, leaf)`` visited for each query, nearest first, until the leaves hold ``budget`` rows."""
        scale = np.abs(queries).max(1, keepdims=True)
        unit = queries / scale
        unit = np.column_stack([unit / np.sqrt((unit * unit).sum(1, keepdims=True)), np.zeros(len(unit))])
        along = np.stack([unit @ d for d in self.directions], axis=1).tolist()
        medians, held, levels, first = [m.tolist() for m in self.medians], sizes.tolist(), self.levels, 1 << self.levels
        out = []
        for query in along:
            queue = [(0.0, t, 1, 0) for t in range(self.trees)]
            seen, rows = [], 0
            while queue and rows < budget:
                far, t, node, level = heapq.heappop(queue)
                place, cut = query[t], medians[t]
                while level < levels:
                    margin = place[level] - cut[node]
                    level += 1
                    right = margin >= 0
                    heapq.heappush(queue, (far + margin * margin, t, 2 * node + (not right), level))
                    node = 2 * node + right
                seen.append((t, node - first))
                rows += held[t][node - first]
            out.append(seen)
        return out


def _route(forest: Forest, dims: int):
    def run(batches):
        for batch in batches:
            leaf = forest.leaves(matrix(batch.column(2), dims))
            stops = pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * forest.trees)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(stops, pa.array(leaf.ravel()))],
                                             names=["cls", "ids", "embedding", "leaves"])

    return run


def _walk(forest: Forest, dims: int, sizes: np.ndarray, budget: float, shift: int):
    """Query classes -> one row per block that they visit, with its leaves."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, tree, leaf = [], [], []
                for i, seen in enumerate(forest.visits(matrix(part.column(1), dims), sizes, budget)):
                    row.extend([i] * len(seen))
                    tree.extend(t for t, _ in seen)
                    leaf.extend(x for _, x in seen)
                row, tree, leaf = np.array(row, np.int64), np.array(tree, np.int32), np.array(leaf, np.int32)
                order = np.lexsort((leaf, tree, row))
                row, tree, leaf = row[order], tree[order], leaf[order]
                starts = group_starts(row, tree, leaf >> shift)
                stops = pa.array(np.append(starts, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row[starts])), part.column(1).take(pa.array(row[starts])),
                     pa.array(tree[starts]), pa.array(leaf[starts] >> shift), pa.ListArray.from_arrays(stops, pa.array(leaf))],
                    names=["query", "vector", "tree", "block", "leaves"])

    return run


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``a[i]`` and ``b[j]``, added in order of the components."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += a[i, d] * b[j, d]
    return out


def _best(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` highest scores, by query, falling score and rising tie."""
    order = np.lexsort((tie, -score, query))
    starts = group_starts(query[order])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _cell(dims: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cell's rows and queries -> each query's ``k`` best classes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = matrix(left.column("embedding").combine_chunks(), dims) if left.num_rows else np.zeros((0, dims))
        vectors = matrix(right.column("vector").combine_chunks(), dims) if right.num_rows else np.zeros((0, dims))
        low, leaf = left.column("low").to_numpy(), left.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        rows, low, leaf, cls = rows[order], low[order], leaf[order], left.column("cls").to_numpy()[order]
        lists = right.column("leaves").combine_chunks()
        visited = lists.flatten().to_numpy()
        visitor = np.repeat(np.arange(len(vectors)), np.diff(lists.offsets.to_numpy()))
        by_leaf = np.argsort(visited, kind="stable")
        visited, visitor = visited[by_leaf], visitor[by_leaf]
        #: a matrix product may differ from the exact sum by this
        size = np.sqrt((vectors * vectors).sum(1)) * (np.sqrt((rows * rows).sum(1)).max() if len(rows) else 0)
        slack = 8 * dims * np.finfo(float).eps * size
        bar = np.full(len(vectors), -np.inf)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        waiting, count = [], 0
        enough = min(PAIRS_AT_ONCE, max(1 << 16, 2 * k * len(vectors)))

        def settle():
            nonlocal waiting, count, held
            q, r, s = (np.concatenate(c) for c in zip(held, *waiting))
            kept = _best(q, s, low[r], k)
            starts = group_starts(q[kept])
            last = np.append(starts[1:], len(kept)) - 1
            full = last - starts == k - 1
            bar[q[kept[last[full]]]] = s[kept[last[full]]] - 2 * slack[q[kept[last[full]]]]
            near = s >= bar[q]
            held, waiting, count = [q[near], r[near], s[near]], [], 0

        for x in np.unique(visited).tolist():
            a, b = np.searchsorted(leaf, x), np.searchsorted(leaf, x, "right")
            who = visitor[np.searchsorted(visited, x) : np.searchsorted(visited, x, "right")]
            step = max(1, PAIRS_AT_ONCE // max(1, len(who)))
            for lo in range(a, b, step):
                hi = min(lo + step, b)
                score = vectors[who] @ rows[lo:hi].T
                i, j = np.nonzero(score >= bar[who][:, None])
                waiting.append((who[i], lo + j, score[i, j]))
                count += len(i)
                if count >= enough:
                    settle()
        if waiting:
            settle()
        q, r, _ = held
        score = exact(vectors, rows, q, r)
        kept = _best(q, score, low[r], k) if len(q) else q
        names = right.column("query").to_numpy()
        return pa.table({"query": names[q[kept]], "cls": cls[r[kept]], "low": low[r[kept]], "score": score[kept]})

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``rows`` (``vec_id, embedding``) with
    ``is_query``, the ``k`` rows of largest inner product found, ties to the smaller id."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    with scratch() as tables:
        base = cut_lineage(
            rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
            .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .mapInArrow(_measured, "vec_id long, embedding array<double>, asks boolean, dims int, norm double"))
        shape = (base.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"))
                 .orderBy(F.desc("n"), "dims").first())
        if shape is None:
            return empty
        dims, norm = shape.dims, shape.norm
        key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")]
        base = base.filter(F.col("dims") == dims).select("vec_id", "embedding", "asks", *key)
        few = Window.partitionBy("h1", "h2").orderBy("vec_id")
        classes = cut_lineage(
            base.withColumn("at", F.dense_rank().over(few)).filter(F.col("at") <= k + 1).groupBy("h1", "h2")
            .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
            .withColumn("cls", F.monotonically_increasing_id()))
        n = classes.count()
        levels = max(0, min(MAX_LEVELS, int(np.ceil(np.log2(n / LEAF_ROWS)))))
        share = min(1.0, FIT_ROWS / n)
        sample = classes.filter(F.pmod(F.col("h2"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("embedding").toArrow()
        forest = Forest(matrix(sample.column(0).combine_chunks(), dims), norm, levels)
        index = cut_lineage(classes.select("cls", "ids", "embedding").mapInArrow(
            _route(forest, dims), "cls long, ids array<long>, embedding array<double>, leaves array<int>"))
        sizes = np.zeros((TREES, 1 << levels), np.int64)
        for t, leaf, count in index.select(F.posexplode("leaves")).groupBy("pos", "col").count().collect():
            sizes[t, leaf] = count
        shift = max(0, levels - max(0, int(np.ceil(np.log2(n / CELL_ROWS)))))

        asking = base.filter("asks").select("vec_id", "h1", "h2").distinct().join(classes.select("cls", "h1", "h2"), ["h1", "h2"])
        asking = cut_lineage(asking.select("vec_id", "cls"))
        budget = max(SEARCH_SHARE * n, k + 1)
        visits = cut_lineage(
            index.join(asking, "cls", "left_semi").select("cls", "embedding")
            .mapInArrow(_walk(forest, dims, sizes, budget, shift), "query long, vector array<double>, tree int, block int, leaves array<int>"))
        cells = []  # at most one row per leaf
        held = sizes.reshape(TREES, -1, 1 << shift).sum(2)
        for t, block, count in visits.groupBy("tree", "block").count().collect():
            cells.append((t, block, max(1, -(-int(held[t, block]) // CELL_ROWS)), -(-count // CELL_QUERIES)))
        if not cells:
            return empty
        grid = F.broadcast(spark.createDataFrame(cells, "tree int, block int, n_r int, n_s int"))
        others = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        chunk = lambda c, c_n: F.pmod(F.xxhash64(c), F.col(c_n)).cast("int")
        left = (index.select("cls", F.element_at("ids", 1).alias("low"), "embedding", F.posexplode("leaves").alias("tree", "leaf"))
                .withColumn("block", F.shiftright("leaf", shift)).join(grid, ["tree", "block"])
                .withColumn("r", chunk("cls", "n_r")).withColumn("s", others("n_s")).drop("n_r", "n_s"))
        right = (visits.join(grid, ["tree", "block"])
                 .withColumn("s", chunk("query", "n_s")).withColumn("r", others("n_r")).drop("n_r", "n_s"))
        cell = ["tree", "block", "r", "s"]
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(dims, k + 1), _FOUND)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
        # a class found in several trees has the same score and smallest id each time
        merged = (found.withColumn("at", F.dense_rank().over(best)).filter(F.col("at") <= k + 1)
                  .select("query", "cls", "score").distinct())
        own = (F.col("cls") == F.col("query")).alias("own")
        entry = F.struct((-F.col("score")).alias("far"), F.col("id"), F.col("score"), own)
        lists = cut_lineage(
            merged.join(index.select("cls", "ids"), "cls").withColumn("id", F.explode("ids")).groupBy("query")
            .agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("near")))
        asking, lists = tables.keep(asking), tables.keep(lists)
    others = F.slice(F.filter("near", lambda e: ~(e["own"] & (e["id"] == F.col("vec_id")))), 1, k)
    listed = asking.join(lists, asking["cls"] == lists["query"]).select("vec_id", F.posexplode(others).alias("at", "e"))
    return listed.select(F.col("vec_id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))
