"""Token ids as packed binary matrices: best-fit-decreasing over the whole corpus.

Best-fit-decreasing depends on lengths only, and there are at most ``length``
of them.  Spark counts the pieces of each length; the driver packs the counts
(never the pieces): bins of equal free space are kept as ranges of bin numbers,
and a segment tree over the free space finds the tightest that fits.  The plan
is a table of ranges: the n-th piece of a length goes to this bin at that
offset.  A piece learns its n from a running count in its task plus the counts
of earlier tasks, looks its place up, and one shuffle by bin brings the pieces
of a sequence together.

Documents longer than a sequence are cut without loss, into full pieces and a
first piece with the rest.  Null texts are empty documents (the end id alone);
repeated rows are packed like any others; no rows give no sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm.common import group_starts, ranges, slices, sorted_groups
from dyad.llm.tokens import END_ID, SLICE_BYTES, default_tokenizer, encoder, with_end
from dyad.session import cut_lineage, scratch

LENGTH = 1024
PAD_ID = 0
#: ids are stored in two bytes; a larger vocabulary needs "<u4"
ID_TYPE = "<u2"


class SegmentTree:
    """Which capacities 0 to ``size`` have open bins; finds the smallest at or above one."""

    def __init__(self, size: int) -> None:
        self._leaves = 1 << size.bit_length()
        self._any = [False] * (2 * self._leaves)

    def set(self, capacity: int, some: bool) -> None:
        at = capacity + self._leaves
        self._any[at] = some
        while at > 1:
            at //= 2
            self._any[at] = self._any[2 * at] or self._any[2 * at + 1]

    def at_least(self, capacity: int) -> int | None:
        at = capacity + self._leaves
        if self._any[at]:
            return capacity
        while at > 1:  # up to the first subtree on the right with a bin, then down its left edge
            if at % 2 == 0 and self._any[at + 1]:
                at += 1
                while at < self._leaves:
                    at = 2 * at if self._any[2 * at] else 2 * at + 1
                return at - self._leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], length: int = LENGTH) -> np.ndarray:
    """The plan for ``counts`` (pieces per length), rows ``size, first, per
    bin, bin, offset``: pieces ``first`` and on of a size fill bins from
    ``bin`` on, ``per bin`` each, starting at ``offset``."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # ranges of bins by free space
    tree, plan, bins = SegmentTree(length), [], 0

    def push(space: int, first: int, n: int) -> None:
        if n and space:
            free[space].append((first, n))
            tree.set(space, True)

    for size in sorted((s for s in counts if counts[s]), reverse=True):
        left, done = counts[size], 0
        while left:
            space = tree.at_least(size)
            if space is None:
                space, first, n = length, bins, -(-left // (length // size))
                bins += n
            else:
                first, n = free[space].pop()
                tree.set(space, bool(free[space]))
            per = space // size
            full = min(n, left // per)
            if full:
                plan.append((size, done, per, first, length - space))
                push(space - per * size, first, full)
                done, left = done + full * per, left - full * per
            if full < n and 0 < left < per:  # the last pieces of this size share one bin
                plan.append((size, done, left, first + full, length - space))
                push(space - left * size, first + full, 1)
                full, done, left = full + 1, done + left, 0
            push(space, first + full, n - full)
    return np.array(plan, np.int64).reshape(len(plan), 5)


def place(plan: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces with these sizes and numbers."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    p = plan[order]
    at = np.empty(len(size), np.int64)
    for s in np.unique(size).tolist():
        low, high = np.searchsorted(p[:, 0], [s, s + 1])
        pick = size == s
        at[pick] = low + np.searchsorted(p[low:high, 1], number[pick], "right") - 1
    r = p[at]
    nth = number - r[:, 1]
    return r[:, 3] + nth // r[:, 2], r[:, 4] + nth % r[:, 2] * size


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, size, ids`` and ``stream, nth``: the piece is the nth of its size in its task."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        seen, stream = np.zeros(length + 1, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            stream, texts = batch.column(2)[0].as_py(), batch.column(1)
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), SLICE_BYTES):
                ids, lengths = with_end(*encoder(path).encode(texts.slice(a, b - a)), end_id)
                if len(ids) and int(ids.max()) > np.iinfo(ID_TYPE).max:
                    raise ValueError("an id does not fit ID_TYPE")
                count = -(-lengths // length)
                number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                size = np.where(number == 0, np.repeat(lengths - (count - 1) * length, count), length)
                order = np.argsort(size, kind="stable")
                start = group_starts(size[order])
                nth = np.empty(len(size), np.int64)
                nth[order] = ranges(np.zeros(len(start), np.int64), np.diff(np.append(start, len(size))))
                nth += seen[size]
                seen += np.bincount(size, minlength=length + 1)
                raw = pa.py_buffer(ids.astype(ID_TYPE).tobytes())
                ends = np.append(0, np.cumsum(size)) * np.dtype(ID_TYPE).itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(len(lengths)), count))),
                     pa.array(number.astype(np.int32)), pa.array(size),
                     pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), raw]),
                     pa.array(np.full(len(size), stream)), pa.array(nth)],
                    names=["doc_id", "piece", "size", "ids", "stream", "nth"])

    return docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("stream")).mapInArrow(
        run, "doc_id long, piece int, size long, ids binary, stream long, nth long")


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
                     pad_id: int = PAD_ID) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``n_tokens``, ``doc_ids`` and
    ``pieces`` of its segments, ``cu_seqlens`` (0 and the end of each segment),
    ``ids`` (``length`` ids, padded) and ``position_ids`` (from 0 in each
    segment, 0 in the padding), both as ``ID_TYPE`` binary."""
    with scratch() as tables:
        made = tables.keep(cut_lineage(token_pieces(docs, tokenizer, length, end_id)))
        counts = cut_lineage(made.groupBy("stream", "size").agg(F.count(F.lit(1)).alias("n")))
        by_size = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most length rows
        plan = docs.sparkSession.sparkContext.broadcast(best_fit_decreasing(by_size, length))
        earlier = Window.partitionBy("size").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
        starts = tables.keep(cut_lineage(counts.select("stream", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))))

    def lookup(batches):
        for batch in batches:
            size, number = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            at, offset = place(plan.value, size, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at), pa.array(offset)],
                                             names=["doc_id", "piece", "size", "ids", "sequence_id", "offset"])

    def assemble(batches):
        for t in sorted_groups(batches, ("sequence_id",)):
            t = t.combine_chunks()
            seq, size = t.column("sequence_id").to_numpy(), t.column("size").to_numpy()
            start = group_starts(seq)
            stop = np.append(start[1:], len(seq))
            used = np.add.reduceat(size, start)
            flat = np.frombuffer(b"".join(t.column("ids").to_pylist()), ID_TYPE)
            ends = np.cumsum(size) - np.repeat(np.cumsum(used) - used, stop - start)
            matrix = np.full((len(start), length), pad_id, ID_TYPE)
            positions = np.zeros((len(start), length), ID_TYPE)
            places = ranges(np.arange(len(start)) * length, used)
            matrix.ravel()[places] = flat
            positions.ravel()[places] = ranges(np.zeros(len(size), np.int64), size)
            bounds = np.insert(ends, start, 0)
            offsets = pa.array(np.append(start, len(seq)).astype(np.int32))
            lists = lambda values, at: pa.ListArray.from_arrays(at, values)
            rows = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seq[start]), pa.array(used.astype(np.int32)), lists(t.column("doc_id").combine_chunks(), offsets),
                 lists(t.column("piece").combine_chunks(), offsets),
                 lists(pa.array(bounds.astype(np.int32)), pa.array((np.append(start, len(seq)) + np.arange(len(start) + 1)).astype(np.int32))),
                 rows(matrix), rows(positions)],
                names=["sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "position_ids"])

    keyed = made.join(starts, ["stream", "size"]).select("doc_id", "piece", "size", "ids", (F.col("start") + F.col("nth")).alias("number"))
    placed = keyed.mapInArrow(lookup, "doc_id long, piece int, size long, ids binary, sequence_id long, offset long")
    dealt = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return dealt.mapInArrow(assemble, "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
                                      "ids binary, position_ids binary")


def write_sequences(sequences: DataFrame, path: str) -> None:
    """The sequences as Parquet: a file's ``ids`` column is its id matrix, row by row."""
    sequences.write.mode("error").parquet(path)


def digests(sequences: DataFrame) -> DataFrame:
    """Sequences with the crc32 of their matrix rows instead of the rows."""
    return sequences.select("sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens",
                            F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32"))
