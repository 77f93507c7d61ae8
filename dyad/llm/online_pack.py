"""Bounded-space online best-fit packing.

Documents become pieces of at most ``length`` ids (only longer documents are
cut).  A task reads its pieces in order, sorted by falling length within windows
of ``WINDOW`` pieces, and keeps a fixed number of open bins; free space is the index into a bitset, so the tightest bin that fits is one bit
search.  A piece that fits nowhere opens a bin, and when all are in use the
fullest one closes first.

Streams are independent, so bins still open at a stream's end would be lost
space.  They are packed again: a stream's open bins are items of the next
round, where one task reads the open bins of ``FAN_IN`` streams, until one
stream is left.  A round's input is bounded by ``FAN_IN * open_bins`` rows per
task, and a piece's place is found by following its bin through the rounds.

Null texts are empty documents (one piece, the end id).  Repeated rows are
packed like any others; an empty table gives an empty table; other columns of
the input are not read."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm.common import slices
from dyad.llm.tokens import END_ID, SLICE_BYTES, default_tokenizer, encoder, with_end
from dyad.session import cut_lineage, scratch

LENGTH = 1024
OPEN_BINS = 4096
#: pieces of a stream that are read in order of falling length
WINDOW = 4096
FAN_IN = 64
#: a sequence number (below 2^53) is a level, a stream and a bin of the stream
LEVEL_BIT, STREAM_BIT = 48, 28

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length,
    ids_crc32`` and, if asked for, the ids.  All but the first piece of a cut
    document are full; the first has the rest."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in slices(sizes, SLICE_BYTES):
                yield cut(batch.column(0).slice(a, b - a), *with_end(*encoder(path).encode(texts.slice(a, b - a)), end_id))

    def cut(doc_ids, ids, lengths):
        count = -(-lengths // length)
        number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        head = np.repeat(lengths - (count - 1) * length, count)
        start = np.where(number == 0, 0, head + (number - 1) * length)
        size = np.where(number == 0, head, length)
        at = np.repeat(np.cumsum(lengths) - lengths, count) + start
        raw = memoryview(ids.astype("<u4").tobytes())
        blocks = [raw[4 * s : 4 * e] for s, e in zip(at.tolist(), (at + size).tolist())]
        arrays = [doc_ids.take(pa.array(np.repeat(np.arange(len(lengths)), count))), pa.array(number.astype(np.int32)),
                  pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in blocks], pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            offsets = np.append(at, len(ids)).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """A fixed number of open bins, found by free space."""

    def __init__(self, length: int, limit: int) -> None:
        self._length, self._limit, self._open, self._bits = length, limit, 0, 0
        self._by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """``(bin, offset)`` of the next piece."""
        fits = self._bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self._open == self._limit:  # the fullest has the least free space
                self._take((self._bits & -self._bits).bit_length() - 1)
            at, free = self.bins, self._length
            self.bins += 1
        left = free - size
        if left:
            self._by_free[left].append(at)
            self._bits |= 1 << left
            self._open += 1
        return at, self._length - free

    def _take(self, free: int) -> int:
        stack = self._by_free[free]
        at = stack.pop()
        if not stack:
            self._bits ^= 1 << free
        self._open -= 1
        return at

    def left_open(self) -> dict[int, int]:
        """Bins still open, with their used space."""
        return {b: self._length - free for free, stack in enumerate(self._by_free) for b in stack}


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """``items`` (any columns, and the long ``length``, 1 to ``length``) plus
    the longs ``sequence_id`` and ``offset``.  Every partition of ``items`` is
    a stream; a column of ``items`` named like a result is replaced."""
    items = items.drop("sequence_id", "offset")
    with scratch() as tables:
        streams = items.withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("long"), STREAM_BIT))
        places = f"{_fields(streams)}, offset long, left_open boolean"
        placed = cut_lineage(streams.mapInArrow(_stream_packer(length, open_bins), places))
        left = placed.filter("left_open").select(F.col("sequence_id").alias("bin"), F.col("length").alias("used"))
        moved = _merge(left, length, open_bins)
        tables.keep(placed)
        tables.keep(moved)
        moved = moved.select("bin", "to_bin", "shift")
        out = placed.filter("not left_open").join(moved, placed.sequence_id == moved.bin, "left")
        return out.select(*[F.col(f"`{c}`") for c in items.columns],
                          F.coalesce("to_bin", "sequence_id").alias("sequence_id"),
                          (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _stream_packer(length: int, open_bins: int):
    """A stream's rows with their bin and offset, then a row without an item
    for each bin still open (its ``length`` is the bin's used space)."""

    def run(batches):
        bins, stream, schema = OpenBins(length, open_bins), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            stream = batch.column(schema.get_field_index("sequence_id"))[0].as_py()
            sizes = batch.column(schema.get_field_index("length")).to_pylist()
            placed = np.empty((len(sizes), 2), np.int64)
            for at in range(0, len(sizes), WINDOW):
                for i in sorted(range(at, min(at + WINDOW, len(sizes))), key=lambda i: -sizes[i]):
                    placed[i] = bins.place(sizes[i])
            yield rows(batch, stream + placed[:, 0], placed[:, 1], False)
        if left := bins.left_open():
            used = pa.array(list(left.values()), pa.int64())
            none = [used if f.name == "length" else pa.nulls(len(left), f.type) for f in schema]
            yield rows(pa.RecordBatch.from_arrays(none, schema=schema), stream + np.fromiter(left, np.int64),
                       np.full(len(left), -1), True)

    def rows(batch, at, offset, left_open):
        at_column = batch.schema.get_field_index("sequence_id")
        columns = [pa.array(at) if i == at_column else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(offset), pa.array(np.full(len(at), left_open))],
                                          names=[*batch.schema.names, "offset", "left_open"])

    return run


def _merge(left: DataFrame, length: int, open_bins: int) -> DataFrame:
    """``bin, to_bin, shift``: where the bins left open by all streams end up."""

    def repack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["used", "bin"], ascending=[False, True])
        bins = OpenBins(length, open_bins)
        placed = np.array([bins.place(size) for size in rows.used.tolist()], np.int64)
        still = bins.left_open()
        to_bin = int(rows.next.iloc[0]) + placed[:, 0]
        return pd.DataFrame({"bin": rows.bin, "to_bin": to_bin, "shift": placed[:, 1],
                             "to_used": [still.get(b, 0) for b in placed[:, 0].tolist()]})

    moved, level = None, 0
    while True:
        level += 1
        # a bin's number: level, stream (from STREAM_BIT), bin of the stream
        stream = F.shiftright(F.col("bin").bitwiseAND(F.lit((1 << LEVEL_BIT) - 1)), STREAM_BIT)
        group = F.floor(stream / FAN_IN).cast("long")
        step = cut_lineage(left.withColumn("next", F.lit(level << LEVEL_BIT) + F.shiftleft(group, STREAM_BIT)).groupBy("next")
                           .applyInPandas(repack, "bin long, to_bin long, shift long, to_used long"))
        if moved is None:
            moved = step
        else:
            again = step.select(F.col("bin").alias("to_bin"), F.col("to_bin").alias("last"), F.col("shift").alias("more"))
            moved = cut_lineage(moved.join(again, "to_bin", "left").select(
                "bin", F.coalesce("last", "to_bin").alias("to_bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        if step.select(F.shiftright("to_bin", STREAM_BIT).alias("g")).distinct().limit(2).count() < 2:
            return moved
        left = step.filter("to_used > 0").groupBy(F.col("to_bin").alias("bin")).agg(F.max("to_used").alias("used"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS,
                   end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``."""
    return pack(cut_lineage(pieces(docs, tokenizer, length, end_id)), length, open_bins)
