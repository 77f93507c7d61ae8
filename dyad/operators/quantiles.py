"""Exact quantiles of a whole column by refinement.

A double's bits, with those of negative numbers turned over, are a 64-bit number
in the order of the values.  A scan counts the values by their leading
``STEP_BITS``; the bin that holds a wanted position becomes the prefix of the next
scan, which counts the next bits of its values only.  As soon as the bins that are
left hold few rows, these are fetched and sorted.  So a column is scanned a few
times, whatever its size, and is never sorted, shuffled or written in order.

The driver gets at most ``2 ** STEP_BITS`` counts per wanted bin and task-summed,
and at most ``FETCH_ROWS`` values.  NaN is the largest value and -0.0 equals 0.0,
as in Spark's own order; nulls are not counted."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.session import cut_lineage, scratch

STEP_BITS = 16
FETCH_ROWS = 100_000
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of doubles."""
    values = values + 0.0  # -0.0 becomes 0.0
    values[np.isnan(values)] = np.nan  # one NaN, the largest
    bits = values.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_ordered(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)


def reads_a_table(df: DataFrame) -> bool:
    """Is ``df`` a filtered projection of stored files, cheap to read again?"""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return node.children().size() == 0 and "Relation" in node.nodeName()


def _columns(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        if batch.num_rows:
            yield ordered_bits(batch.column(0).to_numpy(zero_copy_only=False).copy())


def _histogram(column: DataFrame, prefixes: list[int], known: int) -> dict[int, dict[int, int]]:
    """Per prefix of ``known`` bits, the number of values by their next bits."""
    heads = np.array(sorted(prefixes), np.uint64)
    rest = np.uint64(64 - known - STEP_BITS)

    def count(batches):
        total = np.zeros((len(heads), 1 << STEP_BITS), np.int64)
        for bits in _columns(batches):
            if known:
                head = bits >> np.uint64(64 - known)
                at = np.searchsorted(heads, head)
                inside = heads[np.minimum(at, len(heads) - 1)] == head
                at, bits = at[inside], bits[inside]
            else:
                at = np.zeros(len(bits), np.int64)
            key = (bits >> rest & np.uint64((1 << STEP_BITS) - 1)).astype(np.int64)
            total += np.bincount((at << STEP_BITS) + key, minlength=total.size).reshape(total.shape)
        at, key = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(key.astype(np.int32)), pa.array(total[at, key])],
                                         names=["at", "key", "n"])

    rows = column.mapInArrow(count, "at int, key int, n long").groupBy("at", "key").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {int(h): {} for h in heads}
    for at, key, n in rows:
        out[int(heads[at])][key] = n
    return out


def _fetch(column: DataFrame, prefixes: list[int], known: int) -> np.ndarray:
    """The sorted values that begin with one of the prefixes."""
    heads = np.array(sorted(prefixes), np.uint64)

    def pick(batches):
        for bits in _columns(batches):
            head = bits >> np.uint64(64 - known)
            yield pa.RecordBatch.from_arrays([pa.array(from_ordered(bits[np.isin(head, heads)]))], names=["v"])

    return np.sort(ordered_bits(column.mapInArrow(pick, "v double").toArrow().column(0).to_numpy().copy()))


def values_at(column: DataFrame, positions: Sequence[int], n: int | None = None) -> list[float]:
    """The values at 0-based ``positions`` of a one-column double frame without nulls, in order."""
    # each wanted position: its prefix so far and its place among the values of that prefix
    state = {p: (0, p) for p in set(positions)}
    known, found = 0, {}
    while state and known < 64:
        counts = _histogram(column, sorted({h for h, _ in state.values()}), known)
        known += STEP_BITS
        held = {}
        for p, (head, place) in state.items():
            for key in sorted(counts[head]):
                if place < counts[head][key]:
                    break
                place -= counts[head][key]
            state[p] = (head << STEP_BITS | key, place)
            held[state[p][0]] = counts[head][key]
        if known < 64 and sum(held.values()) <= FETCH_ROWS:
            bits = _fetch(column, list(held), known)
            head = bits >> np.uint64(64 - known)
            found = {p: bits[np.searchsorted(head, np.uint64(h)) + place] for p, (h, place) in state.items()}
            break
    else:
        found = {p: np.uint64(h) for p, (h, _) in state.items()}
    return [float(from_ordered(np.array([found[p]], np.uint64))[0]) for p in positions]


def refine_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles of ``value`` at ``probs``, each None for a column without values."""
    with scratch():
        column = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
        if not reads_a_table(column):
            column = cut_lineage(column)
        n = column.count()
        if not n:
            return [None] * len(probs)
        places = [float(p) * (n - 1) for p in probs]
        ends = [(math.floor(h), math.ceil(h)) for h in places]
        values = values_at(column, [i for pair in ends for i in pair])
        out = []
        for h, (lo, hi), a, b in zip(places, ends, values[::2], values[1::2]):
            # weights as in Spark's ``percentile``
            out.append(a if a == b or lo == hi else (hi - h) * a + (h - lo) * b)
        return out
