"""Periodic runs of words by recompression.

A run is a stretch of a text's words with smallest period ``q`` and a length
of ``max(MIN_LENGTH, MIN_EXPONENT * q)`` or more that no neighbouring word
extends keeping period ``q``.

The words of a slice of texts become one run-length grammar: block compression
(every maximal block of a symbol gets one name) and pair compression (the
symbols fall into a left and a right half by a hash; every left-right
neighbourhood gets one name) alternate until a text is one symbol.  A name
stands for the same words wherever it occurs, and whether two neighbours merge
depends on them alone, so two equal stretches are cut alike but for their ends:
:meth:`Grammar.common` finds how far two places agree, forwards or backwards,
by climbing while parents are equal, skipping equal symbols (equal parts of
blocks at once) and descending where symbols differ.  No suffix array is built.

Candidates lie on a harmonic grid: a run of period ``q`` and length ``3 q`` or
more holds three neighbouring multiples of ``q``, so for every ``q`` only the
places 0, q, 2q, ... are tried, n ln n in all.  Places that a few word
comparisons rule out are left; for the others the two extensions give the whole
run.  The same stretch found with several periods is one run with the smallest.

A null text has no words.  A null ``doc_id`` is kept.  Repeated rows each have
their own result.  Columns other than ``doc_id`` and ``text`` are not read, so
their names can't clash.  An empty table gives an empty table.  Equal words are
equal bytes.  A text is handled in one task, with memory in proportion to its
words; candidates are made and tested in portions."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm.common import ranges, text_slices, words

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: rounds of block and pair compression; a text that needs more keeps several top symbols
MAX_ROUNDS = 96
CANDIDATES_AT_ONCE = 1 << 20
RUN_TYPE = "array<struct<start: long, length: long, period: long>>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Grammar:
    """Run-length grammar of a symbol sequence, all levels in flat arrays.

    ``fixed`` marks separators: symbols that occur once and are never merged.
    The first and the last symbol must be separators."""

    def __init__(self, symbols: np.ndarray, fixed: np.ndarray):
        name, level = int(symbols.max()) + 1, 0
        sym, size = symbols.astype(np.int64), np.ones(len(symbols), np.int64)
        texts = int(fixed.sum()) - 1
        syms, sizes, parents, children, last_children = [], [], [], [np.full(len(sym), -1)], [np.full(len(sym), -1)]
        heads, tails, ahead, behind = [], [], [], []
        base = 0
        rng = np.random.default_rng(0)
        for turn in range(2 * MAX_ROUNDS):
            if len(sym) - texts - 1 <= texts:  # one symbol a text
                break
            n = len(sym)
            head = np.ones(n, bool)
            if turn % 2 == 0:
                head[1:] = sym[1:] != sym[:-1]
            else:
                odd = int(rng.integers(1 << 62)) | 1
                right = (sym.view(np.uint64) * np.uint64(odd) >> np.uint64(61)) & np.uint64(1) == 1
                head[1:] = ~(~right[:-1] & right[1:] & ~fixed[:-1] & ~fixed[1:])
            if head.all():
                continue
            starts = np.flatnonzero(head)
            count = np.diff(np.append(starts, n))
            new, merged = sym[starts], np.flatnonzero(count > 1)
            second = count[merged] if turn % 2 == 0 else sym[starts[merged] + 1]
            _, which = np.unique(new[merged] * np.int64(max(name, n) + 1) + second, return_inverse=True)
            new[merged] = name + which
            name += int(which.max()) + 1
            parent = np.cumsum(head) - 1
            syms.append(sym)
            sizes.append(size)
            heads.append(head)
            tails.append(np.append(head[1:], True))
            parents.append(parent + base + n)
            if turn % 2 == 0:
                at = np.arange(n)
                ahead.append((starts + count)[parent] - at)
                behind.append(at - starts[parent] + 1)
            else:
                ahead.append(np.ones(n, np.int64))
                behind.append(ahead[-1])
            children.append(starts + base)
            last_children.append(starts + count - 1 + base)
            sym, size, fixed, base = new, np.add.reduceat(size, starts), fixed[starts], base + n
            level += 1
        n = len(sym)
        top, none = np.ones(n, np.int64), np.zeros(n, bool)
        self.symbol = np.concatenate([*syms, sym])
        self.size = np.concatenate([*sizes, size])
        self.parent = np.concatenate([*parents, np.full(n, -1)])
        #: per direction: first child met, is the symbol the first of its parent, equal symbols of its block from it on
        self.child = (np.concatenate(children), np.concatenate(last_children))
        self.edge = (np.concatenate([*heads, none]), np.concatenate([*tails, none]))
        self.block = (np.concatenate([*ahead, top]), np.concatenate([*behind, top]))
        self.levels = level + 1

    def common(self, a: np.ndarray, b: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many symbols agree from places ``a`` and ``b`` (different ones) on, or from them backwards."""
        child, edge, block = self.child[backwards], self.edge[backwards], self.block[backwards]
        step = -1 if backwards else 1
        out = np.zeros(len(a), np.int64)
        who = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(who):
            same = self.symbol[a] == self.symbol[b]
            up_a, up_b = self.parent[a], self.parent[b]
            climb = same & edge[a] & edge[b] & (self.symbol[up_a] == self.symbol[up_b])
            skip = np.minimum(block[a], block[b])
            eat = same & ~climb
            out[who[eat]] += (skip * self.size[a])[eat]
            down_a, down_b = child[a], child[b]
            next_a = np.where(climb, up_a, np.where(eat, a + step * skip, down_a))
            next_b = np.where(climb, up_b, np.where(eat, b + step * skip, down_b))
            going = same | (down_a >= 0)
            a, b, who = next_a[going], next_b[going], who[going]
        return out


def _candidates(symbols: np.ndarray, first: np.ndarray, n: np.ndarray):
    """Portions ``(place, period)`` of the grid points that may lie in a run's
    first period, for texts of ``n`` words from ``first`` on."""
    text = np.flatnonzero(n >= MIN_LENGTH)
    if not len(text):
        return
    periods = n[text] // MIN_EXPONENT
    q = ranges(np.ones(len(text), np.int64), periods)
    start, size = np.repeat(first[text], periods), np.repeat(n[text], periods)
    points = (size - 1) // q - 1
    done = np.concatenate([[0], np.cumsum(points)])
    i = 0
    while i < len(q):
        j = max(i + 1, int(np.searchsorted(done, done[i] + CANDIDATES_AT_ONCE, "right")) - 1)
        of = np.repeat(np.arange(i, j), points[i:j])
        place = start[of] + ranges(np.zeros(j - i, np.int64), points[i:j]) * q[of]
        period = q[of]
        for num, den in ((0, 1), (1, 1), (1, 2), (1, 4)):
            there = place + period * num // den
            keep = symbols[there] == symbols[there + period]
            place, period = place[keep], period[keep]
        if len(place):
            yield place, period
        i = j


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Every run of each word-number sequence: rows ``start, length, period``
    sorted by start, then period.  Equal numbers are equal words in all texts."""
    n = np.array([len(t) for t in texts], np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not n.sum():
        return out
    names = max(int(t.max()) for t in texts if len(t)) + 1
    fixed = np.zeros(int(n.sum()) + len(n) + 1, bool)
    first = np.concatenate([[0], np.cumsum(n + 1)])[:-1] + 1
    fixed[first - 1] = fixed[-1] = True
    symbols = np.empty(len(fixed), np.int64)
    symbols[fixed] = names + np.arange(len(n) + 1)
    symbols[~fixed] = np.concatenate(texts)
    portions = list(_candidates(symbols, first, n))
    if not portions:
        return out
    # texts without a candidate need no grammar
    place, period = (np.concatenate(c) for c in zip(*portions))
    held = np.unique(np.searchsorted(first, place, "right") - 1)
    shift = np.zeros(len(n), np.int64)
    packed = np.concatenate([[0], np.cumsum(n[held] + 1)])
    shift[held] = packed[:-1] + 1 - first[held]
    pick = ranges(first[held] - 1, n[held] + 1)
    pick = np.append(pick, len(symbols) - 1)
    grammar = Grammar(symbols[pick], fixed[pick])
    place = place + shift[np.searchsorted(first, place, "right") - 1]
    found = []
    for i in range(0, len(place), CANDIDATES_AT_ONCE):
        p, q = place[i : i + CANDIDATES_AT_ONCE], period[i : i + CANDIDATES_AT_ONCE]
        behind = grammar.common(p - 1, p + q - 1, backwards=True)
        length = behind + q + grammar.common(p, p + q)
        long = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
        rows = np.column_stack([(p - behind)[long], length[long], q[long]])
        found.append(_smallest(rows))
    rows = _smallest(np.concatenate(found))
    text = held[np.searchsorted(packed, rows[:, 0], "right") - 1]
    rows[:, 0] -= first[text] + shift[text]
    cuts = np.searchsorted(text, np.arange(len(n) + 1))
    for t in np.unique(text).tolist():
        out[t] = rows[cuts[t] : cuts[t + 1]]
    return out


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row per stretch, that of the smallest period, by start and period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def planted(doc_id: int | None, text: list[bytes]) -> list[bytes]:
    """The words of a document after the query's rule: one document in ten,
    by the CRC of its id, becomes periodic from some word on.  A null id changes nothing."""
    n = len(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return text[:a] + (text[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``: all runs by
    start, then period, and the text without the words that any run holds after
    its first period, joined by one space.  ``prepare(doc_id, words)`` may
    rewrite the words first."""

    def one_slice(ids: list, texts: list) -> tuple[list, list, list]:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        split = [words(t) for t in texts]
        if prepare is not None:
            split = [prepare(i, w) for i, w in zip(ids, split)]
        found = runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split])
        short = []
        for w, r in zip(split, found):
            if len(r):
                w = [x for x, keep in zip(w, kept_words(len(w), r).tolist()) if keep]
            short.append(b" ".join(w).decode())
        return [len(w) for w in split], found, short

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_slices(batch.column(1)):
                part = ids.slice(at, len(texts))
                n, found, short = one_slice(part.to_pylist(), texts)
                rows = np.concatenate(found)
                stops = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(_ARROW_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(stops), entries), pa.array(short, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, f"doc_id long, n_words long, runs {RUN_TYPE}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` rows as counts, the run of greatest exact exponent (ties:
    smallest start, then period) and digests."""
    steeper = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    entry = F.lit(None).cast("struct<start: long, length: long, period: long>")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.withColumn("best", F.aggregate("runs", entry, steeper))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
