"""Ranked lexical search by presence masks.

Every item of a query table is searched in all documents.  Terms are maximal
runs of letters, digits and non-ASCII characters, A-Z lower-cased; a document's
score for an item is the sum, over the item's terms with repeats, of
``w * ((1000000000 * tf) div (1000 * tf + 12 * m))`` (see :func:`weight` and
:func:`lengths`), all in integers.

1. Documents become ``(doc_id, n, terms, tf)``: the query block's terms that they
   hold, written once; document frequencies and lengths are summed from that.
2. A task takes its documents in chunks.  A chunk's presence bitmaps, one per
   term, are turned into one matched-term mask per document and item (a bit
   transposition); equal masks are one group.  A mask's highest possible score
   is the sum of its terms' highest contributions in the chunk.  Groups are
   scored by falling maximum, until the next maximum is below the score of the
   task's ``k``-th best document: no document left can enter.
3. The best of all tasks (at most ``k`` rows per item and task) are ranked.

Items are taken in blocks of bounded size, in the order of ``item_id``; a block's
terms and weights are what tasks get, so nothing sent to them grows with the
documents, and one block's terms at a time pass through the driver.

A null or termless text has no terms (documents: not counted, never found;
items: no rows).  Documents that repeat an id, or whole rows, are documents of
their own; a null ``doc_id`` can be found and comes last among equal scores.
Items that repeat an ``item_id`` are ranked each on their own, under that id.
Very long texts are counted in pieces.  Columns other than the id and the text
are not read.  Empty tables give an empty result."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyad.llm.common import group_starts, ranges, text_slices
from dyad.session import cut_lineage, scratch

TOP = 20
#: documents of a chunk, and bounds of a block of items
CHUNK_DOCS = 4096
BLOCK_ITEMS = 1024
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
#: documents scored at a time, at least
SCORE_AT_ONCE = 64
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_DOC_FIELDS = "doc_id long, n long, terms array<int>, tf array<long>"


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term of a text, from pieces cut between terms."""
    counts: Counter = Counter()
    if text is None:
        return counts
    raw = text.encode().translate(_KEEP)
    if len(raw) <= PIECE_BYTES:
        counts.update(raw.split())
        return counts
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + PIECE_BYTES)
        stop = len(raw) if stop < 0 else stop
        counts.update(raw[at:stop].split())
        at = stop
    return counts


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Each document's length factor ``m``."""
    if len(n) and int(n.max()) * 25 * documents >= 1 << 63:
        return np.array([75 + 25 * x * documents // total for x in n.tolist()], np.int64)
    return 75 + 25 * n * documents // max(total, 1)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with terms, by item_id, in blocks (an item larger than a block is one of its own)."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        terms = term_counts(row.text)
        if not terms:
            continue
        held = sum(map(len, terms))
        if block and (len(block) == BLOCK_ITEMS or size + held > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row.item_id, terms))
        size += held
    if block:
        yield block


def _index(vocabulary: dict[bytes, int]):
    """Documents -> ``_DOC_FIELDS`` for the terms of ``vocabulary``; those without any term are left out."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_slices(batch.column(1)):
                rows, n, stops, terms, tf = [], [], [0], [], []
                for i, text in enumerate(texts):
                    counts = term_counts(text)
                    if not counts:
                        continue
                    found = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                    rows.append(at + i)
                    n.append(counts.total())
                    terms.extend(t for t, _ in found)
                    tf.extend(c for _, c in found)
                    stops.append(len(terms))
                ends = pa.array(stops, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                    names=["doc_id", "n", "terms", "tf"])

    return run


class Chunk:
    """Some documents: postings by document, presence bitmaps and highest contributions by term."""

    def __init__(self, n, stops, terms, part, width: int):
        self.docs, self.stops, self.terms, self.part = len(n), stops, terms, part
        doc = np.repeat(np.arange(self.docs), np.diff(stops))
        row = -(-self.docs // 8)
        self.bits = np.zeros(width * row, np.uint8)
        np.add.at(self.bits, terms.astype(np.int64) * row + (doc >> 3), np.left_shift(1, 7 - (doc & 7)).astype(np.uint8))
        self.bits = self.bits.reshape(width, row)
        self.highest = np.zeros(width, np.int64)
        np.maximum.at(self.highest, terms, part)

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with any of ``terms``, grouped by mask: ``(documents, group starts, masks as bit columns)``."""
        rows = self.bits[terms]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), count=self.docs))
        if not len(docs):
            return docs, docs, np.zeros((len(terms), 0), np.uint8)
        byte, shift = docs >> 3, (7 - (docs & 7)).astype(np.uint8)
        present = rows[:, byte] >> shift & 1  # term x document
        mask = np.ascontiguousarray(np.packbits(present, axis=0).T)
        pad = -mask.shape[1] % 8
        mask = np.ascontiguousarray(np.pad(mask, ((0, 0), (0, pad)))).view(np.uint64)
        order = np.lexsort(mask.T)
        starts = group_starts(*mask[order].T)
        return docs[order], starts, present[:, order[starts]]

    def scores(self, docs: np.ndarray, worth: np.ndarray) -> np.ndarray:
        size = self.stops[docs + 1] - self.stops[docs]
        at = ranges(self.stops[docs], size)
        total = np.concatenate([[0], np.cumsum(worth[self.terms[at]] * self.part[at])])
        ends = np.cumsum(size)
        return total[ends] - total[ends - size]


class Best:
    """The ``k`` best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bar(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, ids, null) -> None:
        keep = score >= self.bar
        score = np.concatenate([self.score, score[keep]])
        ids, null = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.null, null[keep]])
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def search_chunk(chunk: Chunk, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, gain: np.ndarray, worth: np.ndarray, best: Best) -> int:
    """Score an item's documents of a chunk by falling maximum of their mask;
    ``gain`` are the terms' weights times repeats, ``worth`` the same by term
    number.  Returns how many documents were scored."""
    docs, starts, masks = chunk.groups(terms)
    if not len(docs):
        return 0
    most = (gain * chunk.highest[terms]) @ masks.astype(np.int64)
    order = np.argsort(-most, kind="stable")
    sizes = np.diff(np.append(starts, len(docs)))
    done = np.cumsum(sizes[order])
    i = scored = 0
    while i < len(order) and most[order[i]] >= best.bar:
        before = int(done[i - 1]) if i else 0
        j = min(int(np.searchsorted(done, before + SCORE_AT_ONCE)) + 1, len(order))
        group = order[i:j]
        group = group[most[group] >= best.bar]
        some = docs[ranges(starts[group], sizes[group])]
        best.add(chunk.scores(some, worth), ids[some], null[some])
        scored += len(some)
        i = j
    return scored


def _search(items: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, total: int, k: int):
    """Index rows -> ``item, doc_id, score``, the task's best of each item."""

    def run(batches):
        best = [Best(k) for _ in items]
        terms = [np.array([t for t, _ in item], np.int64) for item in items]
        gains = [np.array([c for _, c in item], np.int64) * weights[t] for item, t in zip(items, terms)]
        worth = np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(at, CHUNK_DOCS)
                doc_id = part.column(0)
                null = doc_id.is_null().to_numpy(zero_copy_only=False)
                ids = doc_id.fill_null(0).to_numpy()
                n, lists = part.column(1).to_numpy(), part.column(2)
                stops = lists.offsets.to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy()
                m = np.repeat(lengths(n, documents, total), np.diff(stops))
                chunk = Chunk(n, stops - stops[0], lists.flatten().to_numpy(), 1_000_000_000 * tf // (1000 * tf + 12 * m), len(weights))
                for t, gain, kept in zip(terms, gains, best):
                    worth[t] = gain
                    search_chunk(chunk, ids, null, t, gain, worth, kept)
                    worth[t] = 0
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(item):
            ids, null = np.concatenate([b.ids for b in best]), np.concatenate([b.null for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, mask=null), pa.array(np.concatenate([b.score for b in best]))],
                names=["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in block))))}
    index = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_index(vocabulary), _DOC_FIELDS))
    size = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    documents, total = size[0], size[1] or 0
    weights = np.full(len(vocabulary), weight(documents, 0), np.int64)
    for t, holding in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[t] = weight(documents, holding)
    items = [sorted((vocabulary[t], c) for t, c in counts.items()) for _, counts in block]
    found = index.mapInArrow(_search(items, weights, documents, total, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents (``doc_id, text``)
    of every item (``item_id, text``), best first, equal scores by rising doc_id."""
    with scratch() as tables:
        parts = [cut_lineage(_search_block(docs, block, k)) for block in item_blocks(items)]
        out = None
        for part in parts:
            out = tables.keep(part) if out is None else out.unionAll(tables.keep(part))
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


#: the same result in SQL, scoring every document
SEARCH_SQL = r"""
WITH doc_terms AS (
  SELECT d.row, d.doc_id, t.term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) d,
       unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term)
  GROUP BY ALL
), doc AS (SELECT row, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY row),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM doc),
df AS (SELECT term, count(*) AS df FROM doc_terms GROUP BY term),
item_terms AS (
  SELECT i.row AS item, i.item_id, t.term, count(*) AS c
  FROM (SELECT row_number() OVER () AS row, item_id, text FROM benchmark) i,
       unnest(regexp_extract_all(translate(i.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term)
  GROUP BY ALL
), weighted AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total
), scored AS (
  SELECT q.item, q.item_id, d.doc_id, d.row,
         sum(q.c * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * doc.n * nn) // ll))))::BIGINT AS score
  FROM item_terms q JOIN doc_terms d USING (term) JOIN weighted w USING (term) JOIN doc ON doc.row = d.row, total
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
