"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint bit is the majority vote of that bit over the hashes of all word
shingles of the whole text.  Two fingerprints that differ in at most ``d`` bits
agree on at least ``m - d`` of any ``m`` blocks, so they share at least one of
the C(m, d) keys made of ``m - d`` blocks: a join on those keys finds every
close pair, and the Hamming distance is verified on each.

Copies never meet each other: the join runs over distinct fingerprints.  Dense
clusters (many close fingerprints) do not produce all their pairs either: each
task emits the star forest of the links it finds, and a first pass over one
key contracts the clusters, so that the pass over all keys only reports links
between fingerprints that are not connected yet.

Null texts and texts without words have fingerprint zero; repeated rows have
one fingerprint; a null ``doc_id`` is never a component id unless the
component has no other.  An empty table gives an empty table.  Other columns
of the input are not read."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.llm.buckets import cells
from dyad.llm.common import append_columns, group_starts, ranges, sorted_groups, text_slices
from dyad.llm.components import connected_components, stars
from dyad.operators.joins import join_small
from dyad.session import cut_lineage, scratch

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
_VOTE_ROWS = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text (ASCII letters lower-cased)."""
    parts = [] if text is None else text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= k:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(parts) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, stops)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _VOTE_ROWS):
        part = hashes[at : at + _VOTE_ROWS]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, name: str = "fp", k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` plus the long ``name`` (the fingerprint's 64 bits, signed)."""

    def run(columns: list[pa.Array]) -> list:
        out = np.zeros(len(columns[0]), np.uint64)
        for at, texts in text_slices(columns[0]):
            out[at : at + len(texts)] = [fingerprint(t, k) for t in texts]
        return [pa.array(out.view(np.int64))]

    return append_columns(docs, ["text"], run, [(name, T.LongType())])


def blocks_for(n_fingerprints: int, max_bits: int = MAX_BITS) -> int:
    """Fewest blocks whose keys have more bits than a count of the fingerprints
    needs, so that a key's bucket holds less than one unrelated fingerprint on
    average.  Any number above ``max_bits`` finds the same links."""
    blocks = max_bits + 2
    while blocks < 16 and 64 * (blocks - max_bits) / blocks < np.log2(max(n_fingerprints, 2)):
        blocks += 1
    return blocks


def block_keys(fp: str, blocks: int, max_bits: int = MAX_BITS) -> list[Column]:
    """One long per choice of ``blocks - max_bits`` blocks, made of the
    choice's number and its bits; equal bits always give the same key."""
    if blocks <= max_bits:
        raise ValueError("blocks must exceed max_bits")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col(fp).bitwiseAND(F.lit(signed).cast("long"))))
    return keys


def close_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of distinct
    ``fp`` values at most ``max_bits`` apart.  ``fps``: one row per fingerprint."""
    keys = block_keys("fp", blocks or blocks_for(fps.count(), max_bits), max_bits)
    near = _linker(max_bits)
    first = cells(fps.select("fp", F.col("fp").alias("label"), keys[0].alias("key")), "key", "fp")
    contracted = connected_components(first.mapInArrow(near, "a long, b long"))
    labelled = cut_lineage(fps.join(contracted.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("label")))
    rest = cells(labelled.select("fp", "label", F.explode(F.array(*keys)).alias("key")), "key", "fp")
    links = contracted.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return links.unionAll(rest.mapInArrow(near, "a long, b long"))


def _linker(max_bits: int):
    """Sorted cells -> star forest of the links between labels."""

    def run(batches):
        for t in sorted_groups(batches, ("key", "_i", "_j")):
            fp = t.column("fp").to_numpy().view(np.uint64)
            label, side = t.column("label").to_numpy(), t.column("_side").to_numpy()
            i, j = t.column("_i").to_numpy(), t.column("_j").to_numpy()
            starts = group_starts(t.column("key").to_numpy(), i, j)
            sizes = np.diff(np.append(starts, len(fp)))
            found_a, found_b = [], []
            small = (sizes > 1) & (sizes <= 64)
            rows = ranges(starts[small], sizes[small])
            group = np.repeat(np.arange(small.sum()), sizes[small])
            for shift in range(1, int(sizes[small].max(initial=1))):
                x, y = rows[:-shift], rows[shift:]
                pick = group[:-shift] == group[shift:]
                x, y = x[pick], y[pick]
                pick = ((i[x] == j[x]) | (side[x] != side[y])) & (label[x] != label[y])
                x, y = x[pick], y[pick]
                near = np.bitwise_count(fp[x] ^ fp[y]) <= max_bits
                found_a.append(label[x[near]])
                found_b.append(label[y[near]])
            for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
                a, b = _large_cell(fp[s : s + n], label[s : s + n], side[s : s + n], i[s] == j[s], max_bits)
                found_a.append(a)
                found_b.append(b)
            if found_a and sum(map(len, found_a)):
                a, b = stars(np.concatenate(found_a), np.concatenate(found_b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _large_cell(fp, label, side, alone: bool, max_bits: int):
    """Star links of one large cell, compared in blocks of rows."""
    left = np.arange(len(fp)) if alone else np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        y = right[right > x[0]] if alone else right
        near = (np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= max_bits) & (label[x][:, None] != label[y][None, :])
        p, q = np.nonzero(near)
        if len(p):
            a, b = stars(label[x[p]], label[y[q]])
            out_a.append(a)
            out_b.append(b)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return stars(a, b) if len(a) else (a, b)


def _components(rows: DataFrame, max_bits: int, blocks: int | None) -> DataFrame:
    """``fp, root`` for every distinct fingerprint of ``rows``."""
    with scratch() as tables:
        fps = cut_lineage(rows.select("fp").distinct())
        component = connected_components(close_links(fps, max_bits, blocks)).withColumnRenamed("node", "fp")
        return tables.keep(cut_lineage(fps.join(component, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))))


def simhash_components(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (hex), ``component_id`` (smallest ``doc_id``
    reachable) for every row of ``docs``."""
    with scratch() as tables:
        rows = tables.keep(cut_lineage(fingerprints(docs.select("doc_id", "text"), k=k).drop("text")))
        roots = _components(rows, max_bits, blocks)
        per_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp")
        lowest = per_fp.groupBy("root").agg(F.min("low").alias("component_id"))
        ids = tables.keep(cut_lineage(roots.join(lowest, "root").select("fp", "component_id")))
        return rows.join(ids, "fp").select(
            "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """The rows of ``docs`` (columns as they are) that stay: in every component
    the one with the smallest ``doc_id`` (null last), exactly one even where
    rows repeat."""
    own = {"fp": "_simhash_fp", "row": "_simhash_row"}
    with scratch() as tables:
        numbered = docs.withColumn(own["row"], F.monotonically_increasing_id())
        rows = tables.keep(cut_lineage(fingerprints(numbered, own["fp"], k)))
        small = rows.select("doc_id", F.col(own["fp"]).alias("fp"), F.col(own["row"]).alias("row"))
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
        per_fp = small.groupBy("fp").agg(first).join(_components(small, max_bits, blocks), "fp")
        kept = per_fp.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(own["row"]))
        # texts meet the rows that go, which are far fewer than those that stay, so texts are seldom shuffled
        gone = tables.keep(cut_lineage(rows.select(own["row"]).join(kept, own["row"], "left_anti")))
        stay = join_small(rows, gone, own["row"], how="left_anti", known_rows=gone.count())
        return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
