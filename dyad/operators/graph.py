"""Graph featurisation as joins and aggregates.

A graph store is two tables: ``nodes(graph_id, node_id, ...)`` and
``edges(graph_id, src, dst)``.  Every per-node step is an edge join followed by
a ``groupBy`` with partial aggregation, so a hub node (or a graph holding a
third of all nodes) is summed map-side instead of being gathered into one
task.  Iterative steps cut lineage with a reliable checkpoint per round.

That is how graphs of more than ``GRAPH_ROWS`` rows go.  Ordinary graphs take all of a
step (degrees, descriptors, every round of a fingerprint, every layer of a
propagation) in one exchange by graph, in as many partitions as their rows need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyad.operators.joins import join_small
from dyad.operators.order import group_positions, prefix_totals
from dyad.operators.quantiles import reads_a_table
from dyad.session import cut_lineage

G = "graph_id"
#: graphs with more nodes and edges than this are refined by joins, not in one task
GRAPH_ROWS = 200_000
#: nodes and edges per partition of the exchange by graph
PARTITION_ROWS = 2_000_000


def chain_graphs(items: DataFrame, graph: str, order: str, label_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered ``0..n-1`` per graph in ``order`` (distributed index, no
    per-graph window) and a bond between consecutive nodes.  The index is written
    once with each graph's size, which tells where a chain ends without a join."""
    placed = group_positions(items, order, graph, out="node_id", total="_of", keep=label_cols).select(
        F.col(graph).alias(G), "node_id", "_of", *label_cols)
    placed = placed if reads_a_table(placed) else cut_lineage(placed)
    edges = placed.filter(F.col(G).isNotNull() & (F.col("node_id") + 1 < F.col("_of"))).select(
        G, F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    return placed.drop("_of"), edges


def undirected(edges: DataFrame) -> DataFrame:
    """G1: each bond stored in both directions; no bonds -> no rows."""
    swapped = edges.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(G, "src", "dst").unionByName(swapped)


def _token_tables(docs: DataFrame, tokens: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Rows alone in their ``graph_id`` (or without one) as ``graph_id, t, src, dst``: their distinct tokens and the
    numbers of their edges' ends; and nodes and edges (once) of the others, None if there are none."""
    docs = docs.select(G, F.col(tokens).alias("t"))
    repeated = cut_lineage(docs.filter(F.col(G).isNotNull()).groupBy(G).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(G))
    n_repeated = repeated.count()
    alone = join_small(docs, repeated, G, how="left_anti", known_rows=n_repeated) if n_repeated else docs
    schema = T.StructType([docs.schema[G], T.StructField("t", T.ArrayType(T.StringType())),
                           *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("src", "dst")]])
    packed = cut_lineage(alone.mapInArrow(_row_graphs, schema))
    if not n_repeated:
        return packed, None
    shared = cut_lineage(join_small(docs, repeated, G, how="left_semi", known_rows=n_repeated))
    own = shared.select(G, F.explode(F.array_distinct("t")).alias("token"))
    ids = cut_lineage(prefix_totals(own.distinct(), ["token"], G, out="_i").select(G, "token", F.col("_i").cast("int").alias("node_id")))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = shared.select(G, F.explode(F.arrays_zip(F.slice("t", 1, n).alias("a"), F.slice("t", 2, n).alias("b"))).alias("p")).filter(F.col("p.a") != F.col("p.b"))
    ends = pairs.select(G, F.least("p.a", "p.b").alias("_a"), F.greatest("p.a", "p.b").alias("_b")).distinct()
    for token, end in (("_a", "src"), ("_b", "dst")):
        ends = ends.join(ids.select(G, F.col("token").alias(token), F.col("node_id").alias(end)), [G, token])
    return packed, (cut_lineage(own.join(ids, [G, "token"]).select(G, "node_id", "token")), cut_lineage(ends.select(G, "src", "dst")))


def _read_off(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (once) of the rows of :func:`_token_tables`."""
    und = packed.select(G, F.explode(F.arrays_zip("src", "dst")).alias("e")).select(G, "e.src", "e.dst")
    return packed.select(G, F.posexplode("t").alias("node_id", "token")), und


def token_graphs(docs: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(graph_id, node_id, token)`` and edges in both directions of graphs
    whose nodes are the distinct tokens of a ``graph_id``'s rows and whose edges join
    adjacent different ones.

    The graph of a row alone in its ``graph_id`` is made in the row and written once,
    as its tokens and the numbers of its edges' ends; nodes and edges are read off
    it.  Rows that share a ``graph_id`` are numbered together through joins, each
    row giving its own tokens as nodes."""
    packed, shared = _token_tables(docs, tokens)
    nodes, und = _read_off(packed)
    if shared:
        nodes, und = nodes.unionByName(shared[0]), und.unionByName(shared[1])
    return nodes, undirected(und)


def token_graph_rows(docs: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`token_graphs` for :func:`circular_fingerprint` with the token as label: the graphs of a row alone in its
    ``graph_id`` come as ``rows``, one list each that needs no exchange; nodes and edges are those of the others, of
    rows without a ``graph_id`` and of graphs of more than ``GRAPH_ROWS`` rows."""
    packed, shared = _token_tables(docs, tokens)
    small = F.col(G).isNotNull() & (F.size("t") + 2 * F.size("src") <= GRAPH_ROWS)
    nodes, und = _read_off(packed.filter(~small))
    if shared:
        nodes, und = nodes.unionByName(shared[0]), und.unionByName(shared[1])
    row = lambda a, b, lab, node: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), lab.alias("lab"), F.lit(node).alias("node"))
    none, ends = F.lit(None), F.arrays_zip("src", "dst")
    rows = packed.filter(small & (F.size("t") > 0)).select(G, F.concat(
        F.transform("t", lambda x, i: row(i, none, F.md5(x), True)), F.transform(ends, lambda e: row(e["src"], e["dst"], none.cast("string"), False)),
        F.transform(ends, lambda e: row(e["dst"], e["src"], none.cast("string"), False))).alias("rows"))
    return nodes, undirected(und), rows


#: tokens taken up at once in :func:`token_graphs`
PIECE_TOKENS = 1_000_000


def _row_graphs(batches):
    """``(graph, tokens)`` -> ``(graph, distinct tokens, src, dst)``, an edge once."""
    for batch in batches:
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
        piece = np.cumsum(sizes) // PIECE_TOKENS
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(piece)) + 1):
            if not len(part):
                continue
            rows = batch.slice(part[0], len(part))
            size = sizes[part]
            words = rows.column(1).flatten().dictionary_encode()
            kinds, row = max(len(words.dictionary), 1), np.repeat(np.arange(len(part)), size)
            found, place = np.unique(row * kinds + words.indices.to_numpy(), return_inverse=True)
            n_nodes = np.bincount(found // kinds, minlength=len(part))
            number = place - np.repeat(np.cumsum(n_nodes) - n_nodes, size)
            near = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] != number[:-1]))
            low, high = (f(number[near], number[near + 1]) for f in (np.minimum, np.maximum))
            most = int(n_nodes.max(initial=1))
            edges = np.unique((row[near] * most + low) * most + high)
            edge_ends = np.append(0, np.cumsum(np.bincount(edges // most // most, minlength=len(part)))).astype(np.int32)
            node_ends = np.append(0, np.cumsum(n_nodes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(node_ends, words.dictionary.take(pa.array(found % kinds))),
                 *[pa.ListArray.from_arrays(edge_ends, pa.array(x.astype(np.int32))) for x in (edges // most % most, edges % most)]],
                names=[G, "t", "src", "dst"])


def degrees(und_edges: DataFrame) -> DataFrame:
    return und_edges.groupBy(G, F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def _split(nodes: DataFrame, und_edges: DataFrame, columns: Sequence[str], bonds: bool = False) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Rows ``graph_id, a, b, node`` and ``columns`` of ordinary graphs for :func:`_whole_graphs`: a node ``a``, or an
    edge ``a, b`` (in the type of ``node_id``; ``bonds``: ``up`` tells if ``a < b``); and the nodes and
    edges of the graphs of more than ``GRAPH_ROWS`` rows, None if there are none."""
    nodes = nodes if reads_a_table(nodes) else cut_lineage(nodes)
    kind = nodes.schema["node_id"].dataType
    ends = und_edges.filter(F.col(G).isNotNull() & F.col("src").isNotNull())
    up = [(F.col("src") < F.col("dst")).alias("up")] if bonds else []
    rows = nodes.select(G, F.col("node_id").alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(True).alias("node"), *columns).unionByName(
        ends.select(G, F.col("src").cast(kind).alias("a"), F.col("dst").cast(kind).alias("b"), F.lit(False).alias("node"), *up), allowMissingColumns=True)
    rows, part = _exchanged(rows)
    return rows, part and (part(nodes), part(und_edges))


def _exchanged(rows: DataFrame):
    """The ``rows`` of every ordinary graph as one list; and what selects the rows
    of the others of a frame, None if there are none.  A list goes to Python for a fraction of what its rows would take."""
    sizes = cut_lineage(rows.groupBy(G).agg(F.count(F.lit(1)).alias("n")))
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.filter(F.col("n") > GRAPH_ROWS).select(G)
    n_large = large.count()

    def part(df: DataFrame, how: str = "left_semi") -> DataFrame:
        return join_small(df, large, G, how=how, known_rows=n_large, null_safe=True)

    if n_large:
        rows = part(rows, "left_anti")
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PARTITION_ROWS))
    lists = rows.repartition(partitions, G).groupBy(G).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != G])).alias("rows"))
    return lists, part if n_large else None


def _whole_graphs(made):
    """``made`` of tables of whole graphs, from the lists of :func:`_exchanged`."""

    def flat(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            piece = np.cumsum(size) // max(GRAPH_ROWS, 1)
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(piece)) + 1):
                if len(rows):
                    lists = batch.slice(rows[0], len(rows))
                    rows_of = lists.column(1).flatten()
                    yield pa.table([lists.column(0).take(pa.array(np.repeat(np.arange(len(rows)), size[rows]))), *rows_of.flatten()],
                                   names=[G, *[f.name for f in rows_of.type]])

    def run(batches):
        for t in flat(batches):
            yield made(t)

    return run


class _Graphs:
    """Rows of whole graphs (:func:`_split`) by numbers.  ``nodes``: the node rows, ``owner`` their graphs and
    ``place`` their nodes; a row without a graph or a number is none (``none``) and has no edges.  ``leave``
    and ``reach``: the nodes at both ends of every edge row, if ``leaves`` and ``reaches``."""

    def __init__(self, t: pa.Table) -> None:
        self.graph = t.column(G).combine_chunks().dictionary_encode(null_encoding="encode")
        graph_no = self.graph.indices.to_numpy().astype(np.int64)
        ends = pa.chunked_array([t.column(c).combine_chunks() for c in "ab"]).combine_chunks().dictionary_encode(null_encoding="encode")
        code, kinds = ends.indices.to_numpy().astype(np.int64), max(len(ends.dictionary), 1)
        a, b = (graph_no * kinds + c for c in (code[:t.num_rows], code[t.num_rows:]))
        is_node = t.column("node").to_numpy(zero_copy_only=False)
        self.none = (t.column(G).is_null().to_numpy() | t.column("a").is_null().to_numpy())[is_node]
        self.nodes, self.edges, self.owner = t.filter(t.column("node")), ~is_node, graph_no[is_node]
        found, self.place = np.unique(np.where(self.none, -1, a[is_node]), return_inverse=True)
        self.n = len(found)
        if self.n:
            self.leave, self.reach = (np.minimum(np.searchsorted(found, e[~is_node]), self.n - 1) for e in (a, b))
            self.leaves, self.reaches = found[self.leave] == a[~is_node], found[self.reach] == b[~is_node]
        else:
            self.leave = self.reach = np.zeros(int((~is_node).sum()), np.int64)
            self.leaves = self.reaches = np.zeros(len(self.leave), bool)


def _node_degrees(rows: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nodes of :func:`_split`'s ``rows`` with ``degree`` and ``rot``: bonds (``src < dst``) from here with more
    than one bond at both ends; of rows that repeat a node the first one tells them."""

    def made(t: pa.Table) -> pa.RecordBatch:
        g = _Graphs(t)
        degree = np.bincount(g.leave[g.leaves], minlength=g.n)
        bond = g.leaves & g.reaches & (degree[g.leave] > 1) & (degree[g.reach] > 1) if g.n else g.leaves
        bond &= t.column("up").to_numpy(zero_copy_only=False)[g.edges].astype(bool)
        times = np.bincount(g.place, minlength=g.n)
        rot = np.bincount(g.leave[bond], (times[g.leave] * times[g.reach])[bond], minlength=g.n) if g.n else times
        first = np.zeros(len(g.place), bool)
        first[np.unique(g.place, return_index=True)[1]] = True
        out = [np.where(g.none, 0, degree[g.place]), np.where(g.none | ~first, 0, rot[g.place])]
        return pa.RecordBatch.from_arrays([g.nodes.column(c).combine_chunks() for c in (G, "a", *columns)] + [pa.array(c.astype(np.int64)) for c in out],
                                          names=[G, "node_id", *columns, "degree", "rot"])

    schema = T.StructType([nodes.schema[c] for c in (G, "node_id", *columns)] + [T.StructField(c, T.LongType()) for c in ("degree", "rot")])
    return rows.mapInArrow(_whole_graphs(made), schema)


def _joined_degrees(nodes: DataFrame, und_edges: DataFrame) -> DataFrame:
    joined = nodes.join(degrees(und_edges), [G, "node_id"], "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0)))


def node_features(nodes: DataFrame, und_edges: DataFrame, type_ids: Mapping[str, int], type_col: str = "atom",
                  charge: str = "charge", hydrogens: str = "hydrogens", flag: str = "aromatic") -> DataFrame:
    """``x = [type id, degree, charge, hydrogens, flag]`` per node (degree
    from the undirected edge table; isolated nodes get 0)."""
    ids = F.create_map(*[x for k, v in type_ids.items() for x in (F.lit(k), F.lit(float(v)))])
    columns = list(dict.fromkeys([type_col, charge, hydrogens, flag]))
    rows, large = _split(nodes.select(G, "node_id", *columns), und_edges, columns, bonds=True)
    with_deg = _node_degrees(rows, nodes, columns).drop("rot")
    if large:
        with_deg = with_deg.unionByName(_joined_degrees(*large))
    return with_deg.select(
        G, "node_id",
        F.array(
            F.coalesce(ids[F.col(type_col)], F.lit(0.0)), F.col("degree").cast("double"),
            F.col(charge).cast("double"), F.col(hydrogens).cast("double"), F.col(flag).cast("double"),
        ).alias("x"),
    )


def with_placeholders(entities: DataFrame, x_nodes: DataFrame, entity_key: str, dims: int = 5) -> DataFrame:
    """An entity without nodes gets one zero node (node 0)."""
    x_nodes = x_nodes if reads_a_table(x_nodes) else cut_lineage(x_nodes)  # read twice
    missing = entities.select(F.col(entity_key).alias(G)).distinct().join(x_nodes.select(G).distinct(), G, "left_anti")
    zeros = missing.select(G, F.lit(0).cast(x_nodes.schema["node_id"].dataType).alias("node_id"),
                           F.array(*[F.lit(0.0)] * dims).alias("x"))
    return x_nodes.unionByName(zeros)


def _hash32(c: Column) -> Column:
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint")


def wl_labels(nodes: DataFrame, und_edges: DataFrame, label: Column, rounds: int = 2) -> DataFrame:
    """Weisfeiler-Lehman refinement: ``lab_0 = md5(label)``, then
    ``lab_{r+1} = md5(lab_r '(' sum h(neighbour labs) ':' count ')')``.

    The neighbour multiset is summarised by an order-free sum of 32-bit hashes
    and a count, both partial aggregates, so a hub's neighbours are never
    collected into a list.  Returns ``(graph_id, node_id, round, lab)``.
    """
    cur = cut_lineage(nodes.select(G, "node_id", F.md5(label.cast("string")).alias("lab")))
    out = cur.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        nb = und_edges.join(cur.select(G, F.col("node_id").alias("dst"), _hash32(F.col("lab")).alias("_h")), [G, "dst"]).groupBy(
            G, F.col("src").alias("node_id")
        ).agg(F.sum("_h").alias("_hs"), F.count(F.lit(1)).alias("_c"))
        nxt = cur.join(nb, [G, "node_id"], "left").select(
            G, "node_id",
            F.md5(F.concat(
                "lab", F.lit("("), F.coalesce(F.col("_hs").cast("string"), F.lit("")), F.lit(":"),
                F.coalesce(F.col("_c"), F.lit(0)).cast("string"), F.lit(")"),
            )).alias("lab"),
        )
        cur = cut_lineage(nxt)
        out = out.unionByName(cur.withColumn("round", F.lit(r)))
    return out


def circular_fingerprint(nodes: DataFrame, und_edges: DataFrame, label: Column, radius: int = 2,
                         n_bits: int = 1024, rows: DataFrame | None = None) -> DataFrame:
    """Hashed, folded circular fingerprint: the set of
    ``h(lab) mod n_bits`` over all nodes and rounds ``0..radius``.
    Returns distinct ``(graph_id, bit)``.  ``rows`` are further graphs, each whole
    in a row (:func:`token_graph_rows`)."""
    schema = T.StructType([nodes.schema[G], T.StructField("bit", T.LongType())])
    if rows is not None:
        others = circular_fingerprint(nodes, und_edges, label, radius, n_bits)
        return rows.mapInArrow(_graph_bits(radius, n_bits), schema).unionByName(others)
    rows = nodes.select(G, F.col("node_id").alias("a"), F.lit(None).cast(und_edges.schema["dst"].dataType).alias("b"),
                        F.md5(label.cast("string")).alias("lab"), F.lit(True).alias("node")).unionByName(
        und_edges.filter(F.col(G).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
            G, F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("string").alias("lab"), F.lit(False).alias("node")))
    rows, part = _exchanged(rows)
    bits = rows.mapInArrow(_graph_bits(radius, n_bits), schema)
    if part is None:
        return bits
    labs = wl_labels(part(nodes), part(und_edges), label, radius)
    return bits.unionByName(labs.select(G, F.pmod(_hash32(F.col("lab")), F.lit(n_bits)).alias("bit")).distinct())


def _graph_bits(radius: int, n_bits: int):
    """Rows of whole graphs (``graph, a, b, lab, node``: a node ``a`` with its first
    label, or an edge ``a, b``) -> the distinct ``(graph, bit)``."""

    def made(t: pa.Table) -> pa.RecordBatch:
        g = _Graphs(t)
        labels = g.nodes.column("lab").to_pylist()
        whole = np.array([x is not None for x in labels], bool)
        real = g.leaves & g.reaches
        from_, to = g.leave[real], g.reach[real]

        def over_neighbours(x: np.ndarray) -> np.ndarray:
            """Per node the sum of ``x`` over all node rows that its edges lead to."""
            own, out = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
            np.add.at(own, g.place, x)
            np.add.at(out, from_, own[to])
            return np.where(g.none, 0, out[g.place])

        counts, filled = over_neighbours(np.ones(len(g.place), np.int64)), over_neighbours(whole)
        owner, seen = g.owner, []
        for r in range(radius + 1):
            h = np.frombuffer(bytes.fromhex("".join(x or "0" * 32 for x in labels)), ">u4")[::4].astype(np.int64)
            seen.append(np.unique(owner * (n_bits + 1) + np.where(whole, h % n_bits, n_bits)))
            if r < radius:
                sums = over_neighbours(np.where(whole, h, 0))
                labels = [None if x is None else hashlib.md5(f"{x}({s if f else ''}:{c})".encode()).hexdigest()
                          for x, s, f, c in zip(labels, sums.tolist(), filled.tolist(), counts.tolist())]
        bits = np.unique(np.concatenate(seen))
        bit = bits % (n_bits + 1)
        return pa.RecordBatch.from_arrays([g.graph.dictionary.take(pa.array(bits // (n_bits + 1))), pa.array(bit, mask=bit == n_bits)], names=[G, "bit"])

    return _whole_graphs(made)


def fingerprint_vectors(bits: DataFrame, n_bits: int = 1024) -> DataFrame:
    """Fingerprint as a sorted set-bit array per graph (at most ``n_bits``
    values per graph, de-duplicated map-side by ``collect_set``)."""
    return bits.groupBy(G).agg(F.array_sort(F.collect_set("bit")).alias("bits"))


def descriptors(nodes: DataFrame, und_edges: DataFrame, type_col: str, weights: Mapping[str, float],
                contrib: Mapping[str, float], polar: Sequence[str], hydrogens: str = "hydrogens",
                h_weight: float = 1.008) -> DataFrame:
    """Six graph descriptors per graph -- total node weight, summed
    contribution, polar surface proxy, donors, acceptors, rotatable bonds.
    Weights/contributions come from lookup tables; all are aggregates."""
    wmap = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    cmap = F.create_map(*[x for k, v in contrib.items() for x in (F.lit(k), F.lit(float(v)))])
    is_polar = F.col(type_col).isin(*polar)
    columns = list(dict.fromkeys([type_col, hydrogens]))
    sums = [
        F.sum(F.coalesce(wmap[F.col(type_col)], F.lit(0.0)) + F.col(hydrogens) * F.lit(h_weight)).alias("mol_weight"),
        F.sum(F.coalesce(cmap[F.col(type_col)], F.lit(0.0))).alias("logp"),
        F.sum(F.when(is_polar, F.lit(1.0) + F.col(hydrogens)).otherwise(F.lit(0.0))).alias("tpsa"),
        F.count_if(is_polar & (F.col(hydrogens) > 0)).alias("donors"),
        F.count_if(is_polar).alias("acceptors"),
    ]
    # a bond is rotatable when both ends are non-terminal; each bond counted once (src < dst)
    nodes = nodes.select(G, "node_id", *columns)
    rows, large = _split(nodes, und_edges, columns, bonds=True)
    out = _node_degrees(rows, nodes, columns).groupBy(G).agg(*sums, F.sum("rot").alias("rot_bonds"))
    if not large:
        return out
    per_node = _joined_degrees(*large)
    deg = per_node.select(G, "node_id", "degree")
    bonds = large[1].filter(F.col("src") < F.col("dst")).join(
        deg.select(G, F.col("node_id").alias("src"), F.col("degree").alias("_ds")), [G, "src"]
    ).join(deg.select(G, F.col("node_id").alias("dst"), F.col("degree").alias("_dd")), [G, "dst"])
    rot = bonds.groupBy(G).agg(F.count_if((F.col("_ds") > 1) & (F.col("_dd") > 1)).alias("rot_bonds"))
    joined = per_node.groupBy(G).agg(*sums).join(rot, G, "left").withColumn("rot_bonds", F.coalesce("rot_bonds", F.lit(0)))
    return out.unionByName(joined)


def _dims(x_nodes: DataFrame, col: str = "x") -> int:
    row = x_nodes.select(F.size(col).alias("d")).first()
    return int(row["d"]) if row else 0


def propagate(x_nodes: DataFrame, und_edges: DataFrame, layers: int = 2, dims: int | None = None) -> DataFrame:
    """``x <- relu(x + sum of neighbour x)`` for ``layers`` rounds (GIN
    aggregation with eps 0 and no learned weights).  Vectors stay one array per
    node.  Ordinary graphs take all layers in one exchange; for large ones the neighbour
    sum is one aggregate column per dimension, so rows are edges, not edges x dims,
    and each layer is written out to cut lineage."""
    d = dims or _dims(x_nodes)
    x_nodes = x_nodes.select(G, "node_id", F.col("x").cast("array<double>").alias("x"))
    x_nodes = x_nodes if reads_a_table(x_nodes) else cut_lineage(x_nodes)
    rows, large = _split(x_nodes, und_edges, ["x"])
    out = cut_lineage(rows.mapInArrow(_whole_graphs(_propagated(layers, d)), x_nodes.schema))
    if not large:
        return out
    cur, und_edges = cut_lineage(large[0]), large[1]
    for _ in range(layers):
        msgs = und_edges.join(cur.select(G, F.col("node_id").alias("dst"), "x"), [G, "dst"])
        nb = msgs.groupBy(G, F.col("src").alias("node_id")).agg(
            F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("_s"))
        nxt = cur.join(nb, [G, "node_id"], "left").select(
            G, "node_id",
            F.transform("x", lambda v, i: F.greatest(v + F.coalesce(F.col("_s")[i], F.lit(0.0)), F.lit(0.0))).alias("x"),
        )
        cur = cut_lineage(nxt)
    return out.unionByName(cur)


def _propagated(layers: int, d: int):
    """:func:`propagate` of whole graphs: a null component counts as no neighbour's and becomes 0, a null vector stays."""

    def made(t: pa.Table) -> pa.RecordBatch:
        g = _Graphs(t)
        vectors = g.nodes.column("x").combine_chunks()
        given = vectors.is_valid().to_numpy(zero_copy_only=False)
        if (vectors.value_lengths().filter(vectors.is_valid()).to_numpy() != d).any():
            raise ValueError(f"vectors of {d} components expected")
        flat = vectors.flatten()
        x, known = np.zeros((len(given), d)), np.zeros((len(given), d), bool)
        x[given] = flat.fill_null(0.0).to_numpy().reshape(-1, d)
        known[given] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d)
        real = g.leaves & g.reaches
        from_, to, theirs = g.leave[real], g.reach[real], np.flatnonzero(~g.none)
        for _ in range(layers):
            new = np.zeros_like(x)
            for i in range(d):
                own = np.bincount(g.place[theirs], x[theirs, i], minlength=g.n)
                total = np.bincount(from_, own[to], minlength=g.n)
                new[:, i] = np.where(known[:, i], np.maximum(x[:, i] + np.where(g.none, 0, total[g.place]), 0), 0)
            x, known = new, np.repeat(given[:, None], d, 1)
            x[~given] = 0
        ends = np.append(0, np.cumsum(np.where(given, d, 0))).astype(np.int32)
        made_x = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~given, False)), pa.array(x[given].reshape(-1)))
        return pa.RecordBatch.from_arrays([g.nodes.column(G).combine_chunks(), g.nodes.column("a").combine_chunks(), made_x], names=[G, "node_id", "x"])

    return made


def mean_pool(x_nodes: DataFrame, dims: int | None = None) -> DataFrame:
    """Per-graph mean of node vectors (one aggregate per dimension)."""
    d = dims or _dims(x_nodes)
    return x_nodes.groupBy(G).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("pooled"))


def gather_for_pairs(pairs: DataFrame, pooled: DataFrame, key: str = "drug_id") -> DataFrame:
    """Each pair gets its entity's pooled vector -- pooled once per
    entity, then a key join (no per-pair copy of the graph)."""
    return join_small(pairs, pooled.withColumnRenamed(G, key), key, how="inner")
