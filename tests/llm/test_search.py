"""Nearest vectors, ranked search and periodic runs against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyad.llm import mask_search, period_runs, rp_forest
from dyad.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- op13 ----
def slow_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n_, q) for (s, n_), q in out.items()), key=lambda r: (r[0], r[2]))


def slow_digest(doc_id, text):
    w = [] if text is None else re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *best, hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_runs_match_brute_force():
    r = random.Random(5)
    for _ in range(120):
        texts = []
        for _ in range(r.randrange(1, 6)):
            n, names = r.choice([0, 1, 23, 24, 60, 200]), r.choice([1, 2, 3, 40])
            t = [r.randrange(names) for _ in range(n)]
            if n > 30 and r.random() < 0.6:
                a, p = r.randrange(n // 2), r.randrange(1, 12)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
                if r.random() < 0.5:
                    t[r.randrange(n)] = 99
            texts.append(t)
        got = period_runs.runs([np.array(t, np.int64) for t in texts])
        assert [[tuple(x) for x in g.tolist()] for g in got] == [slow_runs(t) for t in texts]


def test_grammar_extensions_match_a_word_by_word_scan():
    r = np.random.default_rng(2)
    word = np.concatenate([r.integers(0, 2, 300), np.tile(r.integers(0, 3, 7), 40), np.zeros(200, int)])
    symbols = np.concatenate([[9], word, [10]])
    g = period_runs.Grammar(symbols, np.isin(symbols, [9, 10]))
    a, b = np.triu_indices(len(word), 1)
    pick = r.integers(0, len(a), 4000)
    a, b = a[pick] + 1, b[pick] + 1
    ahead, behind = g.common(a, b), g.common(a, b, backwards=True)
    for i, j, x, y in zip(a.tolist(), b.tolist(), ahead.tolist(), behind.tolist()):
        assert symbols[i : i + x].tolist() == symbols[j : j + x].tolist() and symbols[i + x] != symbols[j + x]
        assert symbols[i - y + 1 : i + 1].tolist() == symbols[j - y + 1 : j + 1].tolist() and symbols[i - y] != symbols[j - y]


def test_long_runs_need_few_steps():
    (only,) = period_runs.runs([np.zeros(60_000, np.int64)])
    assert only.tolist() == [[0, 60_000, 1]]
    nested = np.tile(np.concatenate([np.tile([1, 2], 20), [3]]), 300)
    assert [0, len(nested), 41] in period_runs.runs([nested])[0].tolist()


def test_period_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op13_period_runs"](spark, sf_dir).collect()}
    assert got == {d.doc_id: slow_digest(d.doc_id, d.text) for d in docs}
    assert any(v[0] for v in got.values())


def test_period_edges(spark):
    rows = [(1, "a b " * 30, "x"), (1, "a b " * 30, "x"), (2, None, "x"), (3, "", "y"), (None, "c " * 40, None), (4, "é  " * 25, "z"),
            (5, "w " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    made = period_runs.periodic_runs(docs).collect()
    assert len(made) == len(rows)
    by = {r.doc_id: r for r in made}
    assert [tuple(x) for x in by[1].runs] == [(0, 60, 2)] and by[1].collapsed == "a b"
    assert by[2].n_words == 0 and by[2].runs == [] and by[2].collapsed == "" and by[3].n_words == 0
    assert by[None].collapsed == "c" and by[4].collapsed == "é " and [tuple(x) for x in by[5].runs] == [(0, 100_000, 1)]
    assert period_runs.run_digests(period_runs.periodic_runs(docs.limit(0))).count() == 0


# ---- op12 ----
def slow_search(docs, items, k=20):
    split = lambda t: [] if t is None else TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    held = [(i, split(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        for i, w in held:
            m, score = 75 + 25 * len(w) * n_docs // total, 0
            for t in split(text):
                tf = w.count(t)
                if tf:
                    df = sum(t in set(x) for _, x in held)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if score:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_search_matches_brute_force_and_edges(spark):
    r = random.Random(3)
    names = ["Alpha", "b2", "Été", "d", "e-f", "g_h", "x", "Y", "zz", "42"]
    docs = [(i, " ".join(r.choice(names) for _ in range(r.randrange(0, 30)))) for i in range(60)]
    docs += [(61, docs[0][1]), (61, docs[0][1]), (None, docs[1][1]), (62, None), (63, "..."), (64, "alpha " * 50_000)]
    items = [(1, "alpha ALPHA ÉTÉ d"), (1, "zz e f"), (2, None), (3, ""), (4, "nowhere"), (None, "b2 42 x y"), (5, " ".join(names * 3))]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string").repartition(4)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted((tuple(x) for x in mask_search.search(frame, asked).collect()), key=key)
    assert got == sorted(slow_search(docs, items), key=key)
    assert mask_search.search(frame.limit(0), asked).count() == 0 and mask_search.search(frame, asked.limit(0)).count() == 0


def test_blocks_of_items_give_the_same_rows(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(tuple(r) for r in mask_search.search(docs, items).collect())
    monkeypatch.setattr(mask_search, "BLOCK_ITEMS", 7)
    assert sorted(tuple(r) for r in mask_search.search(docs, items.repartition(3)).collect()) == whole


def test_masks_are_skipped_when_safe():
    r = np.random.default_rng(1)
    n, width = 4000, 40
    lists = [np.unique(r.integers(0, width, r.integers(1, 12))) for _ in range(n)]
    stops = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    terms = np.concatenate(lists)
    part = r.integers(500_000, 600_000, len(terms))
    chunk = mask_search.Chunk(np.ones(n), stops, terms, part, width)
    item, gain = np.arange(0, width, 3), r.integers(1, 9000, len(range(0, width, 3)))
    worth = np.zeros(width, np.int64)
    worth[item] = gain
    best = mask_search.Best(20)
    scored = mask_search.search_chunk(chunk, np.arange(n), np.zeros(n, bool), item, gain, worth, best)
    total = np.array([(worth[x] * part[a:b]).sum() for x, a, b in zip(lists, stops, stops[1:])])
    want = np.lexsort((np.arange(n), -total))[:20]
    assert best.ids.tolist() == want.tolist() and best.score.tolist() == total[want].tolist()
    assert scored < n // 4


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "ab, Cd ef" * 3000
    whole = mask_search.term_counts(text)
    monkeypatch.setattr(mask_search, "PIECE_BYTES", 100)
    assert mask_search.term_counts(text) == whole


# ---- op11 ----
def slow_nearest(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            score = []
            for i, u in rows:
                if i != q:
                    s = 0.0
                    for x, y in zip(v, u):
                        s += x * y
                    score.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def listed(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_forest_recall_and_exact_scores(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = slow_nearest(rows), listed(QUERIES["op11_rp_forest"](spark, sf_dir))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_forest_of_unequal_norms_and_copies(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.standard_normal((1500, 12)) * r.lognormal(0, 1, (1500, 1))
    v[600:1100] = v[0]  # a hot vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = slow_nearest(rows)
    whole = listed(rp_forest.nearest(frame, F.col("vec_id") % 20 == 0))
    assert np.mean([len(set(whole[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    copies = [q for q in want if q >= 600 and q < 1100]
    assert all(q not in [i for i, _ in whole[q]] for q in whole) and len(copies) == 25
    monkeypatch.setattr(rp_forest, "CELL_ROWS", 100)
    monkeypatch.setattr(rp_forest, "CELL_QUERIES", 10)
    monkeypatch.setattr(rp_forest, "PAIRS_AT_ONCE", 500)
    assert listed(rp_forest.nearest(frame, F.col("vec_id") % 20 == 0)) == whole


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (20, [0.0, 1.0]), (40, [nan, 1.0]), (60, [0.0, 0.0]),
            (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (140, []), (1, [0.0, 3.0])]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, rank string")
    got = listed(rp_forest.nearest(frame, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 2.0), (2, 1.0), (1, 0.0), (20, 0.0)], 20: [(1, 3.0), (0, 0.0), (1, 0.0), (2, 0.0)]}
    for few in (frame.limit(0), frame.filter("vec_id = 2"), frame.filter("vec_id = 3")):
        assert rp_forest.nearest(few, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("name", ["op11_rp_forest", "op12_mask_search", "op13_period_runs"])
def test_columns(spark, sf_dir, name):
    want = {"op11_rp_forest": "query_id bigint, rank int, vec_id bigint, score double",
            "op12_mask_search": "item_id bigint, rank int, doc_id bigint, score bigint",
            "op13_period_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
                                "runs_sha256 string, collapsed_sha256 string, n_words bigint"}[name]
    assert ", ".join(f"{n} {t}" for n, t in QUERIES[name](spark, sf_dir).dtypes) == want
