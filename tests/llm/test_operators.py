"""Operators of dyad.llm against brute force on small tables, and their edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from dyad.llm import binary_pack, chaining, embedding_dedup, kd_shards, language_id, online_pack, quality_gbt, simhash, spm, toxicity
from dyad.llm.components import stars
from dyad.llm.queries import QUERIES
from dyad.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, kept boolean, sequence_id long, seed string"


def words(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgst')}{r.choice('aeiou')}{r.randrange(400)}" for _ in range(n)]


def edge_rows():
    passage = " ".join(words(60, 99))
    rows = [(i, " ".join(words(80 + i, i)), "en" if i % 2 else "fr", f"s{i % 3}", 100) for i in range(1, 13)]
    rows += [(20, rows[0][1], "en", "s0", 5), (21, rows[0][1] + " more", "en", None, None), (21, rows[0][1] + " more", "en", None, None)]
    rows += [(30, " ".join(words(30, 500)) + " " + passage, "en", "s0", 1), (31, passage + " " + " ".join(words(40, 501)), None, "s0", 1)]
    rows += [(40, None, None, None, None), (41, "", "en", "s1", 0), (42, " \n\t ", "en", "s1", 3), (None, "no id here", "en", "s1", 10),
             (None, None, "en", None, None), (43, "*** 123 $$$", "en", "s2", 11), (44, "word " * 30_000, "en", "s2", 150_000)]
    return [(*r, 1, 2, True, 3, "x") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(1, 1, 0), (None, 1, 1), (2, None, None)],
                                 "doc_id long, quality int, toxic int")


def test_simhash_components_match_all_pairs(spark, docs):
    texts = [r.text for r in docs.collect()] + [" ".join(words(200, 7)[:k] + ["zz"] + words(200, 7)[k:]) for k in range(0, 200, 5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def slow(text):
        w = [] if text is None else text.encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [slow(t) for t in texts]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j, f in enumerate(fps) if bin(f ^ g).count("1") <= 4) for g in fps]
        root = [root[r] for r in root]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(frame).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in enumerate(fps)}
    kept = sorted(r.doc_id for r in simhash.one_per_component(frame).collect())
    assert kept == sorted(set(root))


def test_texts_are_not_shuffled_to_keep_one_per_component(spark):
    rows = [(i, f"text {i} of the table " * 20) for i in range(30)] + [(30, "text 7 of the table " * 20), (None, "text 8 of the table " * 20), (9, "text 9 of the table " * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.one_per_component(frame)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = {r.component_id for r in simhash.simhash_components(frame).collect()}
    out = [r.doc_id for r in kept.collect()]
    assert len(out) == len(set(out)) and set(out) == found


def test_large_cells_find_the_same_links():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 40, dtype=np.uint64).repeat(5)
    fp ^= np.uint64(1) << rng.integers(0, 64, len(fp), dtype=np.uint64)
    label = np.arange(len(fp))
    a, b = simhash._large_cell(fp, label, np.zeros(len(fp), int), True, 4)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    near = near[near[:, 0] < near[:, 1]]
    assert sorted(zip(a, b)) == sorted(zip(*stars(near[:, 0], near[:, 1])))


def test_embedding_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base + 0.12 * rng.standard_normal(base.shape), base[:5], 3 * base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 80 else (i - 80) % 5 % 2) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0] * 16, None), (203, [float("nan")] * 16, 1), (204, [None] * 16, 1), (205, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    lab = np.array([r[2] for r in rows[: len(x)]])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(frame).collect()}
    want = {i: (int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))}
    assert got == want | {i: (0, i, True) for i in range(200, 206)}
    assert embedding_dedup.embedding_components(frame.limit(0)).count() == 0


def test_language_id(docs, empty):
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for i in (40, 41, 42, 43):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[None].held_out is False
    for i, r in rows.items():
        if i is not None:
            assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert language_id.identify(empty).count() == 0


def test_language_id_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = language_id.identify(d).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.97


def test_ngram_counts_match_plain_python():
    text = "Abca bca"
    ids, starts = language_id.ngram_ids(["x", text, "yy"])
    alone, s = language_id.ngram_ids([text])
    assert (language_id.counts_of(ids, starts[1], starts[2]) == language_id.counts_of(alone, s[0], s[1])).all()
    assert language_id.counts_of(alone, 0, len(text)).sum() == len(text) + len(text) - 1 + len(text) - 2


def slow_repeat(w):
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)})


def test_quality_counts_and_rule(docs, labels, empty):
    for text in ["a b c a b c d", "a a a a", "x y z", "", None, "l1 l1\nl2\n l1 l1\nl1 l1\n\n\n", "é|<> #1 b  c"]:
        got = dict(zip(quality_gbt.COUNTS, quality_gbt.text_counts(text)))
        w = [] if text is None else text.encode().split()
        assert got["n_words"] == len(w)
        assert got["word_chars"] == sum(len(x.decode()) for x in w)
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert got["n_repeat_words"] == slow_repeat(w)
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
    rows = {r.doc_id: r for r in quality_gbt.quality(docs, labels).collect()}
    assert rows[40].base_failed and rows[44].base_failed and not rows[40].kept and not rows[5].base_failed
    assert quality_gbt.quality(empty, labels).count() == 0


def test_trees_are_monotonic_and_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_gbt.FEATURES)))
    y = ((x[:, 2] < 0.6) ^ (rng.random(600) < 0.2)).astype(float)
    forest = quality_gbt.fit(x, y, tuple(quality_gbt.FEATURES.values()), trees=20)
    for f, sign in enumerate(quality_gbt.FEATURES.values()):
        if sign:
            steps = np.repeat(x[:20], 30, axis=0)
            steps[:, f] = np.tile(np.linspace(0, 1, 30), 20)
            assert (np.diff(forest.score(steps).reshape(20, 30), axis=1) * sign >= -1e-12).all()

    def walk(row):
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])
    assert (quality_gbt.fit(x, np.ones(600), (0,) * 10).score(x) > 0.99).all()


def test_quality_separates_held_out_labels(spark, sf_dir):
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_gbt.train(d, lab.filter("doc_id % 2 = 0"))
    r = quality_gbt.append_verdict(d, forest).filter("not base_failed").join(lab.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (r.kept == (r.quality == 1)).mean() > 0.9


def test_toxicity_chain(docs, labels, empty, spark, sf_dir):
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert not rows[40].toxic and rows[1].p_toxic == rows[20].p_toxic
    assert toxicity.toxicity(empty, labels).count() == 0
    rng = np.random.default_rng(5)
    texts = [" ".join(words(30, i)) + (" vile" if i % 4 == 0 else "") + (" spam" if i % 3 == 0 else "") for i in range(600)]
    y = np.array([[i % 3 == 0, i % 4 == 0 and i % 3 == 0] for i in range(600)], float)  # the second needs the first
    chain = toxicity.fit_chain(pa.array(texts[:400]), y[:400], rng.integers(0, 5, 400))
    r, b = toxicity.word_buckets(pa.array(texts[400:]))
    p = toxicity.sigmoid(chain[0].logit(r, b, np.zeros((200, 0))))
    q = toxicity.sigmoid(chain[1].logit(r, b, p[:, None]))
    assert chain[1].earlier[0] > 0 and ((q > 0.5) == y[400:, 1]).mean() > 0.95


def test_sharding(docs, empty):
    rows = kd_shards.shard_documents(docs).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(by) <= 15
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert kd_shards.shard_documents(empty).count() == 0


def test_sharding_splits_at_weighted_medians(spark, sf_dir):
    rows, dims = kd_shards.metadata(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r.tie: r.node for r in kd_shards.kd_leaves(rows, dims, 1, 2).collect()}
    data = [r.asDict() for r in rows.collect()]
    node = {r["tie"]: 0 for r in data}
    span = {d: max(max(r[d] for r in data) - min(r[d] for r in data), 1) for d in dims}
    for level in range(2):
        for n in range(2**level - 1, 2 ** (level + 1) - 1):
            own = [r for r in data if node[r["tie"]] == n]
            d = max(dims, key=lambda d: (max(r[d] for r in own) - min(r[d] for r in own)) / span[d])
            own.sort(key=lambda r: (r[d], r["tie"]))
            total, below, half = sum(r["size"] for r in own), 0, True
            for r in own:
                at = below + r["size"]
                left = half and (2 * at < total or 2 * below + r["size"] <= total)
                half = half and 2 * at < total
                node[r["tie"]] = 2 * n + 1 + (not left)
                below = at
    assert got == node


def test_sharding_of_null_repeated_and_very_large_ids(spark):
    for ids in ([None] * 400, [7] * 400, [2**63 - 1 - i if i % 2 else -(2**63) + i for i in range(400)]):
        rows = [(i, "x" * 50, "en", "s", 50, "clash") for i in ids]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tie string")
        sizes = {}
        for r in kd_shards.shard_documents(frame).collect():
            sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 51


def slow_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_chunked_encoding_equals_whole_texts():
    texts = ["", None, " a", "a ", "a  b", "x\n\n y", "\t z  ", "<|endoftext|> q", "it's 12 o'clock!! ok", "é 日本 😀", " ", "a \n b", "  b c"]
    ids, n = encoder(default_tokenizer()).encode(pa.array(texts))
    stop = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(stop, n)] == [slow_ids(t) for t in texts]


def check_packing(rows, texts, length=1024):
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, n in sorted(at):
            assert offset == end
            end += n
        assert end <= length
    for doc_id, text in texts.items():
        ids, end = slow_ids(text) + [2], 0
        for p in sorted(pieces[doc_id], key=lambda p: p.piece):
            assert p.start == end and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            end += p.length
        assert end == len(ids)


def test_online_packing(docs, empty):
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(online_pack.pack_documents(one).collect(), {r.doc_id: r.text for r in one.collect()})
    assert online_pack.pack_documents(docs).filter("doc_id is null").count() == 2
    assert online_pack.pack_documents(empty).count() == 0


def test_open_bins_close_the_fullest():
    bins = online_pack.OpenBins(10, 2)
    assert [bins.place(s) for s in (6, 7, 5, 3, 5)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]


def test_best_fit_decreasing_equals_the_sequential_one():
    r = random.Random(4)
    for _ in range(30):
        sizes = sorted((r.randint(1, 40) for _ in range(r.randint(0, 300))), reverse=True)
        free, want = [], 0
        for s in sizes:
            fit = min((f for f in free if f >= s), default=None)
            if fit is None:
                free.append(40 - s)
                want += 1
            else:
                free.remove(fit)
                free.append(fit - s)
        plan = binary_pack.best_fit_decreasing({s: sizes.count(s) for s in set(sizes)}, 40)
        size = np.array(sizes, np.int64)
        number = np.array([sizes[:i].count(s) for i, s in enumerate(sizes)], np.int64)
        at, offset = binary_pack.place(plan, size, number) if sizes else (number, number)
        assert len(set(at.tolist())) == want
        for b in set(at.tolist()):
            end = 0
            for o, s in sorted(zip(offset[at == b].tolist(), size[at == b].tolist())):
                assert o == end
                end += s
            assert end <= 40


def test_binary_packing_round_trip(docs, empty):
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    found = {}
    for r in binary_pack.packed_sequences(one).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(d, {})[p] = ids[a:b].tolist()
    for r in one.collect():
        assert [x for p in sorted(found[r.doc_id]) for x in found[r.doc_id][p]] == slow_ids(r.text) + [2]
    assert binary_pack.packed_sequences(empty).count() == 0


def test_sentencepiece_parity_and_round_trip(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    rows = spm.encode_documents(docs)
    for r in rows.join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        assert r.ids == sp.encode(r.text or "") and r.parity and r.round_trip and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in spm.decode_documents(rows.filter("doc_id is not null")).collect()}
    assert back[1] == docs.filter("doc_id = 1").first().text and back[40] == ""
    assert spm.encode_documents(empty).count() == 0


def test_unigram_models_are_rebuilt():
    model = spm.Model([("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("c", -3.0, 1)], strip_spaces=False)
    assert spm.build(model).encode("abc ab").tokens == ["▁ab", "c", "▁ab"]


def test_shared_passages_and_cut(docs, empty):
    found = {(r.doc_id, r.other_id): r for r in chaining.shared_passages(docs).collect()}
    r = found[(31, 30)]
    assert (r.start, r.stop, r.other_start, r.other_stop, r.identity) == (0, 60, 30, 90, 1.0)
    assert (20, 1) in found and (21, 1) in found and not any(2 in k or 3 in k for k in found)
    cut = {r.doc_id: r for r in chaining.cut_passages(docs, chaining.shared_passages(docs)).collect()}
    assert cut[31].text.split() == words(40, 501) and cut[31].n_chars == len(cut[31].text)
    assert 20 not in cut and cut[1].n_chars == 100 and cut[40].text is None
    assert chaining.shared_passages(empty).count() == 0


def test_fuzzy_passage_is_found(spark):
    base = words(120, 7)
    edited = [("other" if i % 19 == 7 else w) for i, w in enumerate(base) if i % 31 != 11]
    rows = [(1, " ".join(words(50, 8) + base)), (2, " ".join(edited + words(60, 9))), (3, " ".join(words(300, 10)))]
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(2, 1)]
    assert got[0].identity >= 0.8 and got[0].stop - got[0].start >= 50


def test_exact_repeats_are_complete(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, repeated = {}, set()
    for r in d.orderBy("doc_id").collect():
        w = r.text.lower().encode().split()
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), r.doc_id) != r.doc_id:
                repeated.add(r.doc_id)
    assert repeated <= {r.doc_id for r in chaining.shared_passages(d).collect()}


def covered(spans, doc_id):
    return {i for r in spans if r.doc_id == doc_id for i in range(r.start, r.stop)}


def test_passage_is_found_when_an_earlier_document_quotes_part_of_it(spark):
    rows = []
    for k in range(8):
        p = words(55, 1000 + k)
        texts = [p[:49] + words(60, 1100 + k), words(60, 1200 + k) + p, p + words(60, 1300 + k), words(20, 1400 + k) + p]
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate(texts)]
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for k in range(8):
        assert covered(got, 10 * k + 2) >= set(range(55)) and covered(got, 10 * k + 3) >= set(range(20, 75))


def test_passages_in_another_order_are_found(spark):
    a, b, c = words(200, 70), words(150, 71), words(200, 72)
    rows = [(1, " ".join(a + c + b)), (2, " ".join(a + b + c))]
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert covered(got, 2) == set(range(550)) and len(got) == 3


def planted_recall(spark, n_words, every, n=40):
    rows, r = [], random.Random(every)
    for k in range(n):
        p = words(n_words, 2000 + k)
        shift = r.randrange(every)
        q = [f"new{k}x{i}" if (i + shift) % every == 0 else w for i, w in enumerate(p)]
        rows += [(2 * k, " ".join(words(80, 3000 + k) + p + words(70, 4000 + k))), (2 * k + 1, " ".join(words(75, 5000 + k) + q + words(65, 6000 + k)))]
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return len({r.doc_id for r in got if r.other_id == r.doc_id - 1 and r.doc_id % 2}) / n


def test_fuzzy_passages_of_sixty_words_are_found(spark):
    assert planted_recall(spark, 60, 10) == 1.0 and planted_recall(spark, 60, 8) == 1.0


def test_stretches_hold_every_equal_run():
    a = np.arange(200)
    b = np.where((a >= 60) & (a < 115) | (a % 3 == 0), a, -1)
    (s, e, t, f, equal, identity), = chaining.stretches(a, b, 0, 0, 200)
    assert s <= 60 and e >= 115 and (t, f) == (s, e) and identity >= 0.8 and equal == (a[s:e] == b[s:e]).sum()


def test_runs_align_alike_one_by_one_and_together():
    r = np.random.default_rng(3)
    a_n, b_n, rows = [], [], []
    for _ in range(400):
        n, before, other = int(r.integers(5, 80)), int(r.integers(0, 46)), int(r.integers(0, 46))
        a = r.integers(0, 1000, before + n + int(r.integers(0, 46))).astype(np.uint32)
        b = r.integers(1000, 2000, other + n + int(r.integers(0, 46))).astype(np.uint32)
        both, after = min(before, other), min(len(a) - before, len(b) - other)
        keep = r.random(both + after) < r.choice([0.6, 0.85, 1.0])
        keep[both : both + 5] = True
        b[other - both : other + after] = np.where(keep, a[before - both : before + after], b[other - both : other + after])
        rows.append((a, b, before, other, n))
    a_n, b_n = (np.array([len(row[i]) for row in rows]) for i in (0, 1))
    x, y, n = (np.array([row[i] for row in rows]) for i in (2, 3, 4))
    which, found = chaining.align_runs(
        np.concatenate([row[0] for row in rows]), np.concatenate([row[1] for row in rows]),
        np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n, a_n, b_n, x, y, n)
    want = [(i, p) for i, (a, b, p, q, n) in enumerate(rows) for p in chaining.align(a, b, [(p, q, n)])]
    assert sorted(zip(which.tolist(), found)) == want and len(want) > 100


def test_packed_seeds_come_back():
    r = np.random.default_rng(5)
    n = 1000
    rows = chaining.Seeds(np.sort(r.integers(0, 1 << 40, n).astype(np.uint64)), r.integers(-(1 << 62), 1 << 62, n), r.integers(0, 1 << 28, n),
                          r.choice([chaining.K, chaining.LONG, chaining.MIN_WORDS], n), r.random(n) < 0.5)
    back = chaining.unpack(chaining.pack(rows))
    assert all((getattr(back, c) == getattr(rows, c)).all() for c in ("h", "doc", "at", "size", "anchor"))


def test_links_join_repeats_of_different_documents_only():
    seeds = [(5, 1, 0), (5, 1, 9), (5, 3, 4), (5, 7, 2), (6, 2, 0), (6, 2, 8), (7, 4, 1)]
    h, doc, at = (np.array(c) for c in zip(*seeds))
    rows = chaining.Seeds(h.astype(np.uint64), doc, at, np.full(7, 5), np.array([True, False, True, True, True, False, True]))
    assert rows.repeated().tolist() == [True] * 4 + [False] * 3
    (x, y, px, py, _), ends = chaining.links(rows.take(np.flatnonzero(rows.repeated())), True)
    assert sorted(zip(x.tolist(), y.tolist(), px.tolist(), py.tolist())) == [(3, 1, 4, 0), (7, 1, 2, 0), (7, 3, 2, 4)]
    assert ends.doc.tolist() == [1, 3]


def test_links_of_two_blocks_are_those_between_them():
    r = np.random.default_rng(11)
    n = 300
    rows = chaining.Seeds(r.integers(0, 12, n).astype(np.uint64), r.integers(0, 40, n), np.arange(n), np.full(n, 5), np.ones(n, bool))
    side = rows.doc % 3 == 0
    (x, y, px, py, _), _ = chaining.links(rows, True)
    every = sorted(zip(x.tolist(), y.tolist(), px.tolist(), py.tolist()))
    first = {}
    for h, d, p in zip(rows.h.tolist(), rows.doc.tolist(), rows.at.tolist()):
        first.setdefault((h, d), p)
    assert every == sorted((d, e, p, q) for h, d, p in zip(rows.h.tolist(), rows.doc.tolist(), rows.at.tolist()) for (g, e), q in first.items() if g == h and e < d)
    (x, y, px, py, _), _ = chaining.links(rows, False, side)
    assert sorted(zip(x.tolist(), y.tolist(), px.tolist(), py.tolist())) == [e for e in every if (e[0] % 3 == 0) != (e[1] % 3 == 0)]


def later_pairs(n_groups=3):
    """Per group: two documents that hold a passage's words only in pieces among others, then four with edited copies of it."""
    rows = []
    for k in range(n_groups):
        p = words(60, 7000 + k)
        pieces = [sum((p[i : i + 12] + words(40, 7100 + 10 * k + i + j) for i in range(0, 60, 8)), []) for j in (0, 100)]
        edited = [[f"new{k}x{j}x{i}" if i % 15 == 3 * j else w for i, w in enumerate(p)] for j in range(4)]
        rows += [(10 * k + j, " ".join(t)) for j, t in enumerate(pieces)]
        rows += [(10 * k + 2 + j, " ".join(words(30, 7500 + 10 * k + j) + e + words(30, 7700 + 10 * k + j))) for j, e in enumerate(edited)]
    return rows


def test_later_documents_are_compared_with_each_other(spark, monkeypatch):
    d = spark.createDataFrame(later_pairs(), "doc_id long, text string")

    def found():
        return sorted(tuple(r) for r in chaining.shared_passages(d).collect())

    once = found()
    pairs = {r[:2] for r in once}
    assert pairs >= {(10 * k + i, 10 * k + j) for k in range(3) for i in range(3, 6) for j in range(2, i)}
    for name, value in (("BLOCK_BYTES", 500), ("BLOCK_SEEDS", 50), ("LINKS", 30), ("SLICE_BYTES", 900)):  # many slices, blocks and chunks
        monkeypatch.setattr(chaining, name, value)
    assert found() == once


def test_pairs_that_cannot_chain_are_told_without_chaining(monkeypatch):
    r = np.random.default_rng(13)
    pair = np.sort(r.integers(0, 400, 1500))
    px, py, size = r.integers(0, 120, 1500), r.integers(0, 120, 1500), np.where(r.random(1500) < 0.02, 150, r.integers(5, 20, 1500))

    def made():
        which, length, (rx, ry, rn) = chaining.pair_chains(pair, px, py, size)
        ends = np.cumsum(length)
        return sorted((p, tuple(zip(rx[e - n : e].tolist(), ry[e - n : e].tolist(), rn[e - n : e].tolist()))) for p, n, e in zip(which.tolist(), length.tolist(), ends.tolist()))

    once = made()
    monkeypatch.setattr(chaining, "MANY_RUNS", 1)  # all are chained
    assert made() == once and any(len(c) > 1 for _, c in once) and any(len(c) == 1 for _, c in once)


def test_copies_and_clashing_columns(spark):
    p, q = words(70, 81), words(60, 82)
    rows = [(5, " ".join(p), 1), (9, " ".join(p), 1), (9, " ".join(p), 1), (7, " ".join(q + p[:55]), 2), (8, "short copy", 1), (3, "short copy", 1), (None, " ".join(p), 1), (4, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, other long")
    got = {(r.doc_id, r.other_id, r.start, r.stop) for r in chaining.shared_passages(d).collect()}
    assert got == {(9, 5, 0, 70), (7, 5, 60, 115)}


def test_gap_columns():
    a, b = np.array([1, 2, 3, 4]), np.array([1, 9, 3])
    assert chaining.gap_columns(a, b) == (4, 2) and chaining.gap_columns(a, a[:0]) == (4, 0) and chaining.gap_columns(a, a) == (4, 4)


def test_chain_scores_match_all_orders():
    xs, ys, n = np.array([0, 10, 12, 22]), np.array([0, 10, 40, 22]), np.array([8, 8, 8, 8])
    assert chaining.chains(xs, ys, n)[0] == [0, 1, 3]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
