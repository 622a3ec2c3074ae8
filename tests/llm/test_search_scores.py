import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import ann, decontaminate, quality, toxicity
from weirflow.llm._labels import fold

VECTORS = "vec_id bigint, embedding array<float>"


def brute_nearest(rows, asked, k):
    out = {}
    for q in asked:
        x = np.array(dict(rows)[q], np.float32).astype(float)
        scored = sorted((-float(np.dot(x, np.array(v, np.float32).astype(float))), i) for i, v in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_hilbert_keys_walk_neighbouring_cells():
    n, bits = 3, 3
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << (n * bits)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_search_is_exact_where_windows_hold_everything(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).astype(float).tolist()) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 240)]  # copies
    odd = [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [float("nan")] * 6), (1004, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1005, [1.0, 2.0]), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], VECTORS + ", score double")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=5, curves=2, window=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, range(0, 240, 20), 5)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5]
        assert [x[1] for x in sorted(found)] == [i for i, _ in want[q]]
        assert np.allclose([x[2] for x in sorted(found)], [s for _, s in want[q]])


def test_search_recall_with_small_windows(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.standard_normal(16)).tolist()) for i in range(3000)]
    found = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, k=10, curves=8, window=150).collect()
    want = brute_nearest(rows, range(0, 3000, 50), 10)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in found)
    assert hits / (10 * len(want)) >= 0.9


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0])] + [(j, [1.0, float(j)]) for j in range(1, 301)] + [(j, [1.0, -float(j)]) for j in range(301, 340)]
    for options in ({}, {"recall": 1.0}, {"curves": 2, "window": 100}):
        found = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, **options).collect()
        assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, i, 1.0) for i in range(1, 21)]


def test_exact_mode_and_mixed_norms(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)  # many blocks, and several groups of queries in one
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * (30 if i % 300 == 0 else 1)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute_nearest(rows, range(0, 3000, 5), 6)
    found = ann.search(df, F.col("vec_id") % 5 == 0, k=6, recall=1.0).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in found} == {(q, n + 1, i) for q, best in want.items() for n, (i, _) in enumerate(best)}
    near = ann.search(df, F.col("vec_id") % 5 == 0, k=6, recall=0.95).collect()
    assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in near) / len(found) >= 0.9


def test_window_follows_the_sampled_neighbours():
    near, far = np.full((100, 12), 10), np.full((100, 12), 90_000)
    assert ann.choose(near, 1_000_000, 50_000, 0.98) == (1, 256)
    assert ann.choose(far, 1_000_000, 50_000, 0.98) == (1, 90_001)
    assert ann.choose(np.where(np.arange(12) < 3, far, near), 1_000_000, 50_000, 0.98)[0] == 4
    assert ann.choose(near, 1000, 50, 1.0) == (1, 1000)


def test_search_of_nothing_and_of_few(spark):
    assert ann.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], VECTORS), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in few) == [(0, 1, 2.0), (1, 0, 2.0)]


def labelled(spark, n=600, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnr") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic, bad = rng.random() < 0.2, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "vorgast", "vorgalin", "Krumpf!"]))
        if bad:
            text = [w + rng.choice(["%%%", "&&&", " |"]) for w in text]
        docs.append((i, " ".join(text)))
        if rng.random() < 0.8:
            labels.append((i, int(not bad), int(toxic)))
        truth.setdefault(seed, {})[i] = (int(not bad), int(toxic))
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (None, "idiot"), (0, docs[0][1])]
    labels += [(n + 3, 1, 1), (None, 0, 1), (5, None, None)]
    return (
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, y string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


truth = {}


@pytest.mark.parametrize(("module", "modulus", "rest", "place"), [(toxicity, 5, 0, 1), (quality, 3, 1, 0)])
def test_scores_of_held_out_documents(spark, module, modulus, rest, place):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels, fold("doc_id", modulus) != rest)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    right = [(r.score >= 0.5) == bool(truth[0][r.doc_id][place]) for r in rows if r.doc_id in truth[0] and zlib.crc32(str(r.doc_id).encode()) % modulus == rest]
    assert len(right) > 50 and np.mean(right) > 0.95


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_without_labels(spark, module, label):
    docs, labels = labelled(spark, 30)
    one = module.score(docs, module.fit(docs, labels.where("false"), F.lit(True))).collect()
    assert len({r.score for r in one}) == 1
    only = module.score(docs, module.fit(docs, labels.where(f"{label} = 1"), F.lit(True))).collect()
    assert all(r.score > 0.9 for r in only)
    assert module.score(docs.where("false"), module.fit(docs, labels, F.lit(True))).count() == 0
    assert module.score(docs.where("false"), module.fit(docs.where("false"), labels, F.lit(True))).count() == 0


def test_toxic_documents_go(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, F.lit(True))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    scores = [(str(r.doc_id), r.score) for r in toxicity.score(docs, model).collect()]
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(i for i, s in scores if s < 0.5)
    assert any(s >= 0.5 for _, s in scores)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_silence_scores_the_toxic_share(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    used = labels.where(fold("doc_id", 5) != 0)
    share = used.where("toxic = 1").count() / used.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "qwxyz vvkkzz " * 200_000), (5, "12 34"), (5, "12 34")], "doc_id bigint, text string")
    assert {round(r.score, 12) for r in toxicity.score(odd, model).collect()} == {round(share, 12)} and share < 0.5
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.01 * len(clean) + 1


def test_equal_votes_have_equal_targets_and_repeated_labels_change_nothing(spark):
    posterior, label = np.array([0.9, 0.9, 1e-4, 1e-4, 0.5, 0.2]), np.array([1.0, 0, 1, 0, 1, 0])
    out = toxicity.tempered(posterior, label, np.ones(6))
    assert out[0] == out[1] and out[2] == out[3] < out[0]
    docs, labels = labelled(spark)
    a, b = (toxicity.fit(docs, x, F.lit(True)) for x in (labels, labels.unionByName(labels)))
    assert np.array_equal(a.items, b.items) and np.allclose(a.weights, b.weights) and a.slope == b.slope
    a, b = (quality.fit(docs, x, F.lit(True)) for x in (labels, labels.unionByName(labels)))
    assert a.weights == b.weights


def test_patterns_vote():
    texts = pa.array(["you are an idiot", "idiot", "I will kill you", "an 1d10t walks", "you walk, they say idiot", "kill time", None, "1984"])
    words = toxicity._tokens(texts)
    found = toxicity._patterns(words, toxicity.word_hashes(words))
    assert [f.tolist() for f in found] == [[], [2], [3]]
    close = pa.array(["You idiot!", "idiot, you", "you utter moron", "x", "you a b idiot"])
    words = toxicity._tokens(close)
    assert toxicity._patterns(words, toxicity.word_hashes(words))[0].tolist() == [0, 1, 2]


def test_label_model_weighs_accurate_voters_more():
    rng = np.random.default_rng(0)
    y = rng.random(40000) < 0.1
    votes = np.stack([np.where(y, rng.random(40000) < a, rng.random(40000) < b) for a, b in ((0.8, 0.001), (0.6, 0.001), (0.5, 0.01), (0.3, 0.1))], axis=1)
    votes = np.column_stack([votes, votes[:, 1]]).astype(float)  # the last says what the second says
    m = toxicity.label_model(len(y), votes.T @ votes, 0.1)
    weights, bias = m.weights, m.bias
    assert weights[0] > weights[2] > weights[3] > 0 and weights[4] < weights[0]
    posterior = 1 / (1 + np.exp(-(votes @ weights + bias)))
    assert np.mean((posterior > 0.5) == y) > 0.96


def test_label_model_finds_planted_accuracies_and_correlations():
    rng, n = np.random.default_rng(1), 200_000
    y = rng.random(n) < 0.15
    told = [(0.8, 0.01), (0.6, 0.02), (0.5, 0.05), (0.4, 0.002), (0.7, 0.1), (0.3, 0.02)]
    votes = [np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in told]
    votes.append(np.where(rng.random(n) < 0.7, votes[2], np.where(y, rng.random(n) < 0.5, rng.random(n) < 0.05)))  # mostly what the third says
    votes += [np.zeros(n, bool), np.ones(n, bool), rng.random(n) < 0.2]  # say nothing
    votes = np.stack(votes, axis=1).astype(float)
    m = toxicity.label_model(n, votes.T @ votes, 0.15)
    want = np.array([*told, told[2]])
    assert np.allclose(m.if_toxic[:7], want[:, 0], atol=0.03) and np.allclose(m.if_clean[:7], want[:, 1], atol=0.01)
    found = {(int(i), int(j)): float(m.correlation[i, j]) for i, j in zip(*np.nonzero(np.triu(m.correlation)))}
    rest = votes[~y][:, [2, 6]]
    assert found.keys() == {(2, 6)} and abs(found[2, 6] - 0.7 * np.corrcoef(rest.T)[0, 1]) < 0.25
    assert np.abs(m.weights[7:]).max() < 0.1


def test_shapes_and_lists_vote(spark):
    texts = pa.array(["so SHOUTY", "ab", "!!", "soooo", "you you", "x! !", None, "aa AAA", "a\n" * 3])
    words = toxicity._tokens(texts)
    assert [f.tolist() for f in toxicity._shapes(texts, words, toxicity.word_hashes(words))] == [[0], [2], [3, 7], [4, 8]]
    docs, labels = labelled(spark)
    m = toxicity.fit(docs, labels, F.lit(True))
    assert set(m.voters) >= {0, 1} and m.votes.if_toxic[: toxicity.LEXICONS].max() > 0.2


LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute_matches(docs, items, n=5, threshold=0.8):
    cut = lambda t: (t or "").encode().translate(LOW).split()
    out = {}
    for d, text in docs:
        w = cut(text)
        for i, item in items:
            v = cut(item)
            span = min(len(v), len(w))
            if not span:
                continue
            bag = decontaminate._shingles(v, n)
            best = max(decontaminate.similarity(decontaminate._shingles(w[s : s + span], n), bag) for s in range(len(w) - span + 1))
            if best >= threshold:
                out[d, i] = best
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeghiklmnor") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 45)))) for i in range(30)]
    items += [(50, "just three words"), (51, ""), (52, None), (53, "solo"), (54, "re re re re re re re re re re re re")]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.5:
            part = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                part[rng.randrange(len(part))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = part[: len(part) - rng.choice([0, 0, 0, 2])]
        docs.append((i, " ".join(text).title() if rng.random() < 0.3 else "\n".join(text)))
    docs += [(200, None), (201, ""), (202, items[3][1].upper()), (203, "say just Three words now"), (204, "re " * 40), (205, items[4][1] + " " + items[5][1])]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, bench).collect()}
    want = brute_matches(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 20
    sliced = decontaminate.contaminated(frame, bench, slice_items=7)
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == want.keys()
    kept = decontaminate.remove_contaminated(frame, bench).collect()
    assert sorted(r.doc_id for r in kept) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_a_long_text_that_repeats_one_item_and_a_large_benchmark(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeghiklmnor") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))) for i in range(3000)]
    near = items[1][1].split()
    near[len(near) // 2] = "zz"
    docs = [(1, " ".join([items[0][1]] * 3000)), (2, " ".join(rng.choice(words) for _ in range(5000)) + " " + " ".join(near)), (3, " ".join(t for _, t in items[10:40]))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert "Union" not in found._jdf.queryExecution().toString()  # one scan
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    small = [(2, docs[1][1]), (3, docs[2][1])]
    assert got[1, 0] == 1.0 and {k: v for k, v in got.items() if k[0] > 1} == pytest.approx(brute_matches(small, items[:60]))


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    some = spark.createDataFrame([(1, "one two three four five six"), (None, "a one two three four five six"), (1, "one two three four five six")], "doc_id bigint, text string")
    assert decontaminate.contaminated(some, bench.where("false")).count() == 0
    assert decontaminate.contaminated(some, bench).count() == 3
    assert [r.doc_id for r in decontaminate.remove_contaminated(some, bench).collect()] == [None]


def test_one_long_text_leaves_the_dictionaries_as_they_are(spark):
    docs, labels = labelled(spark)
    plain = quality.fit(docs, labels, F.lit(True), dictionary_bytes=1 << 18)
    long = spark.createDataFrame([(10_000 + i, "word " * 200_000, "x") for i in range(40)], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, 0) for i in range(40)], labels.schema))
    model = quality.fit(docs.unionByName(long), more, F.lit(True), dictionary_bytes=1 << 18)
    assert len(model.good) > len(plain.good) // 2 and len(model.bad) > len(plain.bad) // 2
    rows = quality.score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == bool(truth[0][r.doc_id][0]) for r in rows if r.doc_id in truth[0]]) > 0.95
