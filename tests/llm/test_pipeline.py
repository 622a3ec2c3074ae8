"""Every stage of the pipeline against a brute-force version of it, on the whole smallest table."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import WORD, brute_substrings
from weirflow.llm import decontaminate, toxicity
from weirflow.llm._words import LOWER
from weirflow.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def brute_toxic(spark, docs):
    """The fitted model applied to one text at a time on the driver."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    filter_ = toxicity._filter(model.items)
    return {i: t for i, t in docs.items() if toxicity._scores(pa.array([t]), model, filter_)[1][0] < 0.5}


def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        words = (t or "").encode().translate(LOWER).split()
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    return [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def brute_kept(docs):
    """First ids of the components; ``docs`` maps ids to texts."""
    ids = sorted(docs)
    label = list(range(len(ids)))
    links, moved = brute_links([docs[i] for i in ids]), True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = least
    return {i: docs[i] for n, i in enumerate(ids) if label[n] == n}


def brute_cut(docs):
    out = {}
    for i, n, gone, kept in brute_substrings(list(docs.items()), 20):
        if not gone or gone < n:
            out[i] = kept
    return out


def brute_leaks(docs, items):
    cut = lambda t: t.encode().translate(LOWER).split()
    bags = {i: decontaminate._shingles(cut(t), 5) for i, t in items.items()}
    where = defaultdict(set)
    for i, bag in bags.items():
        for s in bag:
            where[s].add(i)
    clean = {}
    for d, text in docs.items():
        words, bad = cut(text), False
        near = defaultdict(list)
        for p in range(len(words) - 4):
            for i in where.get(tuple(words[p : p + 5]), ()):
                near[i].append(p)
        for i, ps in near.items():
            n = min(len(cut(items[i])), len(words))
            for s in range(max(0, min(ps) - n), min(len(words) - n, max(ps)) + 1):
                bad |= decontaminate.similarity(decontaminate._shingles(words[s : s + n], 5), bags[i]) >= 0.8
        if not bad:
            clean[d] = text
    return clean


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    squash = lambda t: " ".join(WORD.findall(t or ""))
    brute = {"toxicity": lambda d: brute_toxic(spark, d), "near_dedup": brute_kept, "substring_dedup": brute_cut, "decontamination": lambda d: brute_leaks(d, items)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        got, want = {r.doc_id: squash(r.text) for r in rows}, {i: squash(t) for i, t in brute[name](before).items()}
        assert got == want, name
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "toxicity":
            gone = before.keys() - got.keys()
            assert gone and sum(labels.get(i, 1) for i in gone) >= 0.9 * len(gone) and sum(labels.get(i, 0) for i in got) <= 4
        if name in ("near_dedup", "substring_dedup"):
            assert got != {i: squash(t) for i, t in before.items()}
        docs = spark.createDataFrame(rows, docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer, pieces, used = Tokenizer.from_file(tokenizer_path()), {}, defaultdict(list)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            pieces[i, k] = (len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packed} == pieces and len(packed) == len(pieces)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for s in used.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048


def test_run_writes_every_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert rows and max(used.values()) <= 2048


def test_stages_on_no_documents_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"label": F.lit("x"), "node": F.lit(1), "n_removed": F.lit(2), "__id": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.where("false"), SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
    few = docs.where("doc_id < 20")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, few, SF)
        assert out.columns == docs.columns and {(r.label, r.node, r.n_removed) for r in out.collect()} <= {("x", 1, 2)}, name
