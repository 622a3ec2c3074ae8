"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
from tests.llm.test_pipeline import brute_kept
from weirflow.llm import hyperminhash, near


def test_stage_keeps_one_of_copies_of_similarity_eight_tenths(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", None, "one two", "ONE two", "three"]
    for _ in range(25):
        words = [word() for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(8):
            changed = list(words)
            for _ in range(max(1, int(len(words) * rng.uniform(0.005, 0.05)))):
                changed[rng.randrange(len(words))] = word()
            texts.append(" ".join(changed))
            words = changed if rng.random() < 0.3 else words  # chains
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(n, texts[o]) for n, o in enumerate(order)]
    docs = spark.createDataFrame([*rows, (None, texts[5])], "doc_id bigint, text string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(brute_kept(dict(rows)))
    assert sum(r.doc_id is None for r in out) == 1


def test_one_long_list_is_not_one_task(spark):
    rng = random.Random(9)
    line = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = [" ".join(line + [f"v{rng.randrange(9000)}" for _ in range(rng.choice([5, 8, 40]))]) for _ in range(260)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs, 5, long=16).collect()}
    assert {i for i, c in got.items() if i == c} == set(brute_kept(dict(rows)))
    assert near.near_copies(docs).select("component_id").distinct().count() == len(set(got.values()))


def test_the_byte_index_proposes_links_and_shingles_decide(spark, monkeypatch):
    """Without any list of the sketches, copies with near fingerprints are found; unlike texts with near fingerprints are not linked."""
    posted = hyperminhash._posted
    monkeypatch.setattr(hyperminhash, "_posted", lambda *a: posted(*a).where("false"))
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(2500))
    cycle = "ant bee cow dog elk " * 200
    texts = [long, long + " more", cycle, cycle + " ".join(f"v{i}" for i in range(12)), "something else"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.u: r.v for r in near._alike(docs, "doc_id", "text").collect()} == {0: 1, 2: 3}
    assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
