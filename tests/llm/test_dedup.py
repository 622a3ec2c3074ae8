import hashlib
import random
import time
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import _words, simhash, substring
from weirflow.llm._shared import without
from weirflow.llm.components import connected_components
from weirflow.llm.simhash import fingerprint_links, keep_first, link_lists, majority, near_duplicates
from weirflow.llm.substring import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@given(st.lists(st.text(alphabet="aZé \t\n\x0b\x1c ,", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_split_equals_the_pattern(texts):
    words = _words.split(pa.array(texts, pa.string()))
    found = [[] for _ in texts]
    for d, s, e in zip(words.doc, words.start, words.end):
        found[d].append(words.data[s:e].tobytes().decode())
    assert found == [WORD.findall(t) for t in texts]


def test_word_hashes_depend_on_the_word_only():
    long = "x" * 5000
    words = _words.split(pa.array([f"ab c {long}", f"c  ab\n{long}", "abc"]))
    h = _words.word_hashes(words)
    assert h[0] == h[4] and h[1] == h[3] and h[2] == h[5] and len({*h.tolist()}) == 4


def test_majority_counts_beyond_a_lane():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 1500, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.array([0, 600, 1, 0, 899])
    at = np.cumsum(counts) - counts
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[a : a + n]) > n) for a, n in zip(at, counts)]
    assert majority(hashes, counts).tolist() == want


def brute_components(prints, k=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= k:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_connect_dense_balls(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(120)}
    values |= {centres[0] ^ (m << 8) for m in range(200)} | {rng.getrandbits(64) for _ in range(50)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"))
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = brute_components({v: v & ((1 << 64) - 1) for v in signed})
    sizes = {}
    for v, r in want.items():
        sizes.setdefault(r, set()).add(v)
    for members in sizes.values():
        if len(members) > 1:
            assert len({got[v] for v in members}) == 1
        else:
            assert not members & got.keys()
    assert len(set(got.values())) == sum(len(m) > 1 for m in sizes.values())


def test_five_shared_positions_hold_one_key():
    for five in combinations(range(8), 5):
        assert sum(set(c) <= set(five) for c in simhash.PLANES) == 1
    a, b = np.array([0x1122334455667788], np.uint64), np.array([0x1122FF4455007789], np.uint64)
    assert simhash.shared_bytes(a ^ b).tolist() == [0b11011010]


def test_frequent_keys_are_dealt_by_a_fifth_byte(spark):
    rng = random.Random(2)
    values = {0x1122334400000000 | rng.getrandbits(32) for _ in range(3000)}
    values |= {v ^ (1 << rng.randrange(32)) for v in list(values)[:300]}
    df = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    roots = [{r.node: r.root for r in connected_components(fingerprint_links(df, sampled=s, frequent=f)).collect()} for s, f in ((1, 100), (1024, 1 << 30))]
    want = {v: r for v, r in brute_components({v: v for v in values}).items()}
    groups = [sorted(sorted(v for v in got if got[v] == r) for r in set(got.values())) for got in roots]
    grouped = {}
    for v, r in want.items():
        grouped.setdefault(r, []).append(v)
    assert groups[0] == groups[1] == sorted(sorted(g) for g in grouped.values() if len(g) > 1)


def test_long_lists_by_flipping_bits_equal_all_pairs():
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 1 << 24, 9000).astype(np.uint64))
    low = np.unique(np.concatenate([low, low[:500] ^ np.uint64(5)]))
    member, root = link_lists(np.zeros(len(low), np.int8), low, 3)
    near = {}
    for i in range(0, len(low), 500):
        for a, b in zip(*np.nonzero(np.bitwise_count(low[i : i + 500, None] ^ low[None]) <= 3)):
            near.setdefault(int(a) + i, []).append(int(b))
    label = list(range(len(low)))
    for a in sorted(near):
        stack = [a]
        while label[a] == a and stack:
            for y in near[stack.pop()]:
                if label[y] > a:
                    label[y] = a
                    stack.append(y)
    want = {i: r for i, r in enumerate(label) if r != i}
    assert dict(zip(member.tolist(), root.tolist())) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}


def test_few_links_need_no_rounds_and_give_the_same_groups(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)] + [(None, "n1"), ("é", "z")]
    links = spark.createDataFrame(edges, "u string, v string")
    tracker, found = spark.sparkContext.statusTracker(), []
    for few in (0, 1_000):
        spark.sparkContext.setJobGroup(f"components-{few}", "")
        found.append((sorted(map(tuple, connected_components(links, few).collect())), len(tracker.getJobIdsForGroup(f"components-{few}"))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0][0] == found[1][0] and ("é", "z") in found[0][0]
    assert found[1][1] <= 6 < found[0][1]
    assert connected_components(links.where("u = v")).collect() == []


def test_shuffle_files_go_with_their_query(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(disk.getAllFiles().mkString(",")).split(",") if "/shuffle_" in f}
    before = files()
    connected_components(spark.range(500).selectExpr("id AS u", "id DIV 7 AS v"), 0).count()
    end = time.monotonic() + 20  # files go in the background
    while files() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert files() <= before


def reference_print(text):
    words = (text or "").encode().translate(_words.LOWER).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_brute_force(spark):
    rng, words = random.Random(5), vocabulary(5)
    base = [prose(rng, words, rng.randint(30, 300)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 90):
        text = rng.choice(base).split()
        if rng.random() < 0.6:
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).upper() if rng.random() < 0.2 else "\n ".join(text)))
    rows += [(90, None), (91, ""), (92, " \t"), (93, "One"), (94, "one two"), (95, "ONE two"), (5, base[5]), (None, base[3])]
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", fingerprint int, component_id int")
    got = near_duplicates(extra).collect()
    assert len(got) == len(rows)
    prints = {i: reference_print(t) for i, t in rows if i is not None}
    want = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint & ((1 << 64) - 1), r.component_id) == (prints[r.doc_id], want[r.doc_id])
        else:
            assert r.component_id == want[3]
    kept = keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([*set(want.values()), *([5] if want[5] == 5 else [])])
    assert sum(r.doc_id is None for r in kept) == 1


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_substrings(rows, n):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (i, s))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if i is not None and first[tuple(w[s : s + n])] != (i, s):
                gone[s : s + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("n", [8, 20])
def test_substrings_against_brute_force(spark, n):
    rng, words = random.Random(n), vocabulary(n, 60)
    passages = [prose(rng, words, rng.randint(n - 2, 3 * n)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rng, words, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, words, rng.randint(0, 20))]
        rows.append((i * 7 % 120, rng.choice(["\n", " ", "\t  "]).join(parts)))
    rows += [(500, None), (501, ""), (502, "a " * 100), (503, "b"), (504, passages[0]), (504, passages[0]), (None, passages[1]), (505, " ".join([passages[2]] * 40) + " x" * 30000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], DOCS + ", start string")
    out = dedup_substrings(docs, n=n, gram=min(8, n - 2), max_bits=22).collect()
    squash = lambda t: " ".join(WORD.findall(t or ""))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, squash(r.text)) for r in out)
    assert got == sorted((str(i), *rest) for i, *rest in brute_substrings(rows, n))
    assert {r.start for r in out} == {"k"}
    texts = {r.doc_id: r.text for r in out if not r.n_removed}
    assert all(t == dict(rows)[i] for i, t in texts.items() if i is not None)


def test_substrings_with_clashing_columns_and_string_ids(spark):
    rng, words = random.Random(5), vocabulary(5, 60)
    shared = prose(rng, words, 30)
    rows = [(f"id-{i % 10}-{i:03}", f"{prose(rng, words, i % 20)} {shared if i % 4 == 0 else ''} {prose(rng, words, 5)}") for i in range(60)] + [(None, shared)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id string, text string, doc int, n_words int, N_removed int")
    out = dedup_substrings(docs).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "doc", "n_words", "n_removed"} and {r.doc for r in out} == {1}
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, " ".join(WORD.findall(r.text))) for r in out)
    assert got == sorted((str(i), *rest) for i, *rest in brute_substrings(rows, 20))


def test_share_of_windows_that_pass_does_not_grow_with_the_text(spark):
    rng = np.random.default_rng(6)
    share = []
    for docs in (50, 800):
        texts = [(i, " ".join(map(str, rng.integers(0, 1 << 40, 400)))) for i in range(docs)]
        df = spark.createDataFrame([*texts, (docs, texts[0][1])], "doc bigint, text string")
        bits = substring.sketch_bits(sum(len(t) for _, t in texts) // 3)  # as if words were shorter
        share.append(substring.repeated_cells(df, 20, 8, bits).count() / (docs * 57))
    assert share[0] < 1.2 / 50 + 0.03 and share[1] < 1.2 / 800 + 0.03


def test_substrings_of_nothing(spark):
    assert dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0


def test_query_digest(spark, tmp_path):
    from weirflow.llm.queries import op8_substring_dedup

    text = "Aé  b\tc " * 3
    spark.createDataFrame([(1, text), (2, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(" ".join(text.split()).encode()).hexdigest() and rows[1].n_words == 9
    assert rows[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and (rows[2].n_words, rows[2].n_removed) == (0, 0)


def test_many_ids_to_drop_are_joined(spark):
    docs = spark.createDataFrame([(i % 7 or None, f"t{i}") for i in range(40)], DOCS)
    ids = spark.createDataFrame([(1,), (3,), (None,)], "doc_id bigint")
    few, many = (sorted(map(str, without(docs, ids, sent_ids=n).collect())) for n in (10, 0))
    assert few == many == sorted(str(r) for r in docs.collect() if r.doc_id not in (1, 3))
