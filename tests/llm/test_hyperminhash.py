import random

import numpy as np
import pyarrow as pa
import pytest

from weirflow.llm import hyperminhash as hmh
from weirflow.llm._words import LOWER


def brute_sets(texts, n):
    out = []
    for t in texts:
        words = (t or "").encode().translate(LOWER).split()
        width = min(n, len(words))
        out.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    return out


def brute(rows, n=4, link_empty=False):
    """doc_id to (set size, component), all pairs compared; rows with a null id are left out."""
    rows = [(i, t) for i, t in rows if i is not None]
    sets = brute_sets([t for _, t in rows], n)
    label = [i for i, _ in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if (sets[a] or sets[b] or link_empty or rows[a][0] == rows[b][0]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = least
    return {rows[i][0]: (len(sets[i]), label[i]) for i in range(len(rows))}


def corpus(seed=0, groups=12, size=12):
    """Families of near copies around the threshold, chains, copies, and texts that share a long passage."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghiklmnor") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts, passage = [], some(120)
    for g in range(groups):
        text = some(rng.choice([5, 9, 20, 60, 150, 400]))
        for _ in range(size):
            if g % 3:  # a chain: every text is a change of the one before
                text = list(text)
                for _ in range(max(1, len(text) // 60)):
                    text[rng.randrange(len(text))] = rng.choice(words)
                texts.append(" ".join(text))
            else:
                copy = list(text)
                for _ in range(rng.randint(0, max(1, len(text) // 25))):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                texts.append((" ".join(copy)).title() if rng.random() < 0.3 else "\n".join(copy))
    texts += [" ".join(passage + some(rng.randint(10, 60))) for _ in range(40)]  # similar to each other, some above 0.8
    texts += [" ".join(some(rng.randint(1, 50))) for _ in range(60)] + texts[:20]
    texts += [None, "", " \t\n", None, "one", "One", "two words", "three little words", "THREE little words", "re " * 3000, "re " * 4000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def groups_of(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("long", [2048, 6])
def test_groups_against_brute_force(spark, long):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, node int, label string, n_shingles int")
    want = brute(rows)
    assert groups_of(hmh.near_duplicates(frame, long=long)) == want
    assert len({c for _, c in want.values()}) < len(want) - 60


def test_pairs_of_different_groups_are_found_without_leaders(spark):
    rows = corpus(1, groups=8, size=10)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert groups_of(hmh.near_duplicates(frame, rounds=0)) == brute(rows)
    assert groups_of(hmh.near_duplicates(frame, rounds=0, long=4)) == brute(rows)


def test_other_widths_and_string_ids(spark):
    rows = [(f"d{i:04}", t) for i, t in corpus(2, groups=6)]
    frame = spark.createDataFrame(rows, "id string, body string")
    for n, empty in ((5, True), (2, False)):
        assert groups_of(hmh.near_duplicates(frame, n, link_empty=empty, id_col="id", text_col="body")) == brute(rows, n, empty)


def test_null_ids_repeats_and_nothing(spark):
    schema = "doc_id bigint, text string"
    assert hmh.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert hmh.keep_first(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A B C D E"), (3, None), (4, ""), (None, None), (5, "x")]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in hmh.near_duplicates(frame).collect())
    assert got == [("3", 0, 3), ("4", 0, 4), ("5", 1, 5), ("7", 2, 7), ("7", 2, 7), ("9", 2, 7), ("None", 0, None), ("None", 2, None)]
    kept = hmh.keep_first(frame)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "4", "5", "7", "7", "None", "None"] and kept.columns == frame.columns
    linked = {r.doc_id: r.component_id for r in hmh.near_duplicates(frame, link_empty=True).collect()}
    assert linked[3] == linked[4] == 3


def test_an_id_with_two_texts_is_one_document(spark):
    rng = random.Random(5)
    a, b = ([f"{x}{rng.randint(0, 99)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1])), (4, " ".join(a[1:])), (5, " ".join(b[1:]))]
    for rounds in (0, 2):
        got = hmh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=rounds).collect()
        assert len(got) == 6 and all(r.component_id in (1, 2, 3) for r in got)


def test_registers_hold_zeros_and_mantissa():
    items = np.array([(5 << 57) | (0b00010110000000001 << 40), (5 << 57) | (1 << 56), (9 << 57)], np.uint64)
    out = hmh.sketches(np.sort(items), np.array([0, 3, 3]))
    assert out[0, 5] == (3 << 10 | 0b0110000000) and out[0, 9] == 62 << 10
    assert set(out[0].tolist()) == {int(out[0, 5]), int(out[0, 9])} and not out[1].any()


def test_estimates_are_corrected_for_collisions():
    rng = np.random.default_rng(3)
    for size in (3, 40, 1000, 200_000):
        counts, found = [], []
        for _ in range(3 if size > 10_000 else 150):
            a, b = (np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1)) for _ in range(2))
            s = hmh.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            counts.append(np.count_nonzero(s[0] == s[1]) / hmh.BUCKETS)
            shared = size * 8 // 9
            c = np.sort(np.concatenate([rng.permutation(a)[:shared], rng.permutation(b)[: size - shared]]))
            s = hmh.sketches(np.concatenate([a, c]), np.array([0, len(a), len(a) + len(c)]))
            j = len(np.intersect1d(a, c)) / len(np.union1d(a, c))
            found.append(hmh.estimate(np.array([np.count_nonzero(s[0] == s[1])]), np.array([len(a)]), np.array([len(c)]))[0] - j)
        assert abs(np.mean(counts) - hmh.chance(np.array([size]), np.array([size]))[0]) < 0.002
        assert abs(np.mean(found)) < 0.03 and np.min(found) > -6 * 0.0354


def test_sets_are_distinct_and_sorted():
    items, bounds = hmh.shingle_sets(pa.array(["a b c d a b c d", None, "A b", "a  B", "x"]), 4)
    assert np.diff(bounds).tolist() == [4, 0, 1, 1, 1] and items[bounds[2]] == items[bounds[3]]
    assert all((np.diff(items[a:b].astype(object)) > 0).all() for a, b in zip(bounds[:-1], bounds[1:]))


def test_rows_of_a_long_list_grow_with_its_blocks_alone(spark, monkeypatch):
    """Dealing a long list out by more bands made up to 32 * 32 rows of one, and looked at a pair in every list that it shares."""
    rng = random.Random(4)
    text, rows = [f"w{rng.randint(0, 9999)}" for _ in range(120)], []
    for i in range(120):
        copy = list(text)
        for at in rng.sample(range(len(copy)), 5):
            copy[at] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(copy)))
    sent, lists = [], hmh._lists
    monkeypatch.setattr(hmh, "_lists", lambda posted, *rest: sent.append(posted.count()) or lists(posted, *rest))
    got = groups_of(hmh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=0, long=16))
    assert got == brute(rows) and len({c for _, c in got.values()}) > 100
    assert max(sent) <= len(rows) * hmh.BANDS * 16  # at most: each row once for each of its list's 120 / 8 blocks
    pairs = len(rows) * (len(rows) - 1) // 2
    assert sent[1] <= 2 * pairs  # a pair brings its two rows to one task
