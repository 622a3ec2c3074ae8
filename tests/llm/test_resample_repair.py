import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weirflow.llm import repair, resample
from weirflow.llm._shared import new_folder
from weirflow.llm._words import PUNCTUATION, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text, max_n):
    words = WORD.findall(lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent=10, min_words=20, buckets=10_000, max_n=1):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in brute_features(text, max_n)[1]:
                side[of(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = {}
    for i, text in docs:
        n_words, fs = brute_features(text, max_n)
        weight = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((i for i, r in out.items() if r[0] >= min_words), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(order[: percent * len(order) // 100]):
        out[i][4] = k + 1
    return {i: tuple(r) for i, r in out.items()}


def some_docs(n=150, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéü9") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    docs = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "... --- !!!"), (n + 3, "x" * 500 + "-" + "日本語" * 40), (n + 4, "word, " * 30_000)]
    return docs, [" ".join(rng.choice(words[:30]) for _ in range(40)) for _ in range(20)] + [None]


@pytest.mark.parametrize(("max_n", "buckets"), [(1, 10_000), (3, 512)])
def test_resampling_against_brute_force(spark, max_n, buckets):
    docs, target = some_docs()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, score int, rank string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.doc_id: (r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(frame, goal, 30, 20, buckets, max_n).collect()}
    assert got == brute_resample(docs, target, 30, 20, buckets, max_n)


def test_resampling_of_nothing_nulls_and_repeats(spark):
    schema = "doc_id bigint, text string"
    none, goal = spark.createDataFrame([], schema), spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(none, goal).count() == 0
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(5, text), (5, text), (None, text), (7, text), (8, None)]
    got = resample.resample(spark.createDataFrame(rows, schema), goal.where("false"), percent=100).collect()
    assert sorted((str(r.doc_id), r["rank"]) for r in got if r["rank"] is None) == [("8", None), ("None", None)]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and next(r for r in got if r.doc_id is None).score is None


def test_matrix_blocks_hold_every_count(spark):
    docs, _ = some_docs(20)
    matrix = resample.write_matrix(spark.createDataFrame(docs, "doc_id bigint, text string"), new_folder(spark, "matrix"), 64)
    found = {}
    for r in matrix.collect():
        for k, i in enumerate(r.ids):
            a, b = r.bounds[k], r.bounds[k + 1]
            found[i] = dict(zip(r.buckets[a:b], r.counts[a:b]))
            assert list(r.buckets[a:b]) == sorted(r.buckets[a:b])
    for i, text in docs:
        want = {}
        for f in brute_features(text, 1)[1]:
            want[zlib.crc32(f.encode()) % 64] = want.get(zlib.crc32(f.encode()) % 64, 0) + 1
        assert found[i] == want
    sums = resample.column_sums(matrix, 64)
    assert sums.sum() == sum(len(brute_features(t, 1)[1]) for _, t in docs)


def test_a_row_group_of_the_matrix_is_a_few_blocks(spark):
    """A reader holds a row group's rows together: with all of a task's blocks in one, memory followed from the size of the split."""
    folder = new_folder(spark, "matrix")
    docs = spark.range(10, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 200000) AS text")
    assert resample.write_matrix(docs, folder).count() == 10
    groups = [pq.ParquetFile(f).metadata for f in Path(folder.removeprefix("file:")).glob("*.parquet")]
    assert sum(m.num_rows for m in groups) == 10
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 4


def test_crc_of_long_words_and_runs():
    texts = ["ab " + "q" * 100 + " é", "", "x"]
    words = split(pa.array(texts), lower=True, separator=PUNCTUATION)
    docs, crcs = resample.features(words, 3)
    want = [(d, zlib.crc32(f.encode())) for n in (1, 2, 3) for d, t in enumerate(texts) for f in brute_features(t, 3)[1] if f.count(" ") == n - 1]
    assert list(zip(docs.tolist(), crcs.tolist())) == want


GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def ordered(rows):
    """(turn, role, text) in the operator's order, nulls as spaces."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_edits(rows, faults, deepest=2):
    """All edits of a short conversation: the least (cost, audit) and the repaired rows."""
    best = None
    gap = [c for n in range(deepest + 1) for c in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    choices = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", r[1]), ("R", "user"), ("R", "assistant")] for r, f in zip(rows, faults)]
    for took in itertools.product(*choices):
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                out += [(names[c], "") for c in gaps[k]]
                audit, cost = audit + "I" * len(gaps[k]), cost + 2 * len(gaps[k])
                if k < len(rows):
                    edit, role = took[k]
                    audit += edit
                    cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and faults[k] == "truncated")
                    if edit != "D":
                        out.append((role, rows[k][2]))
            if GRAMMAR.match("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def forward(rows, faults):
    """The same for a long conversation: from the first row on, whole strings compared."""
    ways = {0: (0, "", [])}
    more = lambda now, to: now if to is None else min([now, to]) if now else to
    for row, fault in zip([*rows, None], [*faults, None]):
        for _ in range(2):
            for s, (c, a, o) in list(ways.items()):
                n = repair.INSERTS[s]
                ways[n] = more(ways.get(n), (c + 2, a + "I", o + [("user" if n == 2 else "assistant", "")]))
        if row is None:
            break
        then = {}
        for s, (c, a, o) in ways.items():
            then[s] = more(then.get(s), (c + 3, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            extra = int(fault == "truncated")
            for edit, role, cost in (("K", row[1], 0), ("R", "user", 2), ("R", "assistant", 2)):
                n = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                if n is not None and not (edit == "R" and role[:1] == row[1][:1]):
                    then[n] = more(then.get(n), (c + cost + extra, a + edit, o + [(role, row[2])]))
        ways = then
    return min(ways[s] for s in (0, 3) if s in ways)


def conversations(n=60, seed=0, most=3):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        rows = []
        for k in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice(["Yes.", "no", "Why? ", "", " \n", None, "x.\n\n", "Fine!", f"t{k}."])
            rows.append((rng.choice([k, k, k, k + 3, None]), role, text))
            if rng.random() < 0.2:
                rows.append(rows[-1])
        out[c] = rows
    return out


def run(spark, convs, schema="conv_id bigint, turn bigint, role string, text string, place string, edit int"):
    flat = [(c, *r, "z", 1) for c, rows in convs.items() for r in rows]
    random.Random(1).shuffle(flat)
    rows = repair.marked(spark.createDataFrame(flat, schema))
    done = repair.edits(repair.faulty(rows))
    fixed = {}
    for r in sorted(repair.repaired(rows, done).collect(), key=lambda r: r.place):
        fixed.setdefault(r.conv_id, []).append((r.role, r.text))
    return {r.conv_id: (r, fixed.get(r.conv_id, [])) for r in repair.report(rows, done).collect()}


def check(got, convs, edit):
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        rows = ordered(rows)
        faults = faults_of(rows)
        r, fixed = got[c]
        cost, audit, out = edit(rows, faults)
        assert (r.cost, r.audit, fixed) == (cost, audit, out), (c, rows)
        turns = [t for t, _, _ in rows if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def test_short_conversations_against_all_edits(spark):
    convs = conversations()
    convs[None] = [(1, "assistant", "hm."), (2, "user", "hm.")]
    got = run(spark, convs)
    few = {c: r for c, r in convs.items() if len(r) <= 3}
    check({c: got[c] for c in few}, few, brute_edits)
    check(got, convs, forward)


def test_a_conversation_over_all_partitions(spark):
    rng = random.Random(4)
    long = [(k, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Yes.", f"n{k}", f"t{k}.", "", f"q{k}?"])) for k in range(900)]
    convs = {5: long + long[10:200:7], 6: [(0, "user", "a."), (1, "assistant", "b.")], 4: [(0, "system", "s.")], 7: [(k, "user", f"{k}.") for k in range(300)]}
    got = run(spark, convs)
    check(got, convs, forward)
    rows = repair.marked(spark.createDataFrame([(5, *r) for r in long], "conv_id bigint, turn bigint, role string, text string"))
    places = [r.place >> 33 for r in repair.edits(repair.faulty(rows)).select("place").collect()]
    assert len(set(places)) > 1  # one conversation, several tasks


def test_copies_and_nothing(spark):
    convs = {"a": [(1, "user", "x.")] * 50 + [(2, "assistant", "y.")], "b": [(1, None, None)] * 3}
    got = run(spark, convs, "conv_id string, turn int, role string, text string, place string, edit int")
    check(got, convs, forward)
    assert got["a"][0].audit == "K" + "D" * 49 + "K" and got["b"][1] == []
    rows = repair.marked(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert repair.report(rows, repair.edits(repair.faulty(rows))).count() == 0
    with pytest.raises(ValueError):
        repair.Costs(delete=0)
