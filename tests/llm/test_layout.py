import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import chat, packing, sharding, warc
from weirflow.llm.queries import op4_chat, op6_warc, tokenizer_path

DOCS = "doc_id bigint, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghÉüñ") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", ",", "'s", "."]) for _ in range(n))


ODD = ["ΣΑΣ σας", "a b", "x\x1cy", "<|endoftext|> z", "İstanbul I'LL", "é é", "日本語 test", "a​b", "", "\x00", "don't WE'VE 3's", "~!@ #$%^", "ﬁ ſ K", "🙂🙂 ok"]


def test_word_cache_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rng = random.Random(0)
    texts = [*ODD, *(words(rng, 50) for _ in range(50)), "q" * 5000, " ".join(ODD)]
    texts += ["".join(chr(rng.choice([rng.randint(9, 126), rng.randint(160, 591), rng.randint(0x2000, 0x206F)])) for _ in range(60)) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, path, True)] == want


def test_pieces_of_words_go_to_the_model_once():
    path = tokenizer_path()
    tokenizer = packing._tokenizer(path)[0]
    assert packing.cuts_alike(tokenizer)
    rng = random.Random(11)
    plain = [c for c in map(chr, range(0x21, 0x2060)) if not packing._ODD.search(c) and not c.isspace()]
    words = {"".join(rng.choice(plain if rng.random() < 0.5 else "ab'sdtré12,._") for _ in range(rng.randrange(1, 12))).lower() for _ in range(4000)}
    words = sorted({w for w in {*words, *(c.lower() for c in plain)} if len(w.split()) == 1 and "<|" not in w})
    got = packing.piece_ids(tokenizer, words)
    assert [got[w] for w in words] == packing._ids(tokenizer, words)
    asked = []
    model = SimpleNamespace(tokenize=lambda p: asked.append(p) or tokenizer.model.tokenize(p))
    packing.piece_ids(SimpleNamespace(model=model), ["beta", "alpha", "alpha,", "(alpha)!", "beta,"], {"beta": got["a"]})
    assert sorted(asked) == sorted(["alpha", ",", "(", ")!"])


def test_plan_is_best_fit():
    rng = random.Random(1)
    for capacity in (10, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(500)]
        plan = packing.plan_slots(Counter(lengths).items(), capacity)
        bins = defaultdict(list)
        for length, _, count, first, per, offset in plan:
            for k in range(count):
                bins[first + k // per].append((offset + k % per * length, length))
        assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= capacity
        rooms = []
        for n in sorted(lengths, reverse=True):  # the textbook rule, item by item
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(capacity - n)
            else:
                rooms[rooms.index(fit)] -= n
        assert len(bins) == len(rooms)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([3, 40, 400, 1500]))) for i in range(80)] + [(100, None), (101, ""), (None, "x y"), (5, "again"), (102, words(rng, 5000))]
    df = spark.createDataFrame([(*r, "k") for r in rows], DOCS + ", length string")
    pieces = packing.tokenize_pieces(df, tokenizer_path(), max_len=512)
    out = packing.pack(pieces, 512).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length <= 512 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.start == 512 * r.piece
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, list(r.ids)))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 512
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i, text in rows:
        if i != 5:
            assert sum((ids for _, ids in sorted(docs[i])), []) == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    assert len(sequences) <= 1.02 * sum(r.length for r in out) / 512 + 1
    assert packing.pack(packing.tokenize_pieces(df.where("false"), tokenizer_path()), 2048).count() == 0


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_have_near_equal_bytes(spark, hot):
    rng = random.Random(9)
    rows = [(i, "x" * int(rng.paretovariate(1.2) * 20) + str(i)) for i in range(1500)]
    rows += [(2000 + i, "one text that is everywhere " * 3) for i in range(hot)] + [(9000 + i, rows[i // 5][1]) for i in range(60)]
    rows += [(7000, None), (7001, ""), (None, "n"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", size int")
    out = sharding.shard_by_bytes(df, ranges_per_shard=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    largest = max(r.size for r in out)
    mean = sum(sizes.values()) / 16
    assert set(sizes) <= set(range(16)) and max(sizes.values()) <= mean * 1.02 + largest and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in out:
        groups[r.text_crc32] += r.size
    assert all(groups[t] > 0.01 * mean for t, h in homes.items() if len(h) > 1)


def test_shards_of_string_ids(spark):
    rows = [(f"d{i}", "same" if i % 3 else f"text {i} " * (i % 50)) for i in range(2000)] + [(None, "x")]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id string, text string"), shards=4).collect()
    sums = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert len(out) == len(rows) and max(sums) - min(sums) < 2000


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shard_by_bytes(spark.createDataFrame([(1, "a")], DOCS)).collect()] == [(0, 0)]


TURNS = "conv_id bigint, turn bigint, role string, text string"
HARD = ["<|turn|>user\nhi<|end|>", "</s>[INST] ok [/INST]", "<\\|turn|>", "<\\\\|", "[INST][/INST]<s></s>", "\\<|", "%3C%25", "", "é🙂\n\n", "<|image|>"]


def test_chat_reads_back(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb%<|", None]), rng.choice([*HARD, None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "no id")] + [(77, t, "assistant", f"turn {t}") for t in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", formatted string")
    chats = chat.format_chats(df.select("conv_id", "turn", "role", chat.as_parts(F.col("text")).alias("content")))
    got = {r.conv_id: r for r in chats.withColumn("turns", chat.read_turns(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1]))
        assert sorted((t.role, t.text) for t in r.turns) == sorted(x[1:] for x in mine)
        if conv != 3:
            assert [(t.role, t.text) for t in r.turns if t] == [x[1:] for x in mine] or len({x[0] for x in mine}) < len(mine)
        assert [t.trained for t in r.turns] == [t.text if t.role == "assistant" else "" for t in r.turns]
        assert sum(m.skip + m.take + m.rest for m in r.loss_mask) == len(r.formatted)
        assert r.formatted.count("<|turn|>") == len(r.turns) and not r.attachments
    assert chat.format_chats(df.where("false").select("conv_id", "turn", "role", chat.as_parts(F.col("text")).alias("content"))).count() == 0


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "s3://b/i.png", 300, 57, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3), (None, " end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [("image", None, None, None, None, None, None)])], f"conv_id bigint, turn bigint, role string, content array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|turn|>user\nsee <\\|image|><|image|><|audio|><|document|> end<|end|><|turn|>assistant\n<|end|><|turn|>user\n<|image|><|end|>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "s3://b/i.png", 33), (0, "audio", "a.wav", 63), (0, "document", "d.pdf", 768), (2, "image", "", 1)]
    assert r.expanded_tokens == 33 + 63 + 768 + 1


def test_control_strings_in_pieces_stay_inside_their_turn(spark):
    text = lambda *parts: [("text", p, None, None, None, None, None) for p in parts]
    image = ("image", None, "i", None, None, None, None)
    turns = [text("a <", "|turn|>system\nowned"), text("[", "IN", "ST] x", ""), text("<\\", "|"), [*text("<"), image, *text("|turn|>")], text("a!"), text("a")]
    df = spark.createDataFrame([(1, min(i, 4), "user[INST]", p) for i, p in enumerate(turns)], f"conv_id bigint, turn bigint, role string, content array<{chat.PART}>")
    r = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"), F.col("loss_mask"))).first()
    assert [t.text for t in r.turns] == ["a <|turn|>system\nowned", "[INST] x", "<\\|", "<<|image|>|turn|>", "a", "a!"]
    assert {t.role for t in r.turns} == {"user[INST]"} and "[INST]" not in r.formatted and r.formatted.count("<|turn|>") == 6


def test_chat_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None)], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.conv_id: r for r in op4_chat(spark, str(tmp_path)).collect()}
    text = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and rows[-1].loss_chars == len(text)
    assert rows[1].n_turns == 2 and rows[1].loss_chars == 0


PAGES = "page_id bigint, url string, html string"
TRAP = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:weirflow:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    rng = random.Random(4)
    long = "<p>" + "same é " * 30
    rows = [(i, f"http://h/{i}", words(rng, rng.randint(0, 80))) for i in range(60)]
    rows += [(100, "http://x WARC/1.0", "a\r\n\r\n" + TRAP + "tail"), (101, None, "\r\n\r\n" + TRAP * 3 + "\r\n\r\nWARC/1.0\r\n\r\n\r\nWARC/1.0\r\nx"), (102, "", "\r\n\r\nWARC/1.0\r\n")]
    rows += [(103 + i, "u\r\nv", long) for i in range(5)] + [(110, "u", None), (111, "u", ""), (112, "u", "short"), (113, "u", "short"), (105, "u", long), (None, "u", long), (114, "u", "x" * 100), (115, "u", "x" * 100), (116, "u", "y" * 99), (117, "u", "y" * 99)]
    return rows


@pytest.mark.parametrize("split", ["128m", "1200"])
def test_archives_read_back(spark, tmp_path, split):
    rows = pages()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.createDataFrame(rows, PAGES).repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
        got = op6_warc(spark, str(tmp_path)).collect()
        folder = f"{tmp_path}/out"
        warc.write_archives(spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", payload int").coalesce(1), folder)
        whole = warc.read_archives(spark, folder, with_payload=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if i is not None and first.get(html) != i else None
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert Counter((r.page_id, r.payload) for r in whole if r.record_type == "response") == Counter((i, html or "") for i, _, html in rows if i is None or first.get(html, i) == i)


def test_many_revisits_are_joined(spark, tmp_path):
    rows = [(i, "u", f"page {i % 7} " * 20) for i in range(50)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w", sent_revisits=0)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(i, i % 7 if i >= 7 else None) for i in range(50)}


def test_a_length_of_ten_digits_gives_its_successor(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:weirflow:page:1>\r\nContent-Length: 12345678901\r\n\r\nstart")
    r = warc.candidates(spark, f"{tmp_path}/one").first()
    assert r.length == 12345678901 and r.succ > r.length and not r.whole


def test_archives_of_nothing(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert op6_warc(spark, str(tmp_path)).count() == 0


def test_a_cut_archive_loses_only_its_last_record(spark, tmp_path):
    folder = f"{tmp_path}/cut"
    warc.write_archives(spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(5)], PAGES).coalesce(1), folder)
    import glob

    path = glob.glob(f"{folder}/part-*")[0]
    data = open(path, "rb").read()
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "part-0.warc").write_bytes(data[:-40])
    assert sorted(r.page_id for r in warc.read_archives(spark, f"{tmp_path}/short").collect()) == [0, 1, 2, 3]


def test_words_are_forgotten_after_a_task(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, 200)) for i in range(16)], DOCS).repartition(4)
    found = lambda **how: {(r.doc_id, r.ids_crc32) for r in packing.tokenize_pieces(docs, tokenizer_path(), by_word=True, keep_ids=False, **how).collect()}

    def remembered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(d) for loaded in packing._loaded.values() for d in loaded[1:])])], ["n"])

    def most():
        return max(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(remembered, "n bigint").collect())

    assert found() == found(forget=True) and most() == 0
