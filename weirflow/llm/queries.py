"""The registered queries of the training-data operators.

Each applies its operator to its whole table with production parameters and
derives the digest columns of the result from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import ann, chat, decontaminate, hyperminhash, packing, quality, repair, resample, sharding, toxicity, warc
from weirflow.llm._labels import fold
from weirflow.llm._shared import new_folder
from weirflow.llm.simhash import near_duplicates
from weirflow.llm.substring import dedup_substrings

SPACE = r"[\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _held_out(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select(
        "doc_id", (fold("doc_id", modulus) == remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return _held_out(toxicity.score(docs, model), 5, 0)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L conv_id, i turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(i, r)")
    turns = turns.unionByName(probe).select("conv_id", "turn", "role", chat.as_parts(F.col("text")).alias("content"))
    chats = chat.format_chats(turns).select("conv_id", "formatted", chat.read_turns(F.col("formatted"), F.col("loss_mask")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.array_join(F.transform("turns", lambda t: t["trained"]), "")
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start_word", "n_words")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), by_word=True, keep_ids=False)
    return packing.pack(pieces)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold("doc_id", 3) != 1)
    return _held_out(quality.score(docs, model), 3, 1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = hyperminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = repair.marked(repair.damaged(turns, F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary"))))
    done = repair.edits(repair.faulty(rows))
    said = F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    texts = repair.repaired(rows, done).groupBy("conv_id").agg(F.sha2(F.array_join(said, "\n"), 256).alias("repaired_sha256"))
    found = repair.report(rows, done)
    out = turns.select("conv_id").distinct()
    for i, other in enumerate((found, texts)):
        out = out.join(other.withColumnRenamed("conv_id", f"__{i}"), F.col("conv_id").eqNullSafe(F.col(f"__{i}")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_minhash": op11_minhash,
    "op12_resample": op12_resample,
    "op13_repair": op13_repair,
}

#: The crc32 of each byte value, and of the bytes ``b`` of a row.
_STEPS = """SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY b) AS step
            FROM (SELECT unnest(range(256)) AS b)"""
_CRC = "xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1])))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CONTROL = r"(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\])"
ORACLE_SQL = {
    "op4_chat": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(8 + length(role) + 1 + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) + 7) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20),
        k AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS k FROM s),
        f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM k),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 20)))) AS gone FROM f WHERE n > 1 GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
            sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
                ELSE array_to_string([words[i] for i in range(1, len(words) + 1) if NOT list_contains(gone, i)], ' ') END) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id)""",
    "op11_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 3], ' ') AS s
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS pos FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.id),
        c AS (SELECT doc_id, min(id) AS component_id FROM reach GROUP BY doc_id)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op12_resample": rf"""
        WITH texts AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
        w AS (
            SELECT doc_id, side, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w
            FROM texts),
        steps AS ({_STEPS}),
        words AS (SELECT DISTINCT w FROM w),
        bytes AS (
            SELECT w, list_transform(range(octet_length(encode(w))),
                lambda i: CAST(16 * (instr('0123456789ABCDEF', hex(w)[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hex(w)[2 * i + 2]) - 1 AS BIGINT)) AS b FROM words),
        crc AS (
            SELECT w, {_CRC} % 10000 AS bucket
            FROM bytes, steps),
        f AS (SELECT side, doc_id, bucket FROM w JOIN crc USING (w)),
        n AS (SELECT range AS bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM range(10000) LEFT JOIN f ON f.bucket = range GROUP BY range),
        g AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
        d AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS total FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
        h AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(total / n_features) AS BIGINT), 0) AS weight,
                CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h
            FROM documents LEFT JOIN d USING (doc_id)),
        x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n // 10 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)""",
    "op13_repair": rf"""
        WITH RECURSIVE steps AS ({_STEPS}),
        src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS b FROM conversations),
        k AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM src, steps),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM k WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
        f AS (
            SELECT *, role[1] AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
                lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        m AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        v AS (
            SELECT conv_id, n AS i, {{'c': 0, 's': ''}} AS v0, {{'c': 4, 's': 'II'}} AS v1, {{'c': 2, 's': 'I'}} AS v2, {{'c': 0, 's': ''}} AS v3 FROM m
            UNION ALL
            SELECT conv_id, i - 1, least(n0, {{'c': 2 + n2.c, 's': 'I' || n2.s}}, {{'c': 4 + n3.c, 's': 'II' || n3.s}}), least(n1, {{'c': 2 + n2.c, 's': 'I' || n2.s}}, {{'c': 4 + n3.c, 's': 'II' || n3.s}}),
                least(n2, {{'c': 2 + n3.c, 's': 'I' || n3.s}}), least(n3, {{'c': 2 + n2.c, 's': 'I' || n2.s}})
            FROM (
                SELECT v.conv_id, v.i,
                    CASE WHEN gone THEN {{'c': 3 + v0.c, 's': 'D' || v0.s}} WHEN r = 's' THEN least({{'c': 3 + v0.c, 's': 'D' || v0.s}}, {{'c': x + v1.c, 's': 'K' || v1.s}}, {{'c': 2 + x + v2.c, 's': 'R' || v2.s}})
                        ELSE least({{'c': 3 + v0.c, 's': 'D' || v0.s}}, {{'c': CASE r WHEN 'u' THEN 0 ELSE 2 END + x + v2.c, 's': CASE r WHEN 'u' THEN 'K' ELSE 'R' END || v2.s}}) END AS n0,
                    CASE WHEN gone THEN {{'c': 3 + v1.c, 's': 'D' || v1.s}} ELSE least({{'c': 3 + v1.c, 's': 'D' || v1.s}}, {{'c': CASE r WHEN 'u' THEN 0 ELSE 2 END + x + v2.c, 's': CASE r WHEN 'u' THEN 'K' ELSE 'R' END || v2.s}}) END AS n1,
                    CASE WHEN gone THEN {{'c': 3 + v2.c, 's': 'D' || v2.s}} ELSE least({{'c': 3 + v2.c, 's': 'D' || v2.s}}, {{'c': CASE r WHEN 'a' THEN 0 ELSE 2 END + x + v3.c, 's': CASE r WHEN 'a' THEN 'K' ELSE 'R' END || v3.s}}) END AS n2,
                    CASE WHEN gone THEN {{'c': 3 + v3.c, 's': 'D' || v3.s}} ELSE least({{'c': 3 + v3.c, 's': 'D' || v3.s}}, {{'c': CASE r WHEN 'u' THEN 0 ELSE 2 END + x + v2.c, 's': CASE r WHEN 'u' THEN 'K' ELSE 'R' END || v2.s}}) END AS n3
                FROM v JOIN (SELECT conv_id, i, r, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS x FROM f) f ON f.conv_id = v.conv_id AND f.i = v.i)),
        best AS (SELECT conv_id, v0.c AS cost, v0.s AS audit FROM v WHERE i = 0),
        e AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best),
        l AS (SELECT conv_id, p, audit[p] AS e, p - len(replace(audit[1:p], 'I', '')) AS ins, len(replace(replace(audit[1:p], 'D', ''), ' ', '')) AS place, len(replace(audit, 'D', '')) AS size FROM e),
        t AS (
            SELECT l.conv_id, p, CASE WHEN e = 'K' THEN role WHEN (place + size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS said
            FROM l LEFT JOIN f ON f.conv_id = l.conv_id AND f.i = p - ins WHERE e <> 'D'),
        h AS (SELECT conv_id, sha256(string_agg(said, chr(10) ORDER BY p)) AS repaired_sha256 FROM t GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN h USING (conv_id)""",
}
