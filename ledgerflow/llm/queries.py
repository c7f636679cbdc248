"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import audit, conversations, decontam, langid, licenses, neardup, packing, pii, quality, sharding, suffixes, topk, wrapper
from ledgerflow.llm.common import held_out, is_training, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, tokenizer=TOKENIZER)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE_KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), trusted)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, key="doc_id", text="text", language="lang", training=is_training("doc_id"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_langid": op4_langid,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_wrapper": op7_wrapper,
    "op8_decontam": op8_decontam,
    "op9_licenses": op9_licenses,
    "op10_shards": op10_shards,
    "op11_suffixes": op11_suffixes,
    "op12_conversations": op12_conversations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op5_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole AS q JOIN whole AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    # The checksum is computed byte by byte from a table of 256 steps.
    "op10_shards": """
        WITH steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS step
        ), sized AS (
            SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT)) AS bytes
            FROM documents
        ), summed AS (
            SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
                lambda c, b: xor(step[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
            FROM sized, steps
        ), placed AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM summed
        ), dealt AS (
            SELECT *, CAST((2 * upto - size) * 8 // (2 * total) AS INTEGER) AS shard FROM placed
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM dealt
    """,
    # Every window of every text, by its digest.
    "op11_suffixes": """
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), windows AS (
            SELECT r, i, md5(substring(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(len(h) // 2 - 399)) AS i FROM texts WHERE len(h) >= 800)
        ), again AS (
            SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY m) > 1
        ), fresh AS (
            SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM again
        ), runs AS (
            SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM fresh
        ), spans AS (
            SELECT r, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY r, run
        ), pieces AS (
            SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS p FROM spans
        ), cut AS (
            SELECT t.r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans,
                   string_agg(substring(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (s - p) AS BIGINT)), '' ORDER BY s) || substring(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS kept
            FROM pieces JOIN texts AS t ON pieces.r = t.r
            GROUP BY t.r
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM texts AS t LEFT JOIN cut AS c ON t.r = c.r
    """,
    # The cheapest audit that reaches each of the four states, row by row; an audit names its lines, so only the least is kept.
    "op12_conversations": r"""
        WITH RECURSIVE steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS step
        ), given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
                       lambda h: CAST('0x' || h AS UBIGINT)) AS bytes
            FROM conversations
        ), coded AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
                lambda c, b: xor(step[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::UBIGINT) % 20 AS code
            FROM given, steps
        ), worn AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                   CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM coded WHERE code <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth FROM worn
        ), told AS (
            SELECT *, left(role, 1) AS initial, CASE
                   WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                   left(lag(role) OVER (PARTITION BY conv_id ORDER BY nth), 1) AS earlier
            FROM placed
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(nth) AS n
            FROM told GROUP BY conv_id
        ), ways AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS nth, {'c': 0::BIGINT, 'a': '', 'l': ''} AS s0, {'c': 1000000000::BIGINT, 'a': '', 'l': ''} AS s1,
                   {'c': 3::BIGINT, 'a': 'I', 'l': 'user:' || chr(10)} AS s2, {'c': 6::BIGINT, 'a': 'II', 'l': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s3
            FROM counted
            UNION ALL
            SELECT conv_id, nth, s0, s1, p2, list_min([p3, {'c': p2.c + 3, 'a': p2.a || 'I', 'l': p2.l || 'assistant:' || chr(10)}])
            FROM (
                SELECT conv_id, nth, s0, s1, s3 AS p3, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I', 'l': s0.l || 'user:' || chr(10)},
                    {'c': s1.c + 3, 'a': s1.a || 'I', 'l': s1.l || 'user:' || chr(10)}, {'c': s3.c + 3, 'a': s3.a || 'I', 'l': s3.l || 'user:' || chr(10)}]) AS p2
                FROM (
                    SELECT w.conv_id, t.nth, {'c': s0.c + 4, 'a': s0.a || 'D', 'l': s0.l} AS s0,
                        list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 'l': s1.l}, {'c': s0.c + k + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 'l': s0.l || line}]) AS s1,
                        list_min([{'c': s2.c + 4, 'a': s2.a || 'D', 'l': s2.l}, list_min(list_transform([s0, s1, s3], lambda s: {'c': s.c + k + CASE WHEN initial = 'u' THEN 0 ELSE 3 END,
                            'a': s.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, 'l': s.l || CASE WHEN initial = 'u' THEN line ELSE 'user:' || text || chr(10) END}))]) AS s2,
                        list_min([{'c': s3.c + 4, 'a': s3.a || 'D', 'l': s3.l}, {'c': s2.c + k + CASE WHEN initial = 'a' THEN 0 ELSE 3 END,
                            'a': s2.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END, 'l': s2.l || CASE WHEN initial = 'a' THEN line ELSE 'assistant:' || text || chr(10) END}]) AS s3
                    FROM ways AS w JOIN (
                        SELECT conv_id, nth, initial, text, role || ':' || text || chr(10) AS line, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS k FROM told
                    ) AS t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.nth = w.nth + 1
                ) AS moved
            ) AS joined
        ), best AS (
            SELECT c.*, list_min([s0, s3]) AS way FROM ways AS w JOIN counted AS c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.nth = c.n
        )
        SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(way.c, 0) AS BIGINT) AS cost, coalesce(way.a, '') AS audit,
               sha256(coalesce(way.l[:-2], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN best AS b ON i.conv_id IS NOT DISTINCT FROM b.conv_id
    """,
    "op13_filter_audit": r"""
        WITH worded AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), marks AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
        ), failed AS (
            SELECT part, good, toxic,
                   CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
            FROM worded AS w LEFT JOIN marks AS m ON w.doc_id = m.doc_id
        ), counted AS (
            SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, bits
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
        ), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0) AS earlier
            FROM orders, range(1, 6) AS s(step)
        ), sums AS (
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
                   CAST(coalesce(sum(n) FILTER (bits & (earlier + bit) = 0), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (bits & earlier = 0 AND bits & bit <> 0), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (bits & earlier <> 0 AND bits & bit <> 0), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (bits = bit), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (bits & earlier = 0 AND bits & bit <> 0), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(toxic) FILTER (bits & earlier = 0 AND bits & bit <> 0), 0) AS BIGINT) AS toxic_lost
            FROM counted, steps
            GROUP BY part, filter_order, step, bit
        )
        SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM sums
    """,
}
