"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.exact_dedup import scratch_index

    index = scratch_index(spark)
    out = index.add(table(spark, sf_dir, "documents"), "documents")
    index.drop()
    return out


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight, (3.0::DOUBLE * source_size) / [5, 2, 1][(k - 1) % 3 + 1] AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT *, max(CASE WHEN ratio >= level THEN level END) OVER () AS lvl FROM l
), t AS (
  SELECT source, source_size, CASE WHEN lvl IS NULL OR ratio <= lvl THEN 3.0::DOUBLE * source_size ELSE weight * lvl END AS target FROM f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), p AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS place
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN place <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""

def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.decontaminate import find

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return find(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.ctw import score

    away = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, ~away).select("doc_id", away.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.chat import rotate

    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["length"])), ",")
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["length"])
    return rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), F.length("text").cast("long").alias("n_chars"),
        masked.alias("n_masked"), spans.alias("mask"), F.sha2("text", 256).alias("text_sha256"),
    )


OP1_SQL = r"""
WITH s AS (
  SELECT DISTINCT conv_id, turn, replace(replace(replace(coalesce(role, ''), '<|', '< |'), chr(10), ' '), chr(13), ' ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM s WHERE role <> 'system'
), b AS (
  SELECT *, floor(turn / 64.0) AS block, (row_number() OVER (PARTITION BY conv_id, floor(turn / 64.0) ORDER BY turn, role, md5(text)) - 1) // 256 AS piece FROM s
), k AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY block, piece) - 1 AS part FROM b
), r AS (
  SELECT k.*, perspective, role = perspective AS mine,
         '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, md5(text)) - length(body) AS place FROM r
)
SELECT conv_id, perspective, part, count(*) AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars, sum(CASE WHEN mine THEN length(body) ELSE 0 END)::BIGINT AS n_masked,
       coalesce(string_agg(CASE WHEN mine THEN place::BIGINT || ':' || length(body) END, ',' ORDER BY turn, role, md5(text)), '') AS mask,
       sha256(string_agg(head || body, '' ORDER BY turn, role, md5(text))) AS text_sha256
FROM o GROUP BY conv_id, perspective, part
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.lines import remove

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.common import scratch
    from barloom.llm.warc import Archive

    archive = Archive(spark, scratch(spark, "warc"))
    archive.write(table(spark, sf_dir, "pages"))
    return archive.read().select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS b, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, chr(13) || chr(10) AS e FROM q),
w AS (
  SELECT *, 'WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || e
    || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || e
    || CASE WHEN refers_to IS NULL THEN '' ELSE 'WARC-Refers-To: <urn:page:' || refers_to || '>' || e || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e END
    || 'WARC-Payload-Digest: sha1:' || h || e || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || CASE WHEN refers_to IS NULL THEN n ELSE 0 END || e || e
    || CASE WHEN refers_to IS NULL THEN b ELSE '' END || e || e AS record FROM r
)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, strlen(record) AS record_bytes, sha256(record) AS record_sha256
FROM w
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.substring import remove

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs, digest_only=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.trie import shared_prefixes

    return shared_prefixes(table(spark, sf_dir, "conversations"))


#: DuckDB has no CRC-32: its bits, of a string of ASCII.
CRC32_SQL = r"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

OP11_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id IS NULL AS gone, coalesce(conv_id, 0) AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), k AS (
  SELECT *, {CRC32_SQL.format("name")} % 20 AS kind FROM c
), d AS (
  SELECT gone, conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY gone, conv ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), w) AS i, left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS r
  FROM (SELECT *, md5(length(role) || ':' || role || ':' || text) AS w FROM d)
), f AS (
  SELECT gone, conv, turn, role, text, i, ini, coalesce(lag(ini) OVER (PARTITION BY gone, conv ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad,
         CASE WHEN r = '' THEN 'b' WHEN row_number() OVER (PARTITION BY gone, conv, w ORDER BY i) > 1 THEN 'd' WHEN right(r, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM n
), s AS (
  SELECT gone, conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM f GROUP BY gone, conv
), ins(a, b, price, edits, lines) AS (
  SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'),
    (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:'))
), own(a, b, ini, edit, price, says) AS (
  SELECT * FROM (VALUES (0, 0, '', 'D', 2, ''), (1, 1, '', 'D', 2, ''), (2, 2, '', 'D', 2, ''), (3, 3, '', 'D', 2, ''), (0, 1, 's', 'K', 0, ''), (0, 2, 'u', 'K', 0, ''), (1, 2, 'u', 'K', 0, ''), (2, 3, 'a', 'K', 0, ''), (3, 2, 'u', 'K', 0, ''),
    (0, 2, '', 'R', 1, 'user'), (1, 2, '', 'R', 1, 'user'), (2, 3, '', 'R', 1, 'assistant'), (3, 2, '', 'R', 1, 'user'))
), g(gone, conv, i, st, best) AS (
  SELECT s.gone, s.conv, 0::BIGINT, ins.b, {{'cost': ins.price, 'audit': ins.edits, 'said': ins.lines}} FROM s, ins WHERE ins.a = 0
  UNION ALL
  SELECT g.gone, g.conv, g.i + 1, ins.b, min({{
    'cost': g.best.cost + own.price + CASE WHEN fault = 't' AND edit <> 'D' THEN 5 ELSE 0 END + ins.price, 'audit': g.best.audit || edit || ins.edits,
    'said': g.best.said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || says || ':' || f.text END || ins.lines}})
  FROM g JOIN f ON f.gone = g.gone AND f.conv = g.conv AND f.i = g.i + 1
  JOIN own ON own.a = g.st AND (edit <> 'K' OR own.ini = f.ini) AND (edit = 'D' OR fault NOT IN ('b', 'd')) JOIN ins ON ins.a = own.b
  GROUP BY g.gone, g.conv, g.i, ins.b
), e AS (
  SELECT g.gone, g.conv, min(best) AS best FROM g JOIN s ON s.gone = g.gone AND s.conv = g.conv AND s.n = g.i WHERE st IN (0, 3) GROUP BY g.gone, g.conv
)
SELECT CASE WHEN NOT a.gone THEN a.conv END AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT gone, conv FROM c) AS a LEFT JOIN s ON s.gone = a.gone AND s.conv = a.conv LEFT JOIN e ON e.gone = a.gone AND e.conv = a.conv
"""


OP12_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), w) - 1 AS pos, w, length(text) AS n FROM (SELECT *, md5(length(role) || ':' || role || ':' || text) AS w FROM c)
), h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32_SQL.format("t")} % 6 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS t FROM s)
), b AS (
  SELECT h.conv_id, 0 AS own, pos, w, n FROM h JOIN s ON s.conv_id = h.base AND pos < h.h
  UNION ALL SELECT conv_id, 1 AS own, pos, w, n FROM h JOIN s USING (conv_id) WHERE pos >= h.h
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d, w, n FROM b
), v AS (
  SELECT conv_id, d, md5(string_agg(w, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, n FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM h
), e AS (
  SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM v) WHERE d = last GROUP BY k
), m AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n FROM v GROUP BY k, d
), p AS (
  SELECT m.*, v.k AS pk FROM m LEFT JOIN v ON v.conv_id = m.conv_id AND v.d = m.d - 1
), g AS (
  SELECT pk AS k, count(*) AS n_children FROM p WHERE pk IS NOT NULL GROUP BY pk
), t AS (
  SELECT v.k, count(*) FILTER (WHERE g.k IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.n) AS saved_tokens FROM m JOIN v ON v.conv_id = m.conv_id AND v.d <= m.d LEFT JOIN g ON g.k = m.k GROUP BY v.k
)
SELECT p.conv_id, p.d::BIGINT AS depth, q.conv_id AS parent_conv_id, p.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM p JOIN t ON t.k = p.k LEFT JOIN m AS q ON q.k = p.pk LEFT JOIN g ON g.k = p.k LEFT JOIN e ON e.k = p.k
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


QUERIES = {
    "op1_chat": op1_chat, "op2_line_dedup": op2_line_dedup, "op3_exact_dedup": op3_exact_dedup, "op4_quality": op4_quality, "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc, "op7_mixing": op7_mixing, "op8_substring_dedup": op8_substring_dedup, "op9_simhash": op9_simhash, "op10_ctw": op10_ctw,
    "op11_conversation_repair": op11_conversation_repair, "op12_prefix_trie": op12_prefix_trie, "op13_packing": op13_packing,
}
ORACLES = {"op1_chat": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op6_warc": OP6_SQL, "op7_mixing": OP7_SQL, "op11_conversation_repair": OP11_SQL, "op12_prefix_trie": OP12_SQL}
