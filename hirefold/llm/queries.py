"""The registered queries of the corpus operators, and their SQL where SQL
can express them. Each runs its operator, with production parameters, over
the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hirefold.llm import (chat, common, decontaminate, exact, licenses, lines, mixing, quality, repair, simhash, substring,
                          tokens, toxicity, trie)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chat(turns)).drop("valid")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), lone_lines=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_chat, op3_licenses, op4_simhash, op5_decontaminate, op6_toxicity,
                                   op7_exact, op8_substrings, op9_mix, op10_lines, op11_tokens, op12_trie, op13_repair,
                                   pipeline)}

_WORD = r"[^\x20\x09-\x0D]+"

#: CRC-32 in SQL: its table of bytes, and the fold over a text.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS b))"""


def _crc(text: str) -> str:
    return (f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), "
            "lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)")


ORACLES = {
    "op2_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
                      ELSE 8 + length(role) + len(regexp_extract_all(role, '(\\|</turn>|### System:|### User:|### Assistant:|### \[|\]:)')) END
            + 8 + length(text) + len(regexp_extract_all(text, '(\\|</turn>|### System:|### User:|### Assistant:|### \[|\]:)')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op7_exact": """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
numbered AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t, doc_id) AS copy_no FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND copy_no = 1 AS kept, sha256(t) AS text_sha256 FROM numbered""",
    "op8_substrings": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT h, m, min(doc_id) AS first_doc FROM windows GROUP BY h, m),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (h, m) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)""",
    "op9_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS text_md5
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), 0) AS target
  FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_md5), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated""",
    "op12_trie": rf"""
WITH {_CRC_TABLE},
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
heads AS (
  SELECT s.conv_id, h, s.conv_id - s.conv_id % 100 AS base, least(h, coalesce(b.n, 0)) AS has
  FROM (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 6 AS h FROM sizes, crc_table) s
  LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 100),
rebuilt AS (
  SELECT h.conv_id, place AS depth, role, text FROM heads h JOIN placed p ON p.conv_id = base AND place <= h
  UNION ALL
  SELECT h.conv_id, has + place - h, role, text FROM heads h JOIN placed p ON p.conv_id = h.conv_id AND place > h
  UNION ALL SELECT conv_id, 0, '', '' FROM heads),
named AS (
  SELECT conv_id, depth, length(text) AS chars, max(depth) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name
  FROM rebuilt),
marks AS (
  SELECT conv_id, depth, chars, n_turns, min(conv_id) OVER (PARTITION BY depth, name) AS node, count(*) OVER (PARTITION BY depth, name) AS n_convs
  FROM named),
nodes AS (
  SELECT depth, node, max(n_convs) AS n_convs, (max(n_convs) - 1) * max(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n_turns), '')) AS ends_sha256
  FROM marks GROUP BY depth, node),
linked AS (
  SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN marks m ON m.conv_id = n.node AND m.depth = n.depth - 1),
counted AS (
  SELECT n.*, (SELECT count(*) FROM linked k WHERE k.parent = n.node AND k.depth = n.depth + 1) AS n_children FROM linked n),
totals AS (
  SELECT m.depth, m.node, sum(c.saved) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM counted c JOIN marks m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY m.depth, m.node)
SELECT c.node AS conv_id, c.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted c JOIN totals t ON t.depth = c.depth AND t.node = c.node""",
    "op13_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
         regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS ending
  FROM damaged),
said AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed),
inserts AS (
  SELECT * FROM (VALUES (0, 0, []::VARCHAR[]), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']), (1, 1, []), (1, 2, ['user:']),
                        (1, 3, ['user:', 'assistant:']), (2, 2, []), (2, 3, ['assistant:']), (2, 2, ['assistant:', 'user:']),
                        (3, 3, []), (3, 2, ['user:']), (3, 3, ['user:', 'assistant:'])) AS v(state, mid, put)),
moves AS (
  SELECT * FROM (VALUES (0, 's', 1, NULL::VARCHAR), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')) AS v(mid, initial, next, name)),
edits AS (
  SELECT s.state, s.put, 'D' AS edit, s.mid AS next, NULL::VARCHAR AS initial, NULL::VARCHAR AS name FROM inserts s
  UNION ALL SELECT s.state, s.put, 'K', next, initial, NULL::VARCHAR FROM inserts s JOIN moves m ON m.mid = s.mid
  UNION ALL SELECT s.state, s.put, 'R', next, NULL::VARCHAR, name FROM inserts s JOIN moves m ON m.mid = s.mid WHERE name IS NOT NULL),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS body FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, body FROM (
    SELECT r.conv_id, r.i, e.next AS state, w.audit || repeat('I', len(e.put)) || e.edit AS audit,
           w.cost + 5 * len(e.put) + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
             + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           w.body || e.put || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.name || ':' || r.text] END AS body
    FROM ways w JOIN said r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN edits e ON e.state = w.state
    WHERE (e.edit = 'D' OR r.fault IS NULL OR r.fault = 'truncated') AND (e.edit <> 'K' OR e.initial = r.role[1])) AS step
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1),
faults AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM said GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, w.cost + CASE w.state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
         w.audit || CASE w.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         w.body || CASE w.state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END AS body,
         f.* EXCLUDE (conv_id)
  FROM ways w LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(f.n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
       sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
