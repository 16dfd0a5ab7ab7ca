"""The registered queries of the operators and the SQL they match.

Each query applies its operator, with production parameters, to its whole table and derives
the digest columns of its contract from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    collocations,
    conversation_trie,
    decontaminate,
    near_duplicates,
    packing,
    planned_packing,
    quality_classifier,
    quality_rules,
    repeated_passages,
    sharding,
    tokens,
    warc,
)

QUERIES: dict = {}
SQL: dict = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    rows = quality_rules.ledger(docs, quality_rules.blocked_stems(docs, labels), repeated=quality_rules.repeated_stems(docs, labels))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.verdict("base")).alias("base_failed"),
        quality_rules.verdict("v3").alias("kept"),
        "failures",
    )


SQL["op9_quality_rules"] = r"""
WITH chosen AS (
  SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id
  ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 5000),
stems AS (
  SELECT stem, count(*) AS n, sum(toxic) AS hits FROM (
    SELECT DISTINCT doc_id, toxic, substr(w, 1, k) AS stem FROM (
      SELECT doc_id, toxic, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w
      FROM documents JOIN chosen USING (doc_id)) x, (VALUES (4), (5), (6)) ks(k) WHERE length(w) >= 4) y
  GROUP BY stem),
blocked AS (
  SELECT stem FROM stems, (SELECT sum(toxic) AS every FROM chosen) z
  WHERE hits >= greatest(3, 0.05 * every) AND hits >= 0.98 * n ORDER BY hits DESC, stem LIMIT 200),
begun AS (
  SELECT doc_id, lang, toxic, stem, count(*) AS k FROM (
    SELECT doc_id, lang, toxic, substr(w, 1, size) AS stem FROM (
      SELECT doc_id, coalesce(lang, '') AS lang, toxic, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w
      FROM documents JOIN chosen USING (doc_id)) x, (VALUES (4), (5), (6)) s(size) WHERE length(w) >= 4) y
  GROUP BY ALL),
every AS (SELECT coalesce(lang, '') AS lang, sum(toxic) AS every FROM documents JOIN chosen USING (doc_id) GROUP BY 1),
often AS (
  SELECT lang, stem, min(row(least, hits)) AS q FROM (
    SELECT lang, stem, least, count(*) AS n, sum(toxic) AS hits FROM begun, (VALUES (1), (2), (3)) s(least) WHERE least <= k GROUP BY ALL) z
  JOIN every USING (lang) WHERE every > 0 AND hits >= greatest(3, 0.2 * every) AND hits >= 0.9 * n GROUP BY ALL),
listed AS (SELECT lang, stem, q[1] AS least FROM often QUALIFY row_number() OVER (PARTITION BY lang ORDER BY q[2] DESC, stem) <= 200),
repeated AS (
  SELECT * FROM listed a WHERE NOT EXISTS (
    FROM listed b WHERE b.lang = a.lang AND b.stem <> a.stem AND starts_with(a.stem, b.stem) AND b.least <= a.least)),
d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1)
  GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id FROM (
    SELECT doc_id, unnest(string_split_regex(lower(t), '[^\p{L}]+')) AS w FROM d) JOIN blocked ON starts_with(w, stem)),
met AS (SELECT DISTINCT doc_id FROM (
    SELECT doc_id, stem FROM (SELECT doc_id, lang, unnest(string_split_regex(lower(t), '[^\p{L}]+')) AS w FROM d) JOIN repeated USING (lang)
    WHERE starts_with(w, stem) GROUP BY doc_id, stem, least HAVING count(*) >= least)),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    hit.doc_id IS NOT NULL AS is_hit, met.doc_id IS NOT NULL AS is_met
  FROM d LEFT JOIN again USING (doc_id) LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN met ON met.doc_id = d.doc_id),
l AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
    + 4 * CAST(word_chars < 2 * n_words AS BIGINT) + 8 * CAST(word_chars > 14 * n_words AS BIGINT)
    + 16 * CAST(100 * n_symbols > 10 * n_words AS BIGINT) + 32 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT)
    + 64 * CAST(is_hit AS BIGINT) + 128 * CAST(is_met AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
  failures = 0 AS kept, failures FROM l"""


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


@query("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    template = chat_format.Template()
    return chat_format.read_back(chat_format.segments(turns.unionByName(more), template), template)


SQL["op3_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, coalesce(lag(role) OVER w, '') AS state, lead(role) OVER w IS NULL AS last,
    length(replace(text, '\', '\\')) + len(regexp_extract_all(text,
      '<\|turn\|>|<\|text\|>|<\|end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + length(role) + length('<|turn|><|text|><|end|>') + 1) AS BIGINT) AS formatted_chars,
  CAST(sum(CAST((state, role) NOT IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'),
    ('assistant', 'user')) OR (last AND role <> 'assistant') AS BIGINT)) AS BIGINT) AS n_faults
FROM marked GROUP BY conv_id"""


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry_text=False)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = decontaminate.n_hit()
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


SQL["op5_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
its AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (
    SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
    FROM its WHERE len(ws) > 0)),
spots AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (
    SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
    FROM docs, (SELECT DISTINCT size FROM wins))),
found AS (SELECT doc_id, i, size, item_id FROM spots JOIN wins USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS names FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
  sha256(coalesce(ids.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang")
    return quality_classifier.classified(docs, table(spark, sf_dir, "labels"), F.col("source"), path)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def _base32_sql(digest: str) -> str:
    """Upper-case base32 of a SHA-1 in hex: 40 digits of 4 bits as 32 letters of 5 bits."""
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(CAST('0x' || substr({digest}, i, 1) AS INT)), 4)), '')"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    value = " + ".join(f"{16 >> k} * CAST(substr({bits}, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))
    return f"array_to_string(list_transform(range(0, 32), lambda i: substr({letters}, {value} + 1, 1)), '')"


SQL["op4_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
SELECT page_id, payload_bytes, {_base32_sql('hex')} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM p"""


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.removal_digests(table(spark, sf_dir, "documents"))


@query("op11_collocations")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (
    SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(size))),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 30),
cuts AS (
  SELECT lang, phrase, a, size, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k + 1:], ' ') AS q
  FROM cand, (VALUES (1), (2), (3)) s(k) WHERE k < size),
scored AS (
  SELECT c.*, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.p AND l.size = c.k
    JOIN f r ON r.lang = c.lang AND r.phrase = c.q AND r.size = c.size - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(ws[i:i + width - 1], ' ') AS phrase, max(a) AS above FROM (
    SELECT lang, ws, a, width, unnest(range(1, size - width + 2)) AS i FROM cand, (VALUES (2), (3)) s(width) WHERE width < size)
  GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN parts USING (lang, phrase)
  WHERE above IS NULL OR CAST(100 AS HUGEINT) * above < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000"""


@query("op12_planned_packing")
def op12_planned_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_conversation_trie")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    octets = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {step}), 4294967295)"


SQL["op13_conversation_trie"] = rf"""
WITH t AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT m.conv_id, 0 AS part, i, tid, words FROM m JOIN t ON t.conv_id = m.base AND i < h
  UNION ALL SELECT m.conv_id, 1, i, tid, words FROM m JOIN t ON t.conv_id = m.conv_id AND i >= h),
convs AS (
  SELECT m.conv_id, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws FROM m LEFT JOIN (
    SELECT conv_id, list(tid ORDER BY part, i) AS ks, list(words ORDER BY part, i) AS ws FROM turns GROUP BY conv_id) USING (conv_id)),
pre AS (
  SELECT conv_id, depth, len(ks) AS size, md5(array_to_string(ks[1:depth], ',')) AS p, md5(array_to_string(ks[1:depth - 1], ',')) AS up,
    CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS depth FROM convs)),
node AS (
  SELECT depth, p, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM pre GROUP BY depth, p),
kids AS (SELECT depth - 1 AS depth, up AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT a.depth, a.p, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * node.words) AS BIGINT) AS saved_tokens
  FROM node LEFT JOIN kids USING (depth, p) JOIN pre a ON a.conv_id = node.conv_id AND a.depth <= node.depth GROUP BY ALL)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sums USING (depth, p) LEFT JOIN kids USING (depth, p)
  LEFT JOIN node parent ON parent.depth = node.depth - 1 AND parent.p = node.up"""
