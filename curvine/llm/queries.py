"""One query per operator over the given tables, with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvine.llm import chat, circulant, decontam, packing, periods, quality, repetition, secret_scan, shards, simhash, suffix_tree, token_files, variants
from curvine.llm.common import table
from curvine.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(ship(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


_CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, length(replace(replace(text, '\', '\e'), '<', '\l')) AS chars, length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS goes_on
  FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN goes_on THEN length('<next>') ELSE length('<turn >') + role_chars + length('</turn>') + 1 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op3_chat", _CHAT_SQL)
def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(fixed)))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_suffix_tree")
def op5_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents"))


_LEAK_SQL = r"""
WITH lower_case AS (
  SELECT row_number() OVER () AS r, doc_id, NULL AS item_id, coalesce(text, '') AS text FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), words AS (
  SELECT r, doc_id, item_id, list_filter(string_split(regexp_replace(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D]', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM lower_case
), items AS (SELECT *, least(len(w), 5) AS width FROM words WHERE r < 0 AND len(w) > 0),
item_parts AS (
  SELECT DISTINCT r, item_id, width, w[i:i + width - 1] AS part FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM items)
), doc_parts AS (
  SELECT DISTINCT r, doc_id, width, w[i:i + width - 1] AS part FROM (
    SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM words, (SELECT DISTINCT width FROM items) WHERE r > 0)
), sizes AS (SELECT r, count(*) AS shingles FROM item_parts GROUP BY r)
SELECT d.doc_id, i.item_id, s.shingles::INTEGER AS shingles, count(*)::INTEGER AS found
FROM item_parts i JOIN doc_parts d ON d.width = i.width AND d.part = i.part JOIN sizes s ON s.r = i.r
GROUP BY d.r, d.doc_id, i.r, i.item_id, s.shingles HAVING count(*) >= 0.8 * s.shingles - 1e-9
"""


@query("op6_decontamination", _LEAK_SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id", "shingles", "found")


@query("op7_secrets")
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.count_tokens(table(spark, folder, "documents"))


@query("op9_shards")
def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_documents(table(spark, folder, "documents"))


@query("op10_repetition")
def op10_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.quality_rules(table(spark, folder, "documents"))


# crc32 bit by bit: the table of one byte, then a fold over the bytes; the runs' code points lie below 256.
_VARIANT_SQL = r"""
WITH RECURSIVE bits AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), runs AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL
), coded AS (
  SELECT *, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END)) AS bytes
  FROM runs
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM coded, bits
), words AS MATERIALIZED (
  SELECT w AS word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2
), cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word)
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM near GROUP BY word
), forms AS MATERIALIZED (SELECT word, form, form_n FROM best WHERE form_n >= 10 * n
), ahead AS (
  SELECT word, form AS root FROM forms
  UNION ALL SELECT a.word, f.form FROM ahead a JOIN forms f ON f.word = a.root
)
SELECT w.word, w.n, f.form, coalesce(r.root, w.word) AS root, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
LEFT JOIN (SELECT word, root FROM ahead WHERE root NOT IN (SELECT word FROM forms)) r USING (word)
"""


@query("op11_spelling_variants", _VARIANT_SQL)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digests(table(spark, folder, "documents"), plant=True)


_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS parts FROM words
), parts AS MATERIALIZED (SELECT r, len(parts) AS size, unnest(parts) AS part FROM sets
), links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM parts a JOIN parts b ON a.part = b.part AND a.r < b.r
  GROUP BY a.r, b.r, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
), edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
)
SELECT s.doc_id, len(s.parts)::BIGINT AS n_shingles, min(t.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM min(t.doc_id) AS kept
FROM sets s JOIN reach ON reach.x = s.r JOIN sets t ON t.r = reach.y GROUP BY s.r, s.doc_id, s.parts
"""


@query("op13_circulant_minhash", _NEAR_SQL)
def op13_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, folder, "documents"))
