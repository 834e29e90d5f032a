"""The queries of this subpackage, each over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import chat, lines, order_minhash, packing, pieces, pii, quality_model, quality_rules, simhash, substrings
from seine.store import read_table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"), everywhere=True)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(read_table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_pii,
        op3_simhash_near_dedup,
        op4_best_fit_packing,
        op5_document_fingerprints,
        op6_sentencepiece,
        op7_quality_classifier,
        op8_line_dedup,
        op9_quality_rules,
        op10_substring_dedup,
    )
}

_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 3, 1))) AS i, words FROM w),
h AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, i - coalesce(p, i - 5))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
ll AS (SELECT doc_id, host, unnest(lines) AS line FROM w),
lk AS (SELECT doc_id, host, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM ll),
kk AS (SELECT doc_id, host, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
       len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM lk WHERE bare <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM kk GROUP BY doc_id),
o AS (SELECT host, key FROM kk WHERE length(key) >= 20 GROUP BY host, key HAVING count(DISTINCT doc_id) > 5),
b AS (SELECT doc_id, sum(words) AS n FROM kk JOIN o USING (host, key) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_boilerplate_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_boilerplate_words AS rest FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rest >= 5 AND rest >= 0.3 * n_words AS kept, n_boilerplate_words FROM v
"""

_REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 33, 1))) AS i, words FROM w),
h AS (SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS gram FROM g),
twice AS (SELECT gram FROM h GROUP BY gram HAVING count(*) > 1),
starts AS (SELECT doc_id, list(i) AS firsts FROM h SEMI JOIN twice USING (gram) GROUP BY doc_id),
cover AS (SELECT DISTINCT doc_id, unnest(list_distinct(flatten(list_transform(firsts, lambda i: range(i, i + 35))))) AS pos FROM starts),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT p.*, c.pos IS NOT NULL AS gone FROM p LEFT JOIN cover c ON p.doc_id = c.doc_id AND p.pos = c.pos),
s AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed,
      string_agg(CASE WHEN gone THEN NULL ELSE word END, ' ' ORDER BY pos) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op8_line_dedup": _LINES_SQL,
    "op9_quality_rules": _RULES_SQL,
    "op10_substring_dedup": _REPEATS_SQL,
}
