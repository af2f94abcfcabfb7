"""Query op8 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import BASE, STOP_WORDS, quality_rules


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *BASE, "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stut,
         len(regexp_extract_all(text, '!')) AS n_excl,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•‣▪]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t]*$'))) AS n_cut
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2.5 AND 14 AND n_symbols / n_words <= 0.25
         AND n_stop / n_words >= 0.05 AND n_upper / word_chars <= 0.3 AND n_stut / n_words <= 0.2 AND n_excl / n_words <= 0.3
         AND n_dup_lines / n_lines <= 0.5 AND n_bullet / n_lines <= 0.9 AND n_cut / n_lines <= 0.3, true) AS kept
FROM b
"""
QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": OP8_SQL}
