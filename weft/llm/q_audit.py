"""Query op13 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exchange import cut
from .filter_audit import FILTERS, orders, survivors, text_failures, with_labels, with_repeats

LOST = {"quality": "good_lost", "toxic": "toxic_lost"}


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cut(text_failures(spark.read.parquet(f"{sf_dir}/documents.parquet")), "failures")  # read twice, without the texts
    labelled = with_labels(with_repeats(judged, FILTERS.index("E")), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", list(LOST))
    return orders(survivors(labelled, len(FILTERS), list(LOST)), FILTERS, LOST)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
e AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (
  SELECT g.*, filter_order, step, filter_order[step] AS f, translate(fails, filter_order[:step - 1], '') <> fails AS gone,
         contains(fails, filter_order[step]) AS failing
  FROM g, s),
m AS (
  SELECT part, filter_order, step::INT AS step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND failing AND good = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND failing AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE f, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM m
"""
QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": OP13_SQL}
