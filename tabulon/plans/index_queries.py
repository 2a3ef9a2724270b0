"""Queries that go through a stored index of the documents' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import text_index
from tabulon.plans.registry import register
from tabulon.sources.scratch import fresh_path
from tabulon.sources.tables import table

LINE, FILTERS = '"of the" with OR from -was', {"lang": ["en", "fr"], "n_chars": (100, 50000)}

_FOUND = r"""
WITH w AS MATERIALIZED (SELECT doc_id AS id, text, lang, source, n_chars, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
tf AS MATERIALIZED (SELECT *, len(list_filter(w, lambda x: x = 'of')) AS t0, len(list_filter(w, lambda x: x = 'the')) AS t1, len(list_filter(w, lambda x: x = 'with')) AS t2, len(list_filter(w, lambda x: x = 'from')) AS t3,
  list_min(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) - 1 AS p0, list_position(w, 'with') - 1 AS p1, list_position(w, 'from') - 1 AS p2, list_contains(w, 'was') AS gone FROM w),
facts AS (SELECT count(*) AS n, avg(len(w)) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2, count(*) FILTER (t3 > 0) AS d3 FROM tf),
found AS (SELECT *, least(p0, p1, p2) AS place, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len(w) / mean)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len(w) / mean))
    + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * len(w) / mean)) + ln(1 + (n - d3 + 0.5) / (d3 + 0.5)) * t3 * 2.2 / (t3 + 1.2 * (0.25 + 0.75 * len(w) / mean)) AS score
  FROM tf, facts WHERE p0 >= 0 AND (p1 >= 0 OR p2 >= 0) AND NOT gone AND lang IN ('en', 'fr') AND n_chars BETWEEN 100 AND 50000)
"""


def documents_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return text_index.build_index(table(spark, sf_dir, "documents"), fresh_path(spark, "text-index"), "doc_id", "text", ("lang", "source", "n_chars"))


@register("x4_document_search", _FOUND + r"""
SELECT row_number() OVER (ORDER BY round(score, 6) DESC, id)::INTEGER AS nth, id, round(score, 6) AS score, lang, source, n_chars,
  array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')[greatest(1, first + 2 * (place - 10)) : first + 2 * (place + 10)], '') AS snippet
FROM (SELECT *, CASE WHEN regexp_matches(text, '^[\p{L}\p{N}]') THEN 1 ELSE 2 END AS first FROM found) ORDER BY nth LIMIT 40""")
def x4_document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a search line under filters, with snippets."""
    return documents_index(spark, sf_dir).search(LINE, FILTERS, limit=40).rows


@register("x4_document_pages", r"SELECT row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id)::INTEGER - 25 AS nth, doc_id AS id, n_chars FROM documents WHERE NOT list_contains(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), 'the') ORDER BY nth LIMIT 25 OFFSET 25")
def x4_document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what a line that only excludes leaves, the longest first."""
    return documents_index(spark, sf_dir).search("-the", sort="newest", by="n_chars", page=2, limit=25).rows.select("nth", "id", "n_chars")


@register("x4_document_facets", _FOUND + r", n AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM found GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM found GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS place FROM n) SELECT field, value, n, place FROM ranked WHERE place <= 20 UNION ALL SELECT 'all', NULL, count(*), 1 FROM found")
def x4_document_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts answer, and by language and source."""
    page = documents_index(spark, sf_dir).search(LINE, FILTERS, limit=1, facets=("lang", "source"))
    return page.facets.unionByName(page.total.select(F.lit("all").alias("field"), F.lit(None).cast("string").alias("value"), F.col("total").alias("n"), F.lit(1).alias("place")))


@register("x1_indexed_prefixes", r"SELECT doc_id AS id FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'an'))) > 0")
def x1_indexed_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).with_prefixes("Judge ther an")


@register("x24_indexed_phrases", r"WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id AS id FROM t WHERE contains(t, ' of the ') OR contains(t, ' with that is ') OR contains(t, ' and in ')")
def x24_indexed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).with_phrases(["of the", "With that, is", "and  in"])
