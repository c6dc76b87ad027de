"""Queries on evaluation items found in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.llm.leakage import leaked_items
from topoweave.plans.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    n = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(n, "item_id", "left").fillna(0, ["n_documents"])


_FOUND = """
WITH dw AS (SELECT doc_id, string_split(nullif(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')), ''), ' ') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, string_split(nullif(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')), ''), ' ') AS w FROM eval_items WHERE text IS NOT NULL),
pats AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k FROM iw WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM pats),
grams AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dw, sizes WHERE len(w) >= n) x),
found AS (SELECT DISTINCT g.doc_id, q.item_id FROM grams g JOIN pats q ON g.n = q.n AND g.p = q.p)
"""
QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": _FOUND + "SELECT doc_id, item_id FROM found",
    "p7_report": _FOUND + "SELECT i.item_id, i.suite, count(f.doc_id) AS n_documents FROM eval_items i LEFT JOIN found f ON i.item_id = f.item_id GROUP BY 1, 2",
}
