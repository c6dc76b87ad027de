"""Queries on references that name no existing symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.operators.orphans import in_scope, orphan_references, orphan_report, parent_rows, reference_rows, union_rows
from topoweave.plans.tables import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = reference_rows(table(spark, d, "edges"), "edges", "edge_id", ["source", "target"], "observed_at")
    refs = in_scope(refs, table(spark, d, "projects").select(F.col("name").alias("root")))
    parents = union_rows([parent_rows(table(spark, d, t), "id", "observed_at", "deleted_at") for t in ("nodes", "shared_nodes")])
    return refs, parents


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*_inputs(spark, d)).select(F.col("row_id").alias("edge_id"), "endpoint")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs, parents = _inputs(spark, d)
    return orphan_report(refs, orphan_references(refs, parents))


_REFS = """
WITH refs AS (
  SELECT edge_id, endpoint, trim(v, chr(32) || chr(9)) AS key, observed_at FROM (
    SELECT edge_id, 'source' AS endpoint, source AS v, observed_at FROM edges
    UNION ALL SELECT edge_id, 'target', target, observed_at FROM edges) x
  WHERE v IS NOT NULL),
mine AS (SELECT * FROM refs WHERE split_part(key, '.', 1) IN (SELECT name FROM projects)),
parents AS (SELECT id, observed_at, deleted_at FROM nodes UNION ALL SELECT id, observed_at, deleted_at FROM shared_nodes),
lost AS (
  SELECT * FROM mine m WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.id = m.key AND p.observed_at <= m.observed_at AND (p.deleted_at IS NULL OR p.deleted_at > m.observed_at)))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _REFS + "SELECT edge_id, endpoint FROM lost",
    "p1_report": _REFS
    + """, lostc AS (SELECT endpoint, strftime(observed_at, '%Y-%m') AS period, count(*) AS n_orphans, count(DISTINCT key) AS n_orphan_keys FROM lost GROUP BY 1, 2),
allc AS (SELECT endpoint, strftime(observed_at, '%Y-%m') AS period, count(*) AS n_references FROM mine GROUP BY 1, 2)
SELECT 'edges' AS "table", a.endpoint, a.period, a.n_references, coalesce(l.n_orphans, 0) AS n_orphans, coalesce(l.n_orphan_keys, 0) AS n_orphan_keys
FROM allc a LEFT JOIN lostc l ON a.endpoint = l.endpoint AND a.period IS NOT DISTINCT FROM l.period""",
}
