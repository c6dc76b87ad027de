"""Queries on groups of near copies among source snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.llm.forest import pairs_within
from topoweave.llm.nearcopies import near_copies, text_sets
from topoweave.llm.setjoin import partners_in_blocks
from topoweave.llm.setjoin_queries import current_fingerprints
from topoweave.plans.tables import keep


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies(current_fingerprints(spark, d, "source_snippet"), "fp_id", "source_snippet", 0.6)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of records in one group."""
    return pairs_within(_groups(spark, d), "group").select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of equal sets and its group."""
    return _groups(spark, d).select(F.col("id").alias("fp_id"), F.col("class").alias("class_id"), F.col("group").alias("group_id"))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the records alike to those whose id is divisible by 100, by comparison with all records, the share in the same group."""
    fp = current_fingerprints(spark, d, "source_snippet")
    groups, _ = keep(near_copies(fp, "fp_id", "source_snippet", 0.6).select("id", "group"), "groups")
    sets, _ = keep(text_sets(fp.select(F.col("fp_id").alias("id"), F.col("source_snippet").alias("text")).where("text is not null")), "text-sets")
    truth = partners_in_blocks(sets.where("id % 100 = 0"), sets, 0.6)
    both = truth.join(groups.toDF("q", "gq"), "q", "left").join(groups, "id", "left")
    return both.agg(F.count("*").alias("n_true"), F.count_if(F.col("gq") == F.col("group")).alias("n_found"), F.try_divide(F.count_if(F.col("gq") == F.col("group")), F.count("*")).alias("recall"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p5_recall": p5_recall}
_GROUPS = """WITH RECURSIVE w AS (SELECT fp_id, regexp_extract_all(source_snippet, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\\sA-Za-z_0-9]') AS w FROM fingerprints
  WHERE source_snippet IS NOT NULL AND (node_id IS NULL OR fp_id IN (SELECT max(fp_id) FROM fingerprints WHERE node_id IS NOT NULL GROUP BY node_id))),
g AS (SELECT DISTINCT fp_id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT fp_id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM w WHERE len(w) >= 40) x),
n AS (SELECT fp_id, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT a.fp_id AS a, b.fp_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.fp_id < b.fp_id GROUP BY 1, 2),
p AS (SELECT k.a, k.b, k.k = x.n AND k.k = y.n AS same FROM k JOIN n x ON x.fp_id = k.a JOIN n y ON y.fp_id = k.b WHERE 10 * k.k >= 6 * (x.n + y.n - k.k)),
u AS (SELECT a AS s, b AS o, same FROM p UNION SELECT b, a, same FROM p),
cc(id, comp) USING KEY (id) AS (SELECT fp_id, fp_id FROM n UNION SELECT u.o, min(c.comp) FROM cc c JOIN u ON u.s = c.id JOIN recurring.cc q ON q.id = u.o WHERE c.comp < q.comp GROUP BY 1)
"""
SQL = {
    "p5_found": _GROUPS + "SELECT x.id AS fp_a, y.id AS fp_b FROM cc x JOIN cc y ON x.comp = y.comp AND x.id < y.id",
    "p5_groups": _GROUPS + "SELECT cc.id AS fp_id, least(cc.id, coalesce(min(u.o), cc.id)) AS class_id, cc.comp AS group_id FROM cc LEFT JOIN u ON u.s = cc.id AND u.same GROUP BY cc.id, cc.comp",
}
