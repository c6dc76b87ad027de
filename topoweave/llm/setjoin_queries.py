"""Queries on pairs of fingerprints with similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.llm.setjoin import member_pairs, partners_in_blocks, set_classes, similar_sets
from topoweave.plans.tables import keep, table

FIELDS = ("callees", "callers", "reads", "writes")


def current_fingerprints(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The row of greatest fp_id per node_id; rows without node_id each stand for themselves.

    Found by leaving out the rows that a later one replaces: they are few and known as a table, whose size
    lets Spark choose a join that does not move the wide rows, and a shuffle join where they are many.
    """
    fp = table(spark, d, "fingerprints")
    keys = fp.where("node_id is not null").select("node_id", "fp_id")
    last = keys.groupBy("node_id").agg(F.max("fp_id").alias("last"))
    replaced, _ = keep(keys.join(last, "node_id").where("fp_id < last").select("fp_id"), "replaced")
    return fp.select("fp_id", *columns).join(replaced, "fp_id", "left_anti")


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similar_sets(current_fingerprints(spark, d, *FIELDS), "fp_id", {f: F.col(f) for f in FIELDS}, 0.7, 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return member_pairs(*_similar(spark, d)).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of equal sets and the number of similar other classes."""
    pairs, classes = _similar(spark, d)
    n = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return classes.join(n, "class", "left").fillna(0, ["n_links"]).select(F.col("id").alias("fp_id"), F.col("class").alias("class_id"), "n_links")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the distinct sets similar to those whose id is divisible by 100, by comparison with all sets, the share that is found."""
    pairs, _ = _similar(spark, d)
    pairs, _ = keep(pairs.select("a", "b"), "similar-sets")
    heads, _ = set_classes(current_fingerprints(spark, d, *FIELDS), "fp_id", {f: F.col(f) for f in FIELDS}, 5)
    truth = partners_in_blocks(heads.where("id % 100 = 0"), heads, 0.7)
    found = pairs.union(pairs.select("b", "a")).toDF("q", "id").withColumn("hit", F.lit(1))
    return truth.join(found, ["q", "id"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))


_CTE = """
WITH cur AS (SELECT * FROM fingerprints WHERE fp_id IN (SELECT max(fp_id) FROM fingerprints GROUP BY node_id)),
m AS (
  SELECT DISTINCT fp_id, f, trim(v, chr(32) || chr(9)) AS v FROM (
    SELECT fp_id, 'callees' AS f, unnest(callees) AS v FROM cur UNION ALL SELECT fp_id, 'callers', unnest(callers) FROM cur
    UNION ALL SELECT fp_id, 'reads', unnest(reads) FROM cur UNION ALL SELECT fp_id, 'writes', unnest(writes) FROM cur) x
  WHERE v IS NOT NULL AND trim(v, chr(32) || chr(9)) <> ''),
s AS (SELECT fp_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT a.fp_id AS fp_a, b.fp_id AS fp_b, count(*) AS k FROM m a JOIN m b ON a.f = b.f AND a.v = b.v AND a.fp_id < b.fp_id GROUP BY 1, 2)
"""
QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_recall": p3_recall}
SQL = {
    "p3_found": _CTE + "SELECT fp_a, fp_b FROM c JOIN s x ON x.fp_id = fp_a JOIN s y ON y.fp_id = fp_b WHERE 10 * k >= 7 * (x.n + y.n - k)",
    "p3_links": _CTE + """, p AS (SELECT fp_a, fp_b, k = x.n AND k = y.n AS same FROM c JOIN s x ON x.fp_id = fp_a JOIN s y ON y.fp_id = fp_b WHERE 10 * k >= 7 * (x.n + y.n - k)),
b AS (SELECT fp_a AS a, fp_b AS b, same FROM p UNION ALL SELECT fp_b, fp_a, same FROM p), h AS (SELECT s.fp_id, least(s.fp_id, min(b.b)) AS class_id FROM s LEFT JOIN b ON b.a = s.fp_id AND b.same GROUP BY s.fp_id)
SELECT h.fp_id, h.class_id, count(DISTINCT o.class_id) AS n_links FROM h LEFT JOIN b ON b.a = h.fp_id AND NOT b.same LEFT JOIN h o ON o.fp_id = b.b GROUP BY 1, 2""",
}
