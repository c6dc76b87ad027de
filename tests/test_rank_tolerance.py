"""Ranks of many vertices are no less exact than those of few."""

from pyspark.sql import functions as F

from topoweave.operators.centrality import pagerank


def test_tolerance_is_of_the_sum(spark):
    n = 4000
    e = spark.range(1, n).select(F.col("id").cast("string").alias("source"), F.floor(F.col("id") / 2).cast("string").alias("target"))
    got = {r.id: r["rank"] for r in pagerank(e, spark.range(n).select(F.col("id").cast("string").alias("id"))).collect()}
    rank = [1 / n] * n
    for _ in range(100):
        new = [0.15 / n + 0.85 * rank[0] / n] * n
        for k in range(1, n):
            new[k // 2] += 0.85 * rank[k]
        rank = new
    assert sum(abs(got[str(k)] - rank[k]) for k in range(n)) < 1e-5
