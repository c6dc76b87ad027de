"""PageRank and betweenness by rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.plans.tables import drop, keep


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank): parallel edges add weight, vertices without a way out give to all alike.

    Ends after ``rounds``, or when all ranks, whose sum is 1, together move less than ``tolerance``.  Contributions
    are added up per task before the shuffle, so a vertex of very many edges costs no more than others.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = edges.groupBy("source", "target").agg(F.count("*").alias("w"))
    total = w.groupBy("source").agg(F.sum("w").alias("t"))
    links, p0 = keep(w.join(total, "source").select("source", "target", (F.col("w") / F.col("t")).alias("share")), "links")
    n = vertices.count()
    ends = links.select(F.col("source").alias("id")).distinct().withColumn("out", F.lit(True))
    start = vertices.select("id").join(ends, "id", "left").select("id", F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(0.0).alias("was"), F.col("out").isNull().alias("dangling"))
    # The links lie partitioned by their source for all rounds; only ranks and contributions move.
    links = links.repartition(parts, "source").persist()
    rank, path = keep(start, "rank")
    lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(rounds):
        given = links.join(rank.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
        new = damping * (F.coalesce("g", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - damping) / n)
        nxt, used = keep(rank.join(given, "id", "left").select("id", new.alias("rank"), F.col("rank").alias("was"), "dangling"), "rank")
        lost, moved = nxt.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        drop(spark, path)
        rank, path = nxt, used
        if tolerance is not None and (moved or 0.0) < tolerance:
            break
    links.unpersist()
    drop(spark, p0)
    return rank.select("id", "rank")


def betweenness(edges: DataFrame, vertices: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): share of directed shortest paths through each vertex, normalised, parallel edges counting once.

    All sources advance together: a round extends (source, vertex) pairs by one step and adds up their path
    counts; a second sweep back down the levels adds up dependencies.  The rows are the reachable pairs, so
    large graphs are given a set of ``sources``, whose scores are scaled up to all vertices.
    """
    steps, _ = keep(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u != v").distinct(), "steps")
    ids = vertices.select("id").distinct()
    n = ids.count()
    start = (sources if sources is not None else ids).select("id").distinct()
    k = start.count()
    level, _ = keep(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        met = reduce(DataFrame.union, levels).select("s", "v")
        nxt = level.withColumnRenamed("v", "u").join(steps, "u").groupBy("s", "v").agg(F.sum("paths").alias("paths")).join(met, ["s", "v"], "left_anti")
        level, _ = keep(nxt, "level")
    behind, parts = None, []
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        owed = here.select("s", "v", "paths", F.lit(0.0).alias("d")) if behind is None else here.join(behind, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("d", F.lit(0.0)).alias("d"))
        owed, _ = keep(owed, "owed")
        parts.append(owed.where("s != v").select(F.col("v").alias("id"), "d"))
        before = levels[depth - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("before"))
        behind = owed.join(steps, "v").join(before, ["s", "u"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("before") / F.col("paths") * (1 + F.col("d"))).alias("d"))
    scale = (n / max(k, 1)) / max((n - 1) * (n - 2), 1)
    if not parts:
        return ids.withColumn("score", F.lit(0.0))
    summed = reduce(DataFrame.union, parts).groupBy("id").agg((F.sum("d") * F.lit(scale)).alias("score"))
    return ids.join(summed, "id", "left").fillna(0.0, ["score"])
