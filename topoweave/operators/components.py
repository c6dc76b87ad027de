"""Connected components by alternating stars.

Every round hangs the neighbours of a vertex onto its least neighbour, first
the greater ones (large star), then the smaller ones (small star); the edge set
shrinks to one star per component in a logarithmic number of rounds.  A vertex
of very many edges is reduced by a partial ``min`` before the shuffle, and the
join back has one row per vertex on its small side, which adaptive execution
splits.  Rounds are cut by tables in the shared folder; as soon as the edges fit
one task, it finishes them (:mod:`topoweave.operators.intask`).

Defined results: edges with a null end and self loops join nothing; repeated
edges and either direction count once; ids may be of any orderable type; the
component of a vertex is its least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.operators.intask import FIT, components_in_task
from topoweave.plans.tables import at_most, drop, keep


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v != m").select("v", "m")
    return rest.union(least.select("u", "m")).toDF("u", "v").distinct()


def _mark(e: DataFrame):
    return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, source: str, target: str, fit: int = FIT) -> DataFrame:
    """(id, component) of every vertex that has an edge to another."""
    spark = edges.sparkSession
    e = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u != v")
    e, path = keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while True:
        if at_most(e, fit):
            return components_in_task(e)
        before = before or _mark(e)
        nxt, used = keep(_small(_large(e)), "stars")
        now = _mark(nxt)
        drop(spark, path)
        e, path = nxt, used
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
