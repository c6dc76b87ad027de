"""The current property graph from the stored node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.operators.graph import PropertyGraph
from topoweave.plans.tables import keep, table
from topoweave.schema import EDGE_COLUMNS, NODE_COLUMNS


def current_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that exist now: per id its latest row without an end; shared symbols belong to every graph."""
    own = table(spark, sf_dir, "nodes").where("deleted_at is null")
    shared = table(spark, sf_dir, "shared_nodes").where("deleted_at is null")
    for c, kind in (("signature", "string"), ("metadata", "string")):
        shared = shared.withColumn(c, F.lit(None).cast(kind))
    shared = shared.withColumns({"is_dead": F.lit(False), "is_proposed": F.lit(False), "seq": F.lit(0).cast("bigint")})
    rows = own.select(*NODE_COLUMNS, "seq", "observed_at").unionByName(shared.select(*NODE_COLUMNS, "seq", "observed_at"))
    # A partial max per id: repeats of a hot id are combined before the shuffle.
    last = rows.groupBy("id").agg(F.max_by(F.struct(*NODE_COLUMNS[1:]), F.struct("observed_at", "seq")).alias("r"))
    return last.select("id", "r.*")


def current_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct relationships between named ends, the last row of each (source, target, type) standing for all."""
    e = table(spark, sf_dir, "edges").select(
        F.btrim("source", F.lit(" \t")).alias("source"), F.btrim("target", F.lit(" \t")).alias("target"), F.lower("edge_type").alias("edge_type"),
        "is_dead", "is_proposed", "line", "metadata", F.col("edge_id").alias("seq"),
    )
    e = e.where("source != '' and target != '' and edge_type is not null")
    last = e.groupBy("source", "target", "edge_type").agg(F.max_by(F.struct("is_dead", "is_proposed", "line", "metadata", "seq"), "seq").alias("r"))
    return last.select("source", "target", "edge_type", "r.*").select(*EDGE_COLUMNS)


def current_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes and edges of today; an edge belongs to the graph as soon as its source does."""
    nodes, edges = current_nodes(spark, sf_dir), current_edges(spark, sf_dir)
    return PropertyGraph(nodes, edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi"))


def kept_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """:func:`current_graph`, made once and written, so that a query that uses it several times reads it by columns and edge types."""
    nodes, _ = keep(current_nodes(spark, sf_dir), "graph-nodes")
    edges = current_edges(spark, sf_dir).join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select(*EDGE_COLUMNS)
    return PropertyGraph(nodes, keep(edges, "graph-edges", "edge_type")[0])
