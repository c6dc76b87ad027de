"""Queries on texts packed into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.llm.packing import CAPACITY, packed, packing_faults
from topoweave.plans.tables import keep, table


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container, position and piece of every text."""
    return packed(table(spark, d, "documents"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, the least number of containers the tokens need, and the share of space used."""
    c = packed(table(spark, d, "documents")).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = c.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens"))
    return total.select("*", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * CAPACITY)).alias("fill"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the packing of all texts: pieces lost, doubled or cut without need, containers overfull or with gaps in their order."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return packing_faults(keep(packed(docs), "packed")[0], docs)


QUERIES = {"p6_containers": p6_containers, "p6_checks": p6_checks, "p6_report": p6_report}
SQL: dict[str, str] = {}
