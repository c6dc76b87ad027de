"""Queries on functions and their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.llm.docpairs import documented_functions
from topoweave.plans.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose own documentation tells something."""
    return documented_functions(table(spark, d, "source_files")).where("doc_origin != 'inherited'").select("qualified_name").distinct()


def p4_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Methods without documentation and the overridden method whose documentation they get."""
    return documented_functions(table(spark, d, "source_files")).where("doc_origin = 'inherited'").select("qualified_name", "doc_from", "description").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of code and description, inherited ones too."""
    return documented_functions(table(spark, d, "source_files"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and description words per project and origin of the documentation."""
    rows = documented_functions(table(spark, d, "source_files"))
    words = F.size(F.split(F.trim("description"), r"\s+"))
    return rows.groupBy(F.substring_index("qualified_name", ".", 1).alias("project"), "doc_origin").agg(F.count("*").alias("n_functions"), F.sum(words).alias("n_words"))


QUERIES = {"p4_found": p4_found, "p4_inherited": p4_inherited, "p4_pairs": p4_pairs, "p4_report": p4_report}
SQL: dict[str, str] = {}
