"""Queries on similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.llm.neighbours import brute_force, nearest_pairs, search_rows, usable, vector_graph, vertices
from topoweave.plans.tables import keep, table

MODEL = "codemini-2"
LENGTH = 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "function_vectors").where(F.col("model_name") == MODEL)
    return keep(usable(rows, "vec_id", "function_id", "embedding", "created_at", LENGTH), "vectors")[0]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine >= 0.88, one among the 5 most similar of the other."""
    vectors = _vectors(spark, d)
    codes, owners = vertices(vectors)
    graph, _ = vector_graph(vectors, codes)
    pairs = nearest_pairs(vectors, graph, owners, 5, 0.88)
    return pairs.select(F.least("id", "nbr").alias("vec_a"), F.greatest("id", "nbr").alias("vec_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of every vector."""
    vectors = _vectors(spark, d)
    codes, owners = vertices(vectors)
    graph, _ = vector_graph(vectors, codes)
    return nearest_pairs(vectors, graph, owners, 5).select(F.col("id").alias("vec_id"), "rank", F.col("nbr").alias("neighbour_id"), "similarity")


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = _vectors(spark, d)
    codes, owners = vertices(vectors)
    graph, leaves = vector_graph(vectors, codes)
    queries = vectors.where("id % 100 = 0")
    return vectors, queries, search_rows(queries, vectors, codes, owners, graph, leaves)


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest other vectors of every vector whose id is divisible by 100, by greedy graph search."""
    return _searched(spark, d)[2].select(F.col("query").alias("vec_id"), F.col("id").alias("neighbour_id"), "similarity")


def _recall(queries: DataFrame, vectors: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact 5 nearest of the queries among ``found`` (query, similarity); of equally near ones any counts."""
    truth = brute_force(queries, vectors, 5).groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("last"))
    near = found.join(truth, "query").where(F.col("similarity") >= F.col("last") - 1e-9).groupBy("query").agg(F.count("*").alias("hits"))
    hits = truth.join(near, "query", "left").select("n", F.coalesce("hits", F.lit(0)).alias("hits"))
    return hits.agg(F.sum("n").alias("n_true"), F.sum("hits").alias("n_found"), F.try_divide(F.sum("hits"), F.sum("n")).alias("recall"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the greedy search for every vector whose id is divisible by 100."""
    vectors, queries, found = _searched(spark, d)
    return _recall(queries, vectors, found)


def p2_graph_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the neighbour graph for every vector whose id is divisible by 100."""
    vectors = _vectors(spark, d)
    codes, owners = vertices(vectors)
    graph, _ = vector_graph(vectors, codes)
    found, _ = keep(nearest_pairs(vectors, graph, owners, 5).where("id % 100 = 0").select(F.col("id").alias("query"), "similarity"), "graph-nearest")
    return _recall(vectors.where("id % 100 = 0"), vectors, found)


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_search": p2_search, "p2_recall": p2_recall, "p2_graph_recall": p2_graph_recall}
_EXACT = """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('o' || function_id, 'i' || vec_id) ORDER BY created_at DESC, vec_id DESC) AS rn FROM function_vectors
  WHERE model_name = 'codemini-2' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) x WHERE rn = 1),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM s)"""
SQL = {"p2_found": _EXACT + " SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE rank <= 5 AND s >= 0.88"}
