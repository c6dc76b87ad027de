"""Structural fingerprints from syntax trees: counts, depth, flags, shingles and minhash signatures as column expressions.

A tree is a pre-order array of (depth, label).  A null or empty tree has no
counts, depth 0, no flags, and of shingles only that of its arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoweave.functions.names import last_part, parent
from topoweave.plans.tables import keep

HASHES = 100
#: Depth down to which nodes give shingles (fixed value).
SHINGLE_DEPTH = 6
#: Node labels that set a flag (fixed values).
FLAG_LABELS = {
    "has_loops": ["For", "While", "AsyncFor"],
    "has_conditionals": ["If", "IfExp"],
    "has_try_except": ["Try", "ExceptHandler"],
    "has_yield": ["Yield", "YieldFrom"],
    "has_await": ["Await"],
}


def _labels(tree: Column) -> Column:
    return F.transform(F.coalesce(tree, F.array().cast("array<struct<depth:int,label:string>>")), lambda x: x["label"])


def node_counts(tree: Column) -> Column:
    """Map of every label to the number of its nodes."""
    labels = _labels(tree)
    kinds = F.array_distinct(labels)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(labels, lambda x: x == k))))


def max_depth(tree: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tree, lambda x: x["depth"])), F.lit(0))


def flags(tree: Column) -> dict[str, Column]:
    labels = _labels(tree)
    return {k: F.arrays_overlap(labels, F.array(*[F.lit(x) for x in v])) & (F.size(labels) > 0) for k, v in FLAG_LABELS.items()}


def tree_shingles(tree: Column) -> Column:
    """Labels of the upper nodes, and each of them with the labels of its children."""

    def step(s, x):
        d, way = x["depth"], s["way"]
        one = F.when(d <= SHINGLE_DEPTH, F.concat(F.lit("ast:"), x["label"]))
        two = F.when((d > 0) & (d <= SHINGLE_DEPTH + 1), F.concat(F.lit("ast:"), F.get(way, d - 1), F.lit(">"), x["label"]))
        got = F.array_union(s["got"], F.filter(F.array(one, two), lambda v: v.isNotNull()))
        return F.struct(F.concat(F.slice(way, F.lit(1), d), F.array(x["label"])).alias("way"), got.alias("got"))

    none = F.array().cast("array<string>")
    rows = F.coalesce(tree, F.array().cast("array<struct<depth:int,label:string>>"))
    return F.aggregate(rows, F.struct(none.alias("way"), none.alias("got")), step, lambda s: s["got"])


def shingles(tree: Column, flag: dict[str, Column], arg_count: Column) -> Column:
    flow = F.filter(F.array(*[F.when(c, F.lit(f"flow:{k}")) for k, c in flag.items()]), lambda v: v.isNotNull())
    return F.concat(tree_shingles(tree), flow, F.array(F.concat(F.lit("args:"), F.coalesce(arg_count, F.lit(0)).cast("string"))))


def minhash(items: Column) -> Column:
    """Per seed the least 32-bit hash of the shingles: the first 8 hex digits of md5 of ``seed:shingle``."""
    one = lambda i: F.array_min(F.transform(items, lambda s: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), s)), 1, 8), 16, 10).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), one)


def function_fingerprints(shapes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fingerprints of functions and methods: what their trees say (``shapes``) and what the graph says around them."""
    own = nodes.where("symbol_type in ('function', 'method')").select("id", "name", "symbol_type", "docstring", "line_start", "line_end")
    ends = lambda kind, end, other, name: edges.where(F.col("edge_type") == kind).groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(name))
    f = own.join(shapes.drop("line_start"), "id", "left")
    for kind, end, other, name in (("calls", "source", "target", "callees"), ("calls", "target", "source", "callers"), ("reads", "source", "target", "reads"), ("writes", "source", "target", "writes")):
        f = f.join(ends(kind, end, other, name), "id", "left")
    flag = flags(F.col("ast_tree"))
    flag["has_await"] = flag["has_await"] | F.coalesce("is_async", F.lit(False))
    f = f.withColumns({**flag, "ast_node_counts": node_counts(F.col("ast_tree")), "max_nesting_depth": max_depth(F.col("ast_tree")), "arg_count": F.coalesce(F.size("arg_names"), F.lit(0)), "line_count": F.col("line_end") - F.col("line_start") + 1})
    f = keep(f.drop("is_async", "line_start", "line_end"), "shapes")[0]
    return f.withColumn("minhash", F.when(F.size("ast_tree") > 0, minhash(shingles(F.col("ast_tree"), {k: F.col(k) for k in flag}, F.col("arg_count")))))


def method_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, symbol_type, callees, callers) of methods: of their fingerprints what those of classes are made of, without any tree."""
    own = nodes.where("symbol_type = 'method'").select("id", "name", "symbol_type")
    calls = edges.where("edge_type = 'calls'").select("source", "target")
    ends = lambda end, other, name: calls.withColumnRenamed(end, "id").join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(other)).alias(name))
    return own.join(ends("source", "target", "callees"), "id", "left").join(ends("target", "source", "callers"), "id", "left")


def class_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(class_id, n_methods, methods, callees, callers) by short names, of the methods' fingerprints."""
    m = fingerprints.where("symbol_type = 'method'").select(parent(F.col("id")).alias("class_id"), "name", "callees", "callers")
    short = lambda c: F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list(c)), last_part)))
    return m.groupBy("class_id").agg(F.count("*").alias("n_methods"), F.array_sort(F.collect_set("name")).alias("methods"), short("callees").alias("callees"), short("callers").alias("callers"))
