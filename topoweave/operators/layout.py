"""Positions of nodes on a canvas, as column expressions over ranks and global sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoweave.functions.rank import global_rank

MARGIN = 80.0
#: Turn between neighbours on the spiral: the golden angle.
GOLDEN = math.pi * (3.0 - math.sqrt(5.0))
#: Layers of the hierarchical layout, from the top.
LAYERS = ["module", "class", "function", "method", "variable", "parameter"]


def _fitted(p: DataFrame, n: int, width: float, height: float) -> DataFrame:
    """Points scaled into a canvas that grows with the root of their number."""
    grow = 2.0 * max(1.0, math.sqrt(n))
    w, h = width * grow, height * grow
    b = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    dx, dy = ((b["x1"] - b["x0"]) or 1.0, (b["y1"] - b["y0"]) or 1.0) if n else (1.0, 1.0)
    place = lambda c, low, d, size: (F.col(c) - F.lit(low)) / d * (size - 2 * MARGIN) + MARGIN
    return p.select("id", place("x", b["x0"], dx, w).alias("x"), place("y", b["y0"], dy, h).alias("y"))


def spiral(nodes: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    r = global_rank(nodes.select("id"), "id")
    n, i = r.count(), F.col("nth")
    return _fitted(r.select("id", (F.sqrt((i + 1) / max(n, 1)) * F.cos(i * GOLDEN)).alias("x"), (F.sqrt((i + 1) / max(n, 1)) * F.sin(i * GOLDEN)).alias("y")), n, width, height)


def circular(nodes: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    r = global_rank(nodes.select("id"), "id")
    n = r.count()
    turn = F.col("nth") * (2 * math.pi / max(n, 1))
    return _fitted(r.select("id", F.cos(turn).alias("x"), F.sin(turn).alias("y")), n, width, height)


def hierarchical(nodes: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    """A row per symbol type, evenly spread; unknown types share the last row."""
    layer = F.array_position(F.array(*[F.lit(t) for t in LAYERS]), F.col("symbol_type"))
    n = nodes.select("id", F.when(layer > 0, layer - 1).otherwise(len(LAYERS) - 1).alias("layer"))
    r = global_rank(n, "layer", "id")
    per = r.groupBy("layer").agg(F.count("*").alias("k"), F.min("nth").alias("first"))
    dense = per.withColumn("y", F.row_number().over(Window.orderBy("layer")) - 1.0)  # at most a row per symbol type
    r = r.join(F.broadcast(dense), "layer")
    return _fitted(r.select("id", ((F.col("nth") - F.col("first") + 1) / (F.col("k") + 1)).alias("x"), "y"), r.count(), width, height)
