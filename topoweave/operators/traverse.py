"""Reachability and paths by frontier joins.

Each round joins the frontier (only new vertices) with the edges and leaves out
what was met before; the frontier is written to the shared folder, so lineage
stays one round long and a lost executor costs no round.  Vertices are visited once, so work is bounded by the edges
reached, and a hot vertex costs its edges once.

Defined results: a seed without edges reaches itself only; self loops and
repeated edges change nothing; empty seeds or edges give the seeds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.operators.intask import FIT, closure_in_task
from topoweave.plans.tables import at_most, drop, keep


def directed(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """Distinct (u, v) steps along the edges, against them, or both."""
    along = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    against = along.select(F.col("v").alias("u"), F.col("u").alias("v"))
    steps = {"forward": along, "backward": against, "both": along.union(against)}[direction]
    return steps.where("u != v").distinct()


#: Steps taken for each table that is written, and tables after which they are written as one.
HOPS, LEVELS = 4, 8


def laid_by_start(steps: DataFrame) -> DataFrame:
    """Steps held partitioned and sorted by their start for many rounds of joins, so that only what they meet moves.

    Parts that are evicted or lost are made again from the table of the steps.
    """
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps.select("u", "v").repartition(parts, "u").sortWithinPartitions("u").persist()


def distances(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of everything reached from ``seeds`` (column id) within ``max_depth`` steps; seeds have depth 0.

    A table holds what several steps met first, each of them made once (the exchanges of a step are used again by
    the next); only what the last of them met goes on, as the vertices before it were walked on from already.
    """
    spark = steps.sparkSession
    by_start = laid_by_start(steps)
    frontier, path = keep(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    levels, paths, depth = [frontier], [path], 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        met = reduce(DataFrame.union, levels).select("id")
        wave = [frontier.select(F.col("id").alias("u"))]
        for _ in range(hops):
            wave.append(by_start.join(wave[-1], "u", "left_semi").select(F.col("v").alias("u")).distinct())
        first = reduce(DataFrame.union, [w.withColumn("depth", F.lit(depth + k)) for k, w in enumerate(wave) if k])
        first = first.groupBy(F.col("u").alias("id")).agg(F.min("depth").alias("depth")).join(met, "id", "left_anti")
        new, path = keep(first, "reached")
        depth += hops
        frontier = new.where(F.col("depth") == depth)
        levels.append(new), paths.append(path)
        if len(levels) > LEVELS:
            # Adaptive execution fits the number of files to the rows.
            merged, path = keep(reduce(DataFrame.union, levels[:-1]).repartition("id"), "reached")
            for p in paths[:-1]:
                drop(spark, p)
            levels, paths = [merged, new], [path, paths[-1]]
    by_start.unpersist()
    return reduce(DataFrame.union, levels)


def closure(steps: DataFrame, seeds: DataFrame, fit: int = FIT) -> DataFrame:
    """(id) of everything reached from ``seeds``, the seeds included; one task walks steps and seeds that fit it."""
    both = steps.select("u", "v").union(seeds.select("id", "id").where("id is not null"))
    if at_most(both, fit):
        return closure_in_task(both)
    return distances(steps, seeds.where("id is not null")).select("id")


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None) -> DataFrame:
    """(id) reached along the edges; (id, depth) where a depth is given."""
    steps = directed(edges, direction)
    if max_depth is not None:
        return distances(steps, seeds, max_depth)
    return closure(keep(steps, "steps")[0], seeds)


def connected(edges: DataFrame, a: str, b: str) -> bool:
    """Whether a way leads from one vertex to the other, in either direction."""
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    return any(not reach(edges, one(x)).where(F.col("id") == y).isEmpty() for x, y in ((a, b), (b, a)))


def either_way(paths, edges: DataFrame, source: str, target: str, *args) -> DataFrame:
    """``paths(edges, source, target, ..)``, or of the way back where it gives no row."""
    there, _ = keep(paths(edges, source, target, *args), "paths-there")
    return paths(edges, target, source, *args) if there.isEmpty() else there


def reachable(edges: DataFrame, source: str, target: str, max_depth: int = 20) -> DataFrame:
    """One row (reachable, path_length, path, reason): whether a path of at most ``max_depth`` steps leads to the target."""
    spark = edges.sparkSession
    path, _ = keep(shortest_path(edges, source, target), "reach-path")
    n = F.size("path") - 1
    row = spark.createDataFrame([(source, target)], "source string, target string").join(path, how="left")  # at most one row each
    ok = F.col("path").isNotNull() & (n <= max_depth)
    reason = F.when(F.col("path").isNull(), "no path").when(n > max_depth, F.format_string("path of %d steps, at most %d asked for", n, F.lit(max_depth)))
    return row.select("source", "target", F.coalesce(ok, F.lit(False)).alias("reachable"), F.when(F.col("path").isNotNull(), n).alias("path_length"), F.when(ok, F.col("path")).alias("path"), reason.alias("reason"))


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """One row (path): the shortest directed path, of equals the first in order of ids; no row if there is none."""
    spark = edges.sparkSession
    steps = directed(edges)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    # Only vertices on some shortest path are walked: as far from the source as the target lies behind them.
    ahead, _ = keep(distances(steps, one(source), max_depth), "ahead")
    end = ahead.where(F.col("id") == target).select("depth").first()
    if end is None:
        return spark.createDataFrame([], "path array<string>")
    total = end["depth"]
    behind, _ = keep(distances(directed(edges, "backward"), one(target), total), "behind")
    on, _ = keep(ahead.join(behind.withColumnRenamed("depth", "rest"), "id").where(F.col("depth") + F.col("rest") == total).select("id", "depth"), "on-path")
    at = one(source).withColumn("path", F.array("id"))
    for depth in range(1, total + 1):
        layer = on.where(F.col("depth") == depth).select(F.col("id").alias("v"))
        # Every vertex here lies on a shortest path, so the least next id from the least path is the least path.
        step = steps.join(at.withColumnRenamed("id", "u"), "u").join(layer, "v", "left_semi")
        at, _ = keep(step.select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path")).orderBy("path").limit(1), "path")
    return at.select("path")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None, cutoff: int, distinct: bool = True) -> DataFrame:
    """(path): all directed simple paths of at most ``cutoff`` edges from ``sources`` to ``targets`` (any vertex if None).

    Paths are cut early: a vertex is only walked on to while a target is within the steps left.  With
    ``distinct`` off parallel edges repeat a path.
    """
    e = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u != v")
    e = e.distinct() if distinct else e
    left = None
    if targets is not None:
        left, _ = keep(distances(directed(edges, "backward"), targets, cutoff).select(F.col("id").alias("v"), F.col("depth").alias("need")), "need")
    at = sources.select(F.col("id").alias("u"), F.array("id").alias("path"))
    found = []
    for k in range(1, cutoff + 1):
        step = at.join(e, "u").where(~F.array_contains("path", F.col("v")))
        if left is not None:
            step = step.join(left, "v").where(F.col("need") <= cutoff - k)
        at, _ = keep(step.select(F.col("v").alias("u"), F.concat("path", F.array("v")).alias("path")), "paths")
        if at.isEmpty():
            break
        found.append(at)
    if not found:
        return at.select("path").limit(0)
    all_paths = reduce(DataFrame.union, found)
    if targets is not None:
        all_paths = all_paths.join(targets.select(F.col("id").alias("u")).distinct(), "u", "left_semi")
    return all_paths.select("path")


def call_chain(edges: DataFrame, source: str, target: str, cutoff: int = 8) -> tuple[DataFrame, DataFrame]:
    """(id, role) of the vertices on any simple path of calls, or of the way back if there is none; (source, target, role) of the edges among them."""
    spark = edges.sparkSession
    calls = edges.where("edge_type = 'calls'")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    on = either_way(lambda e, a, b: simple_paths(e, one(a), one(b), cutoff), calls, source, target).select(F.explode("path").alias("id")).distinct()
    role = F.when(F.col("id") == source, "origin").when(F.col("id") == target, "destination").otherwise("passthrough")
    roles, _ = keep(on.select("id", role.alias("role")), "chain")
    inner = calls.join(roles.select(F.col("id").alias("source")), "source", "left_semi").join(roles.select(F.col("id").alias("target")), "target", "left_semi")
    return roles, inner.select("source", "target", F.lit("flow").alias("role")).distinct()


def trace_function(edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """(id, role) of everything that calls the function or is called by it, and (source, target, role) of the edges among them."""
    spark = edges.sparkSession
    calls = edges.where("edge_type = 'calls'")
    one = spark.createDataFrame([(node_id,)], "id string")
    up, down = reach(calls, one, "backward").select("id", F.lit(True).alias("up")), reach(calls, one).select("id", F.lit(True).alias("down"))
    role = F.when(F.col("id") == node_id, "origin").when(F.col("up") & F.col("down"), "mutator").when(F.col("up"), "passthrough").otherwise("destination")
    roles, _ = keep(up.join(down, "id", "full_outer").select("id", role.alias("role")), "roles")
    inner = edges.where("edge_type != 'contains'").join(roles.select(F.col("id").alias("source")), "source", "left_semi").join(roles.select(F.col("id").alias("target")), "target", "left_semi")
    return roles, edge_roles(inner)


def edge_roles(edges: DataFrame) -> DataFrame:
    """(source, target, role): write before read before flow where several types join the same ends."""
    rank = F.when(F.col("edge_type") == "writes", 0).when(F.col("edge_type") == "reads", 1).otherwise(2)
    return edges.groupBy("source", "target").agg(F.element_at(F.array(F.lit("write"), F.lit("read"), F.lit("flow")), F.min(rank) + 1).alias("role"))


def trace_variable(nodes: DataFrame, edges: DataFrame, name: str, origin: str = "", cutoff: int = 5) -> tuple[DataFrame, DataFrame]:
    """Where a variable is written, read and passed on: (id, role) and (source, target, role).

    Every pair of a writer and a reader is followed, without a limit on pairs or paths, on simple paths of at
    most ``cutoff`` edges other than containment and inheritance; only the vertices on them are wanted, so a
    vertex counts if the steps to it from one end and on to the other fit into the cutoff.
    """
    flow = edges.where("edge_type in ('reads', 'writes')").where(F.substring_index("target", ".", -1) == name)
    flow = flow.where(F.col("source").startswith(origin)) if origin else flow
    flow, _ = keep(flow.select("source", "target", "edge_type", "line"), "variable")
    ends = flow.groupBy("source").agg(F.max(F.col("edge_type") == "writes").alias("writes"), F.max(F.col("edge_type") == "reads").alias("reads"), F.min(F.when(F.col("edge_type") == "writes", F.coalesce("line", F.lit(9999)))).alias("first_line"))
    ends, _ = keep(ends.withColumnRenamed("source", "id"), "variable-ends")
    path_edges = edges.where("edge_type not in ('contains', 'inherits')")
    writers, readers = ends.where("writes").select("id"), ends.where("reads").select("id")
    on = None
    for a, b in ((writers, readers), (readers, writers)):
        ahead = reach(path_edges, a, "forward", cutoff).select("id", F.col("depth").alias("d1"))
        behind = reach(path_edges, b, "backward", cutoff).select("id", F.col("depth").alias("d2"))
        part = ahead.join(behind, "id").where(f"d1 + d2 <= {cutoff} and d1 + d2 > 0").select("id")
        on = part if on is None else on.union(part)
    targets = flow.select(F.col("target").alias("id")).distinct()
    on, _ = keep(on.union(ends.select("id")).union(targets).distinct(), "variable-nodes")
    inner = edges.where("edge_type != 'contains'").join(on.select(F.col("id").alias("source")), "source", "left_semi").join(on.select(F.col("id").alias("target")), "target", "left_semi")
    passing = edges.where("edge_type = 'calls' and source != target").join(on.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), F.lit(True).alias("passes")).distinct()
    first = ends.where("writes and not reads").orderBy("first_line", "id").limit(1).select("id", F.lit(True).alias("first"))
    role = (
        F.when(F.col("is_target"), "origin").when(F.col("writes") & F.col("reads"), "mutator").when(F.col("writes"), F.when(F.col("first"), "origin").otherwise("mutator"))
        .when(F.col("reads"), F.when(F.col("passes"), "passthrough").otherwise("destination")).otherwise("passthrough")
    )
    x = on.join(targets.withColumn("is_target", F.lit(True)), "id", "left").join(ends, "id", "left").join(passing, "id", "left").join(first, "id", "left")
    return x.select("id", role.alias("role")), edge_roles(inner)
