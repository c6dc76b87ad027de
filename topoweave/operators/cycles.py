"""Strongly connected components, layers and elementary cycles.

Vertices that cannot lie on a cycle are peeled off first (no step in, or none
out), which removes nearly all of a code graph; what is left is coloured with
the least id that reaches it, and each colour's root collects, backwards and
within its colour, one strongly connected component per round.  As soon as what
is left fits, one task finishes it (:mod:`topoweave.operators.intask`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.operators.intask import FIT, cycles_in_task, layers_in_task, shortest_through_in_tasks, strong_in_task
from topoweave.operators.traverse import closure, directed, laid_by_start
from topoweave.plans.tables import at_most, drop, keep


def cyclic_core(steps: DataFrame, enough: int = 0) -> DataFrame:
    """Steps (u, v) left when vertices without a step in or out are peeled off again and again, or until at most ``enough`` are left."""
    steps, _ = keep(steps, "core")
    n = steps.count()
    while n > enough:
        peeled = steps
        for _ in range(2):
            both = peeled.select(F.col("u").alias("id")).distinct().join(peeled.select(F.col("v").alias("id")).distinct(), "id", "left_semi")
            peeled = peeled.join(both.toDF("u"), "u", "left_semi").join(both.toDF("v"), "v", "left_semi")
        steps, _ = keep(peeled, "core")
        n, before = steps.count(), n
        if n == before:
            break
    return steps


def strong_components(edges: DataFrame, fit: int = FIT) -> DataFrame:
    """(id, component) of the vertices in strongly connected components of more than one vertex; named by their least id."""
    steps, done = cyclic_core(directed(edges), fit), []
    while not at_most(steps, fit):
        colour, _ = keep(_coloured(steps), "colours")
        # Steps within a colour, against their direction, from the root that gave the colour.
        c = steps.join(colour.toDF("u", "cu"), "u").join(colour.toDF("v", "cv"), "v").where("cu = cv").select("u", "v", "cu")
        roots = colour.where("id = colour").select("id")
        back = c.select(F.col("v").alias("u"), F.col("u").alias("v"))
        members, _ = keep(closure(back, roots).join(colour, "id"), "members")
        done.append(members)
        steps = cyclic_core(c.select("u", "v").join(members.select(F.col("id").alias("u")), "u", "left_anti").join(members.select(F.col("id").alias("v")), "v", "left_anti"), fit)
    # No component lies partly in the rest: members of one leave together.
    rest = strong_in_task(steps)
    if not done:
        return rest
    sized = reduce(DataFrame.union, done)
    big = sized.groupBy("colour").agg(F.count("*").alias("n"), F.min("id").alias("component")).where("n > 1")
    return sized.join(big, "colour").select("id", "component").union(rest)


#: Steps that a colour is passed on for each table that is written.
HOPS = 4


def _coloured(steps: DataFrame) -> DataFrame:
    """(id, colour): the least id from which each vertex can be reached."""
    spark = steps.sparkSession
    by_start = laid_by_start(steps)
    ids = steps.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    state, path = keep(ids.select("id", F.col("id").alias("colour"), F.lit(True).alias("new")), "colour")
    while not state.where("new").isEmpty():
        # Only colours that changed are passed on, over a few steps at once, the least per vertex.
        wave = [state.where("new").select(F.col("id").alias("u"), F.col("colour").alias("c"))]
        for _ in range(HOPS):
            wave.append(by_start.join(wave[-1], "u").groupBy(F.col("v").alias("u")).agg(F.min("c").alias("c")))
        offer = reduce(DataFrame.union, wave[1:]).groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        nxt, used = keep(state.join(offer, "id", "left").select("id", F.least("colour", "c").alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("new")), "colour")
        drop(spark, path)
        state, path = nxt, used
    by_start.unpersist()
    return state.select("id", "colour")


def layers(edges: DataFrame, vertices: DataFrame, fit: int = FIT) -> DataFrame:
    """(id, component, layer): longest way from a vertex without predecessors, strongly connected vertices being one."""
    strong, _ = keep(strong_components(edges, fit), "strong")
    named, _ = keep(vertices.select("id").join(strong, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
    steps = directed(edges).join(named.toDF("u", "cu"), "u").join(named.toDF("v", "cv"), "v").where("cu != cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    steps, path = keep(steps, "condensed")
    left, out, layer = named.select(F.col("component").alias("id")).distinct(), [], 0
    while not at_most(steps, fit):
        top, _ = keep(left.join(steps.select(F.col("v").alias("id")), "id", "left_anti"), "layer")
        out.append(top.withColumn("layer", F.lit(layer)))
        left, _ = keep(left.join(top, "id", "left_anti"), "rest")
        nxt, used = keep(steps.join(top.select(F.col("id").alias("u")), "u", "left_anti"), "condensed")
        drop(edges.sparkSession, path)
        steps, path = nxt, used
        layer += 1
    # Vertices that no step is left of come next.
    rest = left.join(layers_in_task(steps), "id", "left").select("id", (F.coalesce("layer", F.lit(0)) + layer).alias("layer"))
    return named.join(reduce(DataFrame.union, [*out, rest]).withColumnRenamed("id", "component"), "component").select("id", "component", "layer")


def is_cyclic(edges: DataFrame) -> bool:
    """Whether any cycle exists, self loops included."""
    return not edges.where("source = target").isEmpty() or not cyclic_core(directed(edges)).isEmpty()


def cycles(edges: DataFrame, cutoff: int) -> DataFrame:
    """(path): elementary cycles of at most ``cutoff`` edges, each from its least vertex; a self loop is a cycle of one.

    Their number can grow exponentially with their length, hence the cutoff; :func:`strong_components` tells
    without one which vertices lie on cycles at all.
    """
    strong, _ = keep(strong_components(edges), "strong")
    e = directed(edges).join(strong.toDF("u", "c"), "u").join(strong.toDF("v", "d"), "v").where("c = d").select("u", "v")
    e, _ = keep(e, "cycle-steps")
    at, found = e.where("v > u").select(F.col("u").alias("start"), F.col("v").alias("at"), F.array("u", "v").alias("path")), []
    for _ in range(2, cutoff + 1):
        if at.isEmpty():
            break
        step = at.join(e.toDF("at", "next"), "at").where("next >= start")
        step, _ = keep(step, "cycle-paths")
        found.append(step.where("next = start").select("path"))
        at = step.where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
    loops = edges.where("source = target").select(F.array("source").alias("path")).distinct()
    return reduce(DataFrame.union, [loops, *found])


#: Open paths of a component beyond which it is too dense to be walked to the end.
OPEN_MOST = 200_000


def all_cycles(edges: DataFrame, most: int = OPEN_MOST) -> DataFrame:
    """(path, truncated): elementary cycles of any length, each from its least vertex; a self loop is a cycle of one.

    Every strongly connected component is walked, in a task of its own, until no path is left open.  One that comes
    to more than ``most`` open paths gives its cycles up to the length reached and a shortest cycle through every one of its edges, all
    flagged as truncated.
    """
    strong, _ = keep(strong_components(edges), "strong")
    e, _ = keep(directed(edges).join(strong.toDF("u", "c"), "u").join(strong.toDF("v", "d"), "v").where("c = d").select("u", "v", "c"), "cycle-steps")
    walked, _ = keep(cycles_in_task(e, most), "cycles")
    loops = edges.where("source = target").select(F.array("source").alias("path")).distinct()
    whole = loops.withColumn("truncated", F.lit(False)).union(walked.where("path is not null").select("path", "truncated"))
    dense = walked.where("path is null").select("c")
    if dense.isEmpty():
        return whole
    shortest, _ = keep(shortest_through_in_tasks(e.join(dense, "c", "left_semi").select("u", "v")), "dense-cycles")
    return whole.union(shortest.withColumn("truncated", F.lit(True))).distinct()
