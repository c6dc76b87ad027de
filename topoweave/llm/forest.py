"""Forests of sorted sketches: which records can be similar, by common prefixes of minhash signatures.

A tree gives every record a signature of ``VALUES`` minhashes.  The signatures of
a tree are put in lexicographic order (range partitions, sorted), where records
of a common prefix are neighbours: a row that shares its shortest prefix with
neither the row before nor the row after has nobody to meet in that tree and is
left out on the spot.  What is left is grouped by that prefix.  A neighbourhood
of more than ``full`` records is not searched there but deepened: its records are
parted by their next value of the same tree, again and again.  At the full
length of the signature nothing is put off any more: an overfull neighbourhood
is cut into parts of which every two meet in a place of their own.

A deeper prefix is shared more rarely, so deepening costs recall.  Every record
therefore has an account: a tree searched at depth k adds -ln(1 - t**k), the
chance that a partner of similarity t is missed in it.  Records whose account is
below -ln(1 - recall) get further trees, among themselves, until all reach it; a
pair is found with the target recall if the account of one of the two is full.

Defined results: records without partners come out nowhere; an empty table gives
no places; the order of rows has no influence.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoweave.plans.tables import drop, keep

#: Minhashes of a tree's signature, ``BITS`` bits of each, three to a 64-bit word.
VALUES = 6
BITS = 21
#: Trees added at once for records whose account is not full.
MORE_TREES = 48


def gain(depth: int, threshold: float) -> float:
    """What a tree searched at ``depth`` adds to a record's account."""
    return -math.log1p(-(threshold**depth))


def trees_for(depth: int, threshold: float, recall: float) -> int:
    return math.ceil(-math.log(1 - recall) / gain(depth, threshold))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def minhash(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Least hash of values[first[i]:first[i+1]] for every set; no set may be empty."""
    with np.errstate(over="ignore"):
        a, b = mixed(np.array([2 * seed + 1, 2 * seed + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = (values ^ a) * (b | np.uint64(1))
        return np.minimum.reduceat(h ^ (h >> np.uint64(32)), first)


def signatures(values: np.ndarray, offsets: np.ndarray, first_tree: int, trees: int) -> list[pa.Array]:
    """List columns ``hi`` and ``lo``: the packed signature of every set in each of the trees."""
    n = len(offsets) - 1
    words = np.zeros((2, trees, n), np.uint64)
    for t in range(trees):
        for v in range(VALUES):
            h = mixed(minhash(values, offsets[:-1], (first_tree + t) * VALUES + v)) >> np.uint64(64 - BITS)
            words[v // 3, t] = (words[v // 3, t] << np.uint64(BITS)) | h
    at = pa.array(np.arange(n + 1, dtype=np.int32) * trees)
    return [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(w.T).reshape(-1).view(np.int64))) for w in words]


def _prefix(depth: int) -> list[Column]:
    """The first ``depth`` values of a row's signature."""
    if depth <= 3:
        return [F.shiftright("hi", BITS * (3 - depth))]
    return [F.col("hi"), F.shiftright("lo", BITS * (VALUES - depth))]


def _companions(depth: int):
    """Rows sorted by (tree, signature) that share a prefix of ``depth`` <= 3 values with the row before or after.

    The first and the last row of a partition stay, as their neighbours may lie in another one.  ``before`` is the id
    of the row before, where that shares three values.
    """

    def run(batches):
        held, first, linked = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            tree, hi, ids, n = rows.column("tree").to_numpy(), rows.column("hi").to_numpy(), rows.column("id"), rows.num_rows
            same = (tree[1:] == tree[:-1]) & (hi[1:] >> (BITS * (3 - depth)) == hi[:-1] >> (BITS * (3 - depth)))
            wanted = np.concatenate(([linked], same)) | np.concatenate((same, [False]))
            before = ids.take(pa.array(np.arange(n - 1), mask=~(same & (hi[1:] == hi[:-1]))))
            before = pa.concat_arrays([pa.nulls(1, ids.type) if first is None else first, before])
            out = pa.RecordBatch.from_arrays([*rows.columns, before], [*rows.schema.names, "before"])
            yield out.slice(0, n - 1).filter(pa.array(wanted[:-1]))
            held, first, linked = rows.slice(n - 1), before.slice(n - 1), bool(wanted[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, first], [*held.schema.names, "before"])

    return run


def in_parts(places: DataFrame, full: int) -> DataFrame:
    """``places`` (node, id, held, ..) with nodes above ``full`` cut into parts of about ``full`` / 2, every two of which meet.

    Adds ``own``, the part of a row, and ``whole``: whether rows of one part are to be compared in this place.
    """
    parts = F.when(F.col("held") > full, F.ceil(2 * F.col("held") / full)).otherwise(F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    x = places.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    node = F.when(parts == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    return x.withColumn("node", node).withColumn("whole", F.col("own") == F.col("other")).drop("other")


def _neighbourhoods(rows: DataFrame, depth: int, threshold: float, full: int, link: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame | None]:
    """Places (node, id, own, whole, hi, lo) of one set of trees; and (id, loss) of the accounts, None if nothing was deepened."""
    kind = rows.schema["id"].dataType.simpleString()
    at = rows.select("id", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "s")).select("tree", "s.hi", "s.lo", "id")
    order = ["tree", "hi", "lo", "id"]
    # The id as last key lets the range partitions cut an overfull neighbourhood too.
    at, _ = keep(at.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_companions(min(depth, 3)), f"tree int, hi bigint, lo bigint, id {kind}, before {kind}"), "sorted-sketches")
    group = F.col("id")
    if link is not None:
        near = at.where("before is not null and before != id").select(F.least("before", "id").alias("a"), F.greatest("before", "id").alias("b")).distinct()
        at, group = at.join(link(near), "id", "left"), F.coalesce("group", "id")
    at = at.select("tree", "hi", "lo", "id", group.alias("group"))
    found, lost = [], []
    for k in range(depth, VALUES + 1):
        keyed = at.select(F.xxhash64("tree", F.lit(k), *_prefix(k)).alias("node"), "tree", "hi", "lo", "id", "group")
        # Sizes come from partial sums and are joined back: no neighbourhood is gathered in one task.
        held = keyed.groupBy("node").agg(F.count("*").alias("held"), (F.min("group") != F.max("group")).alias("open")).where("held > 1 and open").drop("open")
        x, _ = keep(keyed.join(held, "node"), "neighbourhoods")
        last = k == VALUES
        here = in_parts(x if last else x.where(f"held <= {full}"), full)
        found.append(here.select("node", "id", "own", "whole", "hi", "lo", "group"))
        over = x.where(f"held > {full}").drop("held", "node")
        if last or over.isEmpty():
            break
        at = over
        lost.append(over.groupBy("id").agg((F.count("*") * (gain(k, threshold) - gain(k + 1, threshold))).alias("loss")))
    losses = reduce(DataFrame.unionByName, lost).groupBy("id").agg(F.sum("loss").alias("loss")) if lost else None
    return reduce(DataFrame.unionByName, found), losses


def grown(
    sketches: Callable[[int, int, DataFrame | None], DataFrame], depth: int, threshold: float, recall: float, full: int, link: Callable[[DataFrame], DataFrame] | None = None
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Sketches and places, one set of trees after the other, until every account is full.

    ``sketches(first tree, number of trees, ids or None for all)`` gives rows with (id, hi, lo).  Where only groups of
    connected records are wanted, ``link`` is told pairs (a, b) that lie side by side in a tree and gives (id, group)
    of what is connected so far; places all of one group are settled: neither searched nor deepened nor paid for.
    """
    need = -math.log(1 - recall)
    first, trees, only, account = 0, trees_for(depth, threshold, recall), None, None
    while True:
        rows = sketches(first, trees, only)
        places, lost = _neighbourhoods(rows, depth, threshold, full, link)
        yield rows, places
        if lost is None:
            return
        had = account if account is not None else rows.select("id", F.lit(0.0).alias("had"))
        now = had.join(lost, "id", "left").select("id", (F.col("had") + trees * gain(depth, threshold) - F.coalesce("loss", F.lit(0.0))).alias("had"))
        account, _ = keep(now.where(F.col("had") < need), "accounts")
        least = account.agg(F.min("had")).first()[0]
        if least is None:
            return
        only, first = account.select("id"), first + trees
        trees = min(MORE_TREES, math.ceil((need - least) / gain(VALUES, threshold)))


def pairs_within(rows: DataFrame, group: str, full: int = 2_000) -> DataFrame:
    """(a, b), a < b, of all ``id`` of one group; a group of very many rows is paired part by part in places of their own."""
    held = rows.groupBy(group).agg(F.count("*").alias("held")).where("held > 1")
    x = in_parts(rows.select(F.col(group).alias("node"), "id").join(held.withColumnRenamed(group, "node"), "node").withColumn("node", F.xxhash64("node")), full)
    a, b = x.alias("a"), x.alias("b")
    meet = (F.col("a.node") == F.col("b.node")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.whole") | (F.col("a.own") != F.col("b.own")))
    return a.join(b, meet).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
