"""All pairs of similar sets by forests of sorted sketches.

Equal sets are joined as one.  A forest (:mod:`topoweave.llm.forest`) orders the
minhash signatures of the sets in independent trees; sets with a common prefix
of ``DEPTH`` values are neighbours, overfull neighbourhoods are deepened in the
same tree and paid for by further trees until the target recall is reached
again, and what is overfull at full depth is compared whole, in parts.
Neighbours are filtered by an exact upper bound of their overlap from small
bitmaps and sizes, then verified on the whole sets.

The chance that a pair of exactly the threshold is missed is at most
``1 - RECALL``; more similar pairs are missed far less often.  With ``exact`` set
all sets are neighbours, in parts, and nothing is missed, at quadratic cost.

Defined results: a null or empty array has no members; null and blank members
and repeats don't count, surrounding blanks and tabs are no part of a member.
Records of fewer than ``min_size`` members pair with none.  Every pair comes
once with the smaller id first; rows with a null id are ignored and of rows with
the same id one is used.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoweave.llm.forest import grown, in_parts, mixed, pairs_within, signatures
from topoweave.plans.tables import keep

#: Shortest common prefix of neighbours.
DEPTH = 3
#: Sets in one neighbourhood above which it is deepened.
FULL = 1_000
RECALL = 0.999
WORDS = 4  # of 64 bits in a bitmap
QUERY_MEMBERS = 1_000_000


def _hashed(name: str, column: Column) -> Column:
    value = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.btrim(v, F.lit(" \t")))
    return F.transform(F.filter(value, lambda v: v.isNotNull() & (v != "")), lambda v: F.xxhash64(F.lit(name), v))


def members(fields: dict[str, Column]) -> Column:
    """Sorted hashes of the distinct (field, value) members."""
    return F.array_sort(F.array_distinct(F.concat(*[_hashed(name, c) for name, c in fields.items()])))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(n: np.ndarray, most: int):
    """Spans of positions whose counts sum to about ``most``."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def bitmaps(values: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of each set, one bit per member's hash, and how many members fell on a bit already set."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    bit = mixed(values) & np.uint64(words * 64 - 1)
    maps = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return maps, np.diff(offsets) - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)


def _sketcher(first_tree: int, trees: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = lists(batch.column("members"))
            values = values.astype(np.int64).view(np.uint64)
            maps, doubles = bitmaps(values, offsets, WORDS)
            words = [pa.array(np.ascontiguousarray(maps[:, k]).view(np.int64)) for k in range(WORDS)]
            columns = [batch.column("id"), pa.array(np.diff(offsets).astype(np.int32)), pa.array(doubles.astype(np.int32)), *words, *signatures(values, offsets, first_tree, trees)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "doubles", *_WORDS, "hi", "lo"])

    return run


_WORDS = [f"w{k}" for k in range(WORDS)]


def _sketches(sets: DataFrame):
    kind = sets.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n int, doubles int, " + ", ".join(f"{w} bigint" for w in _WORDS) + ", hi array<bigint>, lo array<bigint>"

    def rows(first: int, trees: int, only: DataFrame | None) -> DataFrame:
        some = sets.select("id", "members")
        some = some if only is None else some.join(only, "id", "left_semi")
        return keep(some.mapInArrow(_sketcher(first, trees), schema), "sketches")[0]

    return rows


def _neighbours(rows: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of sets that meet in a place and may be similar by their sizes and bitmaps."""
    own = places.select("node", "id", "own", "whole").join(rows.select("id", "n", "doubles", *_WORDS), "id")
    a, b = own.alias("a"), own.alias("b")
    common = sum((F.bit_count(F.col(f"a.{w}").bitwiseAND(F.col(f"b.{w}"))) for w in _WORDS[1:]), F.bit_count(F.col("a.w0").bitwiseAND(F.col("b.w0"))))
    most = common + F.least("a.doubles", "b.doubles")
    total = F.col("a.n") + F.col("b.n")
    meet = (F.col("a.node") == F.col("b.node")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.whole") | (F.col("a.own") != F.col("b.own")))
    near = (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (threshold - 1e-9)) & (most >= total * (threshold / (1 + threshold) - 1e-9))
    return a.join(b, meet & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def set_classes(records: DataFrame, record_id: str, fields: dict[str, Column], min_size: int) -> tuple[DataFrame, DataFrame]:
    """(id, members) of one record per distinct set, and (id, class) of all records."""
    r = records.select(F.col(record_id).alias("id"), members(fields).alias("members")).where("id is not null").where(F.size("members") >= min_size)
    # A hash of 64 bits over hashes of members stands for the set.
    r, _ = keep(r.withColumn("h", F.xxhash64("members")).dropDuplicates(["id"]), "sets")
    least, _ = keep(r.groupBy("h").agg(F.min("id").alias("class")), "set-classes")
    classes = r.select("id", "h").join(least, "h").select("id", "class")
    return r.join(least.select(F.col("class").alias("id")), "id", "left_semi").select("id", "members"), classes


def similar_sets(records: DataFrame, record_id: str, fields: dict[str, Column], threshold: float = 0.7, min_size: int = 1, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal sets, and the classes.

    ``(a, b, similarity)`` of class representatives with similarity >= threshold, and ``(id, class)`` of all records.
    """
    heads, classes = set_classes(records, record_id, fields, min_size)
    pairs = None
    if exact:
        rows = _sketches(heads)(0, 1, None)
        one = rows.select(F.lit(0).cast("bigint").alias("node"), "id").crossJoin(rows.agg(F.count("*").alias("held")))  # one row
        pairs = _neighbours(rows, in_parts(one, FULL), threshold)
    else:
        for rows, places in grown(_sketches(heads), DEPTH, threshold, RECALL, FULL):
            near = _neighbours(rows, places, threshold)
            pairs = near if pairs is None else pairs.union(near)
    pairs, _ = keep(pairs.distinct(), "set-candidates")
    x = pairs.join(heads.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(heads.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    both = F.size(F.array_intersect("ma", "mb"))
    x = x.withColumn("both", both).withColumn("all", F.size("ma") + F.size("mb") - F.col("both"))
    return x.where(F.col("both") >= F.col("all") * (threshold - 1e-12)).select("a", "b", (F.col("both") / F.col("all")).alias("similarity")), classes


def member_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of records (smaller id first): those of similar classes and those of one class."""
    left = classes.select(F.col("class").alias("a"), F.col("id").alias("ia"))
    right = classes.select(F.col("class").alias("b"), F.col("id").alias("ib"))
    two = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return two.union(pairs_within(classes, "class"))


def partners_in_blocks(queries: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(q, id) of all sets similar to a query, without an index: ``queries`` and ``sets`` hold (id, members).

    Queries go over all sets in blocks of at most about ``QUERY_MEMBERS`` members, each collected and broadcast.
    """
    spark = sets.sparkSession
    total = queries.agg(F.sum(F.size("members"))).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * total / QUERY_MEMBERS))
    cut, _ = keep(queries.select("id", "members", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")), "set-queries")
    kind = sets.schema["id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        q = cut.where(F.col("block") == b).toArrow()
        values, offsets = lists(q.column("members").combine_chunks()) if q.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        # Members of all queries in order of their hash, each with the query it belongs to.
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.argsort(values, kind="stable")
        shared = spark.sparkContext.broadcast((q.column("id").to_numpy(), np.diff(offsets), values[order], owner[order]))
        part = sets.select("id", "members").mapInArrow(_partners(shared, threshold), f"q {kind}, id {kind}")
        out = part if out is None else out.union(part)
    return out


def _partners(shared, threshold: float):
    def run(batches):
        ids, size, value, owner = shared.value
        for batch in batches:
            values, offsets = lists(batch.column("members"))
            mine = batch.column("id").to_numpy()
            rows = max(1, 4_000_000 // max(1, len(ids)))
            for a in range(0, len(mine) if len(ids) else 0, rows):
                o = offsets[a : a + rows + 1]
                v, row = values[o[0] : o[-1]], np.repeat(np.arange(len(o) - 1), np.diff(o))
                lo, hi = np.searchsorted(value, v, "left"), np.searchsorted(value, v, "right")
                both = np.zeros((len(o) - 1) * len(ids), np.int32)
                for c, e in spans(hi - lo, 4_000_000):
                    n = hi[c:e] - lo[c:e]
                    at = np.repeat(lo[c:e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both += np.bincount(np.repeat(row[c:e], n) * len(ids) + owner[at], minlength=len(both)).astype(np.int32)
                both = both.reshape(-1, len(ids))
                ok = both >= (threshold - 1e-12) * (np.diff(o)[:, None] + size[None, :] - both)
                ok &= mine[a : a + rows][:, None] != ids[None, :]
                r, k = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(mine[a : a + rows][r])], ["q", "id"])

    return run
