"""Most similar vectors of every vector, by a neighbour graph grown with Spark joins.

The graph is begun in random projection trees (splits fitted on a bounded
sample, every vector indexed) and then improved by NN-descent: each round joins
every vector's neighbours and reverse neighbours with each other, neighbours of
neighbours becoming neighbours where they are nearer, until few lists change or
``ROUNDS`` are over.  Queries walk the graph greedily from the leaves they fall
into.  Vectors travel as 8-bit codes of their unit vector, a quarter of their
size; what is returned is measured again on the exact vectors.

Equal vectors are one vertex, and vertices of equal code one cell of the graph, so
that copies, however many, neither crowd a leaf nor a list.  Codes cannot rank
vectors that differ by less than a code step or little more; where more than ``K``
vertices lie within a similarity of ``FINE``, they and what is linked to them get
a graph of their own on exact vectors and squared distances.  The fitted trees are of a depth that their sample can bear; larger
leaves are halved further along random directions in the task that holds them.
In-degrees are unbounded, so a round takes the ``K`` nearest
reverse neighbours of each vertex, chosen before the shuffle as well as after.
The result is approximate; :func:`brute_force` measures the recall.

Defined results: vectors that are null, of another length, with null or
non-finite values or all zero are not usable and come out nowhere; of usable
rows of one owner the one of greatest (time, id) counts, rows without owner each
count by themselves; equal similarities are ordered by id; fewer than k usable
vectors give shorter lists.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoweave.plans.tables import drop, keep

K = 40
TREES = 8
LEAF = 160
LEAF_ROWS = 50_000
#: Vectors (those of least id hash) on which the splits of the trees are fitted.
SAMPLE = 20_000
ROUNDS = 7
#: Rounds end when fewer than this share of all list entries changed.
LEAST_CHANGE = 0.01
#: Similarity from which codes no longer rank neighbours safely (their error is then some hundredths of the distance).
FINE = 0.98
BEAM = 96
#: Nearest vertices of a query whose neighbours are measured exactly at the end of its search.
LAST_OPENED = 3
#: Vectors of a leaf (those of least id hash) from which a search that falls into it begins.
ENTRIES = 320
OPENED = 12
QUERY_BLOCK = 2_000
#: Below every cosine and every negative squared distance of unit vectors.
UNKNOWN = -9.0

#: Lists travel whole, a row per vertex and source of candidates.
_ROW = "id bigint, nbrs array<bigint>, sims array<float>, fresh array<boolean>"


def usable(df: DataFrame, vec_id: str, owner: str, vector: str, time: str, length: int) -> DataFrame:
    """(id, vector) of the current usable row of every owner."""
    v = F.col(vector)
    good = (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(vec_id).isNotNull()).where(F.coalesce(good, F.lit(False))).select(F.col(vec_id).alias("id"), v.alias("vector"), F.col(owner).alias("owner"), F.col(time).alias("time"))
    key = F.coalesce(F.concat(F.lit("o"), F.col("owner").cast("string")), F.concat(F.lit("i"), F.col("id").cast("string")))
    last = rows.groupBy(key.alias("key")).agg(F.max(F.struct("time", "id")).alias("m")).select(F.col("m.id").alias("id"))
    return rows.select("id", "vector").join(last, "id", "left_semi").dropDuplicates(["id"])


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def _codes(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("vector"))
        x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        scale = 127.0 / np.abs(x).max(axis=1, keepdims=True)
        q = np.round(x * scale).astype(np.int8)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "code"])


def units(column) -> np.ndarray:
    """Unit vectors (float32) of a column of codes."""
    raw = column.to_pylist()
    x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in _matrix(batch.column("vector"), np.float32)], pa.binary())], ["id", "code"])


def exact_units(column) -> np.ndarray:
    """Unit vectors (float64) of a column of whole vectors."""
    raw = column.to_pylist()
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _similarities(v: np.ndarray) -> np.ndarray:
    """Of all pairs of rows: cosines of decoded codes, negative squared distances of whole vectors, which keep their precision near 0."""
    if v.dtype == np.float32:
        return v @ np.swapaxes(v, -1, -2)
    c = v - v[..., :1, :]
    q = (c * c).sum(axis=-1)
    return np.minimum(2 * (c @ np.swapaxes(c, -1, -2)) - q[..., :, None] - q[..., None, :], 0)


def vertices(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, code) of one vertex per distinct vector, and (id, vertex) of all vectors."""
    v = vectors.withColumn("h", F.xxhash64("vector"))
    least, _ = keep(v.groupBy("h").agg(F.min("id").alias("vertex")), "vertices")
    owners = v.select("id", "h").join(least, "h").select("id", "vertex")
    heads = vectors.join(least.select(F.col("vertex").alias("id")), "id", "left_semi")
    codes, _ = keep(heads.mapInArrow(_codes, "id bigint, code binary"), "codes")
    return codes, owners


class Trees:
    """Random projection trees: one direction per level and tree, a threshold per node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.direction = rng.standard_normal((trees, depth, width)).astype(np.float32)
        self.threshold = [[np.zeros(1 << level, np.float32) for level in range(depth)] for _ in range(trees)]
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                p = sample @ self.direction[t, level]
                order = np.lexsort((p, node))
                held = np.bincount(node, minlength=1 << level)
                middle = np.cumsum(held) - held + held // 2
                some = held > 0
                self.threshold[t][level][some] = p[order[middle[some]]]
                node = 2 * node + (p >= self.threshold[t][level][node])

    def leaves(self, x: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for level, threshold in enumerate(self.threshold[t]):
            node = 2 * node + (x @ self.direction[t, level] >= threshold[node])
        return node


def fit_trees(codes: DataFrame, total: int, trees: int = TREES, decode=units) -> Trees:
    """Trees of as many levels as the sample can fit; leaves above ``LEAF`` are split further where they lie.

    Beyond that depth only so many levels are added as keep a leaf at about ``LEAF_ROWS`` vectors.
    """
    depth = max(0, math.ceil(math.log2(max(1, total) / LEAF)))
    depth = max(min(depth, int(math.log2(SAMPLE / 32))), math.ceil(math.log2(max(1, total) / LEAF_ROWS)))
    some = codes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("code").toArrow()
    return Trees(decode(some.column("code")) if some.num_rows else np.zeros((0, 1), np.float32), depth, trees)


def leaf_rows(codes: DataFrame, shared, trees: int, decode=units) -> DataFrame:
    """(leaf, id, code) for every vertex and tree."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = decode(batch.column("code"))
                for t in range(trees):
                    leaf = shared.value.leaves(x, t) * TREES + t
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("id"), batch.column("code")], ["leaf", "id", "code"])

    return codes.mapInArrow(run, "leaf bigint, id bigint, code binary")


def _grouped(batches, key: str):
    """Whole groups of rows sorted by ``key``, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spans(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return first, np.diff(np.append(first, len(k)))


def _listed(id_: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries in order of id as a row per id."""
    first, _ = _spans(id_)
    offsets = pa.array(np.append(first, len(id_)).astype(np.int32))
    fresh = np.ones(len(id_), bool) if fresh is None else fresh
    wrap = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
    return pa.RecordBatch.from_arrays([pa.array(id_[first]), wrap(nbr), wrap(sim.astype(np.float32)), wrap(fresh)], ["id", "nbrs", "sims", "fresh"])


def flat(graph: DataFrame) -> DataFrame:
    """(id, nbr, sim, fresh) of lists."""
    return graph.select("id", F.inline(F.arrays_zip("nbrs", "sims", "fresh"))).toDF("id", "nbr", "sim", "fresh")


def _split(rows: np.ndarray, x: np.ndarray, most: int, seed: int):
    """Parts of at most ``most`` rows, halved again and again along random directions."""
    todo, rng = [rows], np.random.default_rng(seed)
    while todo:
        part = todo.pop()
        if len(part) <= most:
            yield part
            continue
        order = part[np.argsort(x[part] @ rng.standard_normal(x.shape[1]).astype(np.float32), kind="stable")]
        todo += [order[: len(part) // 2], order[len(part) // 2 :]]


def _leaf_lists(k: int, decode=units):
    """The k nearest of every row inside its leaf."""

    def run(batches):
        for t in _grouped(batches, "leaf"):
            ids, x = t.column("id").to_numpy(), decode(t.column("code"))
            out: list[tuple] = []
            for first, n in zip(*_spans(t.column("leaf").to_numpy())):
                for part in _split(np.arange(first, first + n), x, 2 * LEAF, int(t.column("leaf")[first].as_py())):
                    if len(part) < 2:
                        continue
                    s = _similarities(x[part])
                    np.fill_diagonal(s, UNKNOWN)
                    m = min(k, len(part) - 1)
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    out.append((np.repeat(ids[part], m), ids[part][best].reshape(-1), np.take_along_axis(s, best, 1).reshape(-1)))
            if out:
                yield _listed(*map(np.concatenate, zip(*out)))

    return run


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of every id; an entry also known before is not fresh."""
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(_best(k), _ROW)


def _best(k: int):
    def run(batches):
        for t in _grouped(batches, "id"):
            lists = [t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c) for c in ("nbrs", "sims", "fresh")]
            n, s, f = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            i = np.repeat(t.column("id").to_numpy(), np.diff(lists[0].offsets.to_numpy()))
            order = np.lexsort((f, n, i))
            i, n, s, f = i[order], n[order], s[order], f[order]
            new = np.concatenate(([True], (i[1:] != i[:-1]) | (n[1:] != n[:-1])))
            i, n, s, f = i[new], n[new], s[new], f[new]
            order = np.lexsort((n, -s, i))
            i, n, s, f = i[order], n[order], s[order], f[order]
            first, size = _spans(i)
            top = np.arange(len(i)) - np.repeat(first, size) < k
            yield _listed(i[top], n[top], s[top], f[top])

    return run


def _local_join(decode=units):
    """All pairs of members of a centre of which one is fresh, where they would enter a list."""

    def run(batches):
        for t in _grouped(batches, "centre"):
            first, size = _spans(t.column("centre").to_numpy())
            ids, x = t.column("member").to_numpy(), decode(t.column("code"))
            fresh, worst = t.column("fresh").to_numpy(), t.column("worst").to_numpy()
            width = int(size.max())
            for g in range(0, len(first), 512):
                fs, sz = first[g : g + 512], size[g : g + 512]
                at = fs[:, None] + np.minimum(np.arange(width)[None, :], sz[:, None] - 1)
                real = np.arange(width)[None, :] < sz[:, None]
                v = x[at]
                s = _similarities(v)
                i, f, w = ids[at], fresh[at], worst[at]
                ok = real[:, :, None] & real[:, None, :] & (f[:, :, None] | f[:, None, :]) & (i[:, :, None] != i[:, None, :]) & (s > w[:, :, None])
                b, p, q = np.nonzero(ok)
                if len(b):
                    left, right, sim = i[b, p], i[b, q], s[b, p, q]
                    order = np.lexsort((right, left))
                    left, right, sim = left[order], right[order], sim[order]
                    new = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
                    yield _listed(left[new], right[new], sim[new])

    return run


def neighbour_graph(codes: DataFrame, k: int = K, trees: int = TREES, rounds: int = ROUNDS, decode=units) -> tuple[DataFrame, DataFrame]:
    """(id, nbr, sim, fresh) of the k nearest vertices of every vertex, sim from what ``decode`` makes of ``code``; and (leaf, id) of all trees."""
    spark = codes.sparkSession
    total = codes.count()
    shared = spark.sparkContext.broadcast(fit_trees(codes, total, trees, decode))
    leaves = leaf_rows(codes, shared, trees, decode)
    start = leaves.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_leaf_lists(k // 2, decode), _ROW)
    graph, path = keep(best(start, k), "graph")
    for _ in range(rounds):
        entries = flat(graph)
        # Lists that are not full yet take anything.
        worst = graph.select(F.col("id").alias("member"), F.when(F.size("nbrs") >= k, F.array_min("sims")).otherwise(F.lit(UNKNOWN)).cast("float").alias("worst"))
        nearest = Window.partitionBy("centre").orderBy(F.desc("sim"), "member")
        back = entries.select(F.col("nbr").alias("centre"), F.col("id").alias("member"), "sim", "fresh").withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).drop("nth")
        members = entries.select(F.col("id").alias("centre"), F.col("nbr").alias("member"), "sim", "fresh").unionByName(back)
        members = members.groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
        vectors = codes.withColumnRenamed("id", "member").join(worst, "member", "left").fillna(UNKNOWN, ["worst"])
        local = members.join(vectors, "member").select("centre", "member", "fresh", "worst", "code")
        found = local.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join(decode), _ROW)
        known = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
        nxt, used = keep(best(known.unionByName(found), k), "graph")
        drop(spark, path)
        graph, path = nxt, used
        changed = flat(graph).agg(F.try_divide(F.count_if("fresh"), F.count("*"))).first()[0]
        if (changed or 0) < LEAST_CHANGE:
            break
    return flat(graph), leaves.select("leaf", "id")


def vector_graph(vectors: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, nbr, sim) of near vertices of every vertex of ``codes``, crowded places settled on exact vectors; and (leaf, id) of the cells.

    A cell, the vertices of one code, goes by its least id.  It is crowded if it and its
    neighbours of at least ``FINE`` hold more than ``K`` vertices.  Links between other
    cells are links of all their vertices, fewer than ``K`` a cell.
    """
    cells, _ = keep(codes.groupBy("code").agg(F.min("id").alias("cell"), F.count("*").alias("n")), "cells")
    coarse, leaves = neighbour_graph(cells.select(F.col("cell").alias("id"), "code"))
    coarse = coarse.select("id", "nbr", "sim")
    shared_cells, _ = keep(codes.join(cells.where("n > 1"), "code").select("id", "cell", "n"), "shared-cells")
    sizes = shared_cells.select("cell", "n").distinct()
    # Only surplus vertices need counting: every neighbour is one, and one more for each further vertex of its cell.
    surplus = coarse.where(F.col("sim") >= FINE).join(sizes.withColumnRenamed("cell", "nbr"), "nbr", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("m"))
    held = surplus.unionByName(sizes.select(F.col("cell").alias("id"), (F.col("n") - 1).alias("m")))
    # A full list that ends above FINE has no room for more, so it may hide others.
    crowded, _ = keep(held.groupBy("id").agg(F.sum("m").alias("m")).where(F.col("m") >= K).select("id"), "crowded")
    loose, _ = keep(shared_cells.join(crowded.withColumnRenamed("id", "cell"), "cell", "left_anti").select("cell", F.col("id").alias("member")), "loose")
    if not loose.isEmpty():
        to = coarse.join(loose.toDF("nbr", "b"), "nbr", "left").withColumn("nbr", F.coalesce("b", "nbr"))
        both = to.join(loose.toDF("id", "a"), "id", "left").select(F.coalesce("a", "id").alias("id"), "nbr", "sim")
        inside = loose.toDF("cell", "id").join(loose.toDF("cell", "nbr"), "cell").where("id != nbr").select("id", "nbr", F.lit(1.0).cast("float").alias("sim"))
        coarse = both.unionByName(inside)
    if crowded.isEmpty():
        return coarse, leaves
    # Cells of all vertices near a crowded one, and their whole vectors.
    touching = coarse.join(crowded, "id", "left_semi").select(F.col("nbr").alias("id")).union(coarse.join(crowded.toDF("nbr"), "nbr", "left_semi").select("id")).union(crowded).distinct()
    members = touching.union(shared_cells.join(touching.toDF("cell"), "cell", "left_semi").select("id")).distinct()
    whole, _ = keep(vectors.join(members, "id", "left_semi").select("id", "vector").mapInArrow(_raw, "id bigint, code binary"), "whole")
    fine, _ = neighbour_graph(whole, decode=exact_units)
    fine = fine.select("id", "nbr", (1 + F.col("sim") / 2).cast("float").alias("sim"))
    return coarse.unionByName(fine).groupBy("id", "nbr").agg(F.max("sim").alias("sim")), leaves


def _cosines(batches):
    for batch in batches:
        if batch.num_rows:
            x, y = (_matrix(batch.column(c)) for c in ("va", "vb"))
            # Scaling by the greatest value first keeps squares of huge or tiny values in range.
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            s = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], ["a", "b", "similarity"])


def exact(pairs: DataFrame, vectors: DataFrame, a: str = "id", b: str = "nbr") -> DataFrame:
    """``pairs`` with the exact cosine of their vectors as ``similarity``."""
    v = vectors.select("id", "vector")
    x = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    return x.select("a", "b", "va", "vb").mapInArrow(_cosines, "a bigint, b bigint, similarity double").toDF(a, b, "similarity")


def nearest_pairs(vectors: DataFrame, graph: DataFrame, owners: DataFrame, k: int = 5, least: float = -1.0) -> DataFrame:
    """(id, nbr, similarity, rank) of the k most similar vectors of every vector, of exact similarity >= least.

    Copies of one vector count each; of a class of copies only the k + 1 of least id can be among anyone's nearest.
    """
    near = graph.where(F.col("sim") >= least - 0.03).select("id", "nbr")
    several = owners.groupBy("vertex").agg(F.count("*").alias("n")).where("n > 1").select(F.col("vertex").alias("id"), F.col("vertex").alias("nbr"))
    return _nearest_rows(near.union(several).toDF("vertex", "nbr_vertex"), owners, owners, vectors, k, least)


def _nearest_rows(vertex_pairs: DataFrame, asked: DataFrame, owners: DataFrame, vectors: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(id, nbr, similarity, rank): the k nearest rows of every row of ``asked`` (id, vertex) among those of its vertex pairs."""
    some = owners.withColumn("nth", F.row_number().over(Window.partitionBy("vertex").orderBy("id"))).where(F.col("nth") <= k + 1).select(F.col("vertex").alias("nbr_vertex"), F.col("id").alias("nbr"))
    pairs = vertex_pairs.join(asked, "vertex").join(some, "nbr_vertex").where("id != nbr").select("id", "nbr")
    ranked = exact(pairs, vectors).where(F.col("similarity") >= least)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "nbr")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_rows(queries: DataFrame, vectors: DataFrame, codes: DataFrame, owners: DataFrame, graph: DataFrame, leaves: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, similarity) of the k nearest other rows of every row of ``queries`` (column id), by one greedy search per distinct vector."""
    shared = codes.sparkSession.sparkContext.broadcast(fit_trees(codes, codes.count()))
    asked, _ = keep(owners.join(queries.select("id"), "id", "left_semi").select("id", "vertex"), "asked")
    own = asked.select(F.col("vertex").alias("id")).distinct()
    begun = leaf_rows(codes.join(own, "id", "left_semi"), shared, TREES).groupBy("id", "code").agg(F.collect_list("leaf").alias("leaves")).withColumnRenamed("id", "query")
    # A query's own vertex takes one of the places and holds its copies.
    found = search(begun, codes, graph, leaves, k + 1).select("query", "id").union(own.select("id", "id")).distinct()
    # Codes do not order near-copies: the neighbours of the exactly nearest are measured too.
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    best_, _ = keep(exact(found, vectors, "query", "id").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= LAST_OPENED).select("query", "id"), "nearest-found")
    beside = best_.join(graph.select("id", "nbr"), "id").select("query", F.col("nbr").alias("id"))
    rows = _nearest_rows(found.union(beside).distinct().toDF("vertex", "nbr_vertex"), asked, owners, vectors, k)
    return rows.select(F.col("id").alias("query"), F.col("nbr").alias("id"), "similarity")


def _scores(batches):
    for batch in batches:
        if batch.num_rows:
            s = (units(batch.column("query_code")) * units(batch.column("code"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(s.astype(np.float32))], ["query", "id", "sim"])


def search(queries: DataFrame, codes: DataFrame, graph: DataFrame, leaves: DataFrame, k: int = 5, beam: int = BEAM, rounds: int = 12) -> DataFrame:
    """(query, id, sim) of the k nearest vertices of each (query, leaf list, query_code), by greedy search.

    Every round opens the nearest unopened vertices of each query's beam and measures their neighbours
    (in either direction) that were not met before, until no beam has an unopened vertex.
    """
    spark = codes.sparkSession
    links, p0 = keep(
        graph.select("id", "nbr").union(graph.withColumn("nth", F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("sim"), "id"))).where(F.col("nth") <= K).select("nbr", "id")).distinct(), "links"
    )
    q = queries.select("query", F.col("code").alias("query_code"))
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    measure = lambda pairs: pairs.join(q, "query").join(codes, "id").select("query", "query_code", "id", "code").mapInArrow(_scores, "query bigint, id bigint, sim float")
    few = leaves.withColumn("nth", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id"))).where(F.col("nth") <= ENTRIES)
    entry = queries.select("query", F.explode("leaves").alias("leaf")).join(few, "leaf").select("query", "id").distinct()
    met = measure(entry).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= beam).drop("nth")
    state, path = keep(met.withColumn("opened", F.lit(False)), "beam")
    for _ in range(rounds):
        todo = state.where("not opened").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= OPENED).select("query", "id")
        if todo.isEmpty():
            break
        fresh = todo.join(links, "id").select("query", F.col("nbr").alias("id")).distinct().join(state.select("query", "id"), ["query", "id"], "left_anti")
        seen = state.join(todo.withColumn("now", F.lit(True)), ["query", "id"], "left").withColumn("opened", F.col("opened") | F.coalesce("now", F.lit(False))).drop("now")
        nxt = seen.unionByName(measure(fresh).withColumn("opened", F.lit(False)))
        nxt, used = keep(nxt.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= beam).drop("nth"), "beam")
        drop(spark, path)
        state, path = nxt, used
    drop(spark, p0)
    return state.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("query", "id", "sim")


def brute_force(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity) of the exact k nearest of each (id, vector) of ``queries``, itself left out; queries go over all rows in blocks."""
    spark = vectors.sparkSession
    n = max(1, math.ceil(1.25 * queries.count() / QUERY_BLOCK))
    numbered, _ = keep(queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")), "queries")
    out = None
    for b in range(n):
        block = numbered.where(F.col("block") == b).toArrow()
        if not block.num_rows:
            continue
        x = _matrix(block.column("vector").combine_chunks())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((block.column("id").to_numpy(), x))
        part = vectors.select("id", "vector").mapInArrow(_nearest_of_block(shared, k), "query bigint, id bigint, similarity double")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")


def _nearest_of_block(shared, k: int):
    def run(batches):
        ids, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, y = batch.column("id").to_numpy(), _matrix(batch.column("vector"))
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            s = np.where(ids[:, None] == own[None, :], -2.0, x @ y.T)
            m = min(k, len(own))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            sim = np.take_along_axis(s, top, 1).reshape(-1)
            ok = sim > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)[ok]), pa.array(own[top].reshape(-1)[ok]), pa.array(sim[ok])], ["query", "id", "similarity"])

    return run
