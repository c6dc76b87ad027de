"""Graph steps that one task finishes by itself, on ids coded as numbers.

Long chains and nested components cost the distributed operators many short
rounds, each of several jobs.  They hand over what is left of a graph as soon as
it has at most ``FIT`` steps, which one Python worker holds in some hundred
megabytes; above that they go on in rounds of all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps that are handed to one task.
FIT = 2_000_000
#: Vertices from which a component's cycles are walked at once.
STARTS = 1_000
#: Vertices of paths that are compared at once.
HELD = 4_000_000
#: Tasks among which shortest cycles are shared out at most; each of them gets all steps.
SHARES = 48


def _coded(batches, *columns: str) -> tuple[pa.Array | None, list[np.ndarray]]:
    """The distinct ids of the columns (None without rows), and each column as numbers of ids."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None, [np.zeros(0, np.int64) for _ in columns]
    coded = pa.concat_arrays([b.column(c) for c in columns for b in held]).dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy().astype(np.int64), len(columns))


def _laid(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ends of each start begin, and the ends in order of their starts."""
    return np.concatenate(([0], np.cumsum(np.bincount(u, minlength=n)))), v[np.argsort(u, kind="stable")]


def _ends(at: np.ndarray, begin: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The ends of all steps from the vertices ``at``."""
    size = begin[at + 1] - begin[at]
    return to[np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _peeled(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps left when vertices without a step in or out are peeled off."""
    gone = np.zeros(n, bool)
    for a, b in ((u, v), (v, u)):
        (begin, to), into = _laid(a, b, n), np.bincount(b, minlength=n)
        top = np.flatnonzero(into == 0)
        while len(top):
            gone[top] = True
            met, times = np.unique(_ends(top, begin, to), return_counts=True)
            into[met] -= times
            top = met[into[met] == 0]
    inner = ~gone[u] & ~gone[v]
    return u[inner], v[inner]


def _strong(u: np.ndarray, v: np.ndarray, n: int) -> list[list[int]]:
    """Strongly connected components of more than one vertex, by one walk in depth with its own stack."""
    begin, to = (x.tolist() for x in _laid(u, v, n))
    order, low, on, out = [-1] * n, [0] * n, bytearray(n), []
    at, path, trail, seen = begin[:-1], [], [], 0
    for root in np.unique(u).tolist():
        if order[root] >= 0:
            continue
        trail.append(root)
        while trail:
            x = trail[-1]
            if order[x] < 0:
                order[x] = low[x] = seen
                seen += 1
                path.append(x)
                on[x] = 1
            if at[x] < begin[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if order[y] < 0:
                    trail.append(y)
                elif on[y]:
                    low[x] = min(low[x], order[y])
                continue
            trail.pop()
            if trail:
                low[trail[-1]] = min(low[trail[-1]], low[x])
            if low[x] == order[x]:
                one = []
                while not one or one[-1] != x:
                    one.append(path.pop())
                    on[one[-1]] = 0
                if len(one) > 1:
                    out.append(one)
    return out


def strong_in_task(steps: DataFrame) -> DataFrame:
    """(id, component) of the vertices of (u, v) in strongly connected components of more than one vertex; named by their least id."""

    def run(batches):
        ids, (u, v) = _coded(batches, "u", "v")
        if ids is None:
            return
        u, v = _peeled(u, v, len(ids))
        strong = _strong(u, v, len(ids))
        own = ids.take(pa.array([x for one in strong for x in one], pa.int64())).to_pylist()
        ends = np.cumsum([0, *map(len, strong)])
        least = [m for a, b in zip(ends, ends[1:]) for m in [min(own[a:b])] * (b - a)]
        yield pa.RecordBatch.from_arrays([pa.array(own, ids.type), pa.array(least, ids.type)], ["id", "component"])

    kind = steps.schema["u"].dataType.simpleString()
    return steps.select("u", "v").repartition(1).mapInArrow(run, f"id {kind}, component {kind}")


def layers_in_task(steps: DataFrame) -> DataFrame:
    """(id, layer) of the vertices of (u, v), which have no cycle: the longest way from a vertex without a step in."""

    def run(batches):
        ids, (u, v) = _coded(batches, "u", "v")
        if ids is None:
            return
        (begin, to), into = _laid(u, v, len(ids)), np.bincount(v, minlength=len(ids))
        top, layer = np.flatnonzero(into == 0), 0
        while len(top):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(top)), pa.array(np.full(len(top), layer, np.int32))], ["id", "layer"])
            met, times = np.unique(_ends(top, begin, to), return_counts=True)
            into[met] -= times
            top, layer = met[into[met] == 0], layer + 1

    return steps.select("u", "v").repartition(1).mapInArrow(run, f"id {steps.schema['u'].dataType.simpleString()}, layer int")


def components_in_task(pairs: DataFrame) -> DataFrame:
    """(id, component) of the vertices of (u, v), taken in both directions; named by their least id."""

    def run(batches):
        ids, (u, v) = _coded(batches, "u", "v")
        if ids is None:
            return
        order = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        u, v, least = rank[u], rank[v], np.arange(len(ids))
        while len(u):
            a, b = least[u], least[v]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while (least[least] != least).any():
                least = least[least]
            apart = least[u] != least[v]
            u, v = u[apart], v[apart]
        ids = ids.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(least))], ["id", "component"])

    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.select("u", "v").repartition(1).mapInArrow(run, f"id {kind}, component {kind}")


def closure_in_task(steps: DataFrame) -> DataFrame:
    """(id) of everything that (u, v) lead to from the seeds, which are given as steps to themselves, the seeds included."""

    def run(batches):
        ids, (u, v) = _coded(batches, "u", "v")
        if ids is None:
            return
        (begin, to), met = _laid(u, v, len(ids)), np.zeros(len(ids), bool)
        at = np.unique(u[u == v])
        while len(at):
            met[at] = True
            at = np.unique(_ends(at, begin, to))
            at = at[~met[at]]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(met)))], ["id"])

    return steps.select("u", "v").repartition(1).mapInArrow(run, f"id {steps.schema['u'].dataType.simpleString()}")


def _in_order(u: pa.Array, v: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct ids in their order, and both columns as numbers that keep it."""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, v = np.split(rank[coded.indices.to_numpy()], 2)
    return coded.dictionary.take(pa.array(order)), u, v


def _walked(u: np.ndarray, v: np.ndarray, n: int, most: int) -> tuple[dict[int, list[np.ndarray]], bool]:
    """The elementary cycles by their length, a row each from its least vertex; whether some length came to more than ``most`` open paths, which ends all beyond it."""
    (begin, to), up = _laid(u, v, n), v > u
    found, held, last, widest = {}, {}, n, int(np.diff(begin).max())
    first = np.unique(u[up])
    for a in range(0, len(first), STARTS):
        own = up & np.isin(u, first[a : a + STARTS])
        open_, size = np.stack([u[own], v[own]], 1).astype(np.int32), 2
        while len(open_) and size <= last:
            held[size] = held.get(size, 0) + len(open_)
            if held[size] > most:
                last = size - 1
                break
            grown, n_grown, cut = [], 0, max(1, HELD // (widest * size))
            for k in range(0, len(open_), cut):
                part = open_[k : k + cut]
                end = part[:, -1]
                row, nxt = np.repeat(np.arange(len(part)), begin[end + 1] - begin[end]), _ends(end, begin, to).astype(np.int32)
                back, on = nxt == part[row, 0], nxt > part[row, 0]
                if back.any():
                    found.setdefault(size, []).append(part[row[back]])
                row, nxt = row[on], nxt[on]
                new = (part[row] != nxt[:, None]).all(1)
                # More than ``most`` end the walk whatever they are.
                if n_grown <= most:
                    grown.append(np.concatenate([part[row[new]], nxt[new, None]], 1))
                    n_grown += len(grown[-1])
            open_, size = np.concatenate(grown), size + 1
    return {k: x for k, x in found.items() if k <= last}, last < n


def _paths(ids: pa.Array, rows: np.ndarray) -> pa.Array:
    """Rows of numbers as lists of ids."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), ids.take(pa.array(rows.ravel())))


def cycles_in_task(steps: DataFrame, most: int) -> DataFrame:
    """(c, path, truncated): the elementary cycles of every component of (u, v, c), one task walking each from end to end.

    A component of more than ``most`` open paths of one length gives the cycles up to it, flagged, and a row without a path.
    """

    def run(table):
        c = table.column("c")[0]
        ids, u, v = _in_order(table.column("u").combine_chunks(), table.column("v").combine_chunks())
        found, dense = _walked(u, v, len(ids), most)
        parts = [_paths(ids, rows[k : k + 10_000]) for x in found.values() for rows in x for k in range(0, len(rows), 10_000)]
        parts += [pa.array([None], pa.list_(ids.type))] if dense else []
        named = [pa.RecordBatch.from_arrays([pa.array([c.as_py()] * len(p), c.type), p, pa.array([dense] * len(p))], ["c", "path", "truncated"]) for p in parts]
        return pa.Table.from_batches(named, pa.schema([("c", c.type), ("path", pa.list_(ids.type)), ("truncated", pa.bool_())]))

    kind = steps.schema["u"].dataType.simpleString()
    return steps.select("u", "v", "c").groupBy("c").applyInArrow(run, f"c {steps.schema['c'].dataType.simpleString()}, path array<{kind}>, truncated boolean")


def _shortest(goal: int, begin: np.ndarray, to: np.ndarray, into: np.ndarray, source: np.ndarray, away: np.ndarray):
    """For every step from ``goal`` the way on from it back to ``goal``, of equally short ones the first in order of vertices.

    ``away`` is -1 everywhere, before and after.
    """
    heads = to[begin[goal] : begin[goal + 1]]
    away[goal], at, d, met = 0, np.array([goal]), 0, [np.array([goal])]
    while (away[heads] < 0).any():
        at, d = np.unique(_ends(at, into, source)), d + 1
        at = at[away[at] < 0]
        away[at] = d
        met.append(at)
    for x in heads.tolist():
        way = [x]
        while way[-1] != goal:
            nxt = to[begin[way[-1]] : begin[way[-1] + 1]]
            way.append(int(nxt[away[nxt] == away[way[-1]] - 1].min()))
        yield way
    away[np.concatenate(met)] = -1


def shortest_through_in_tasks(steps: DataFrame) -> DataFrame:
    """(path): for every step (u, v) of strongly connected vertices a shortest cycle through it, from its least vertex; of equals the first in order of ids from v on.

    Every task has all steps and takes the cycles of its share of the vertices.
    """
    shares = min(SHARES, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        share = t.column("share").to_numpy()
        mine, t = np.unique(share), t.filter(pa.array(share == share[0]))
        ids, u, v = _in_order(t.column("u").combine_chunks(), t.column("v").combine_chunks())
        (begin, to), (into, source), away = _laid(u, v, len(ids)), _laid(v, u, len(ids)), np.full(len(ids), -1, np.int32)
        out = []
        for goal in np.flatnonzero(np.isin(np.arange(len(ids)) % shares, mine)).tolist():
            for way in _shortest(goal, begin, to, into, source, away):
                k = way.index(min(way))
                out.append(way[k:] + way[:k])
            if len(out) > 5_000:
                yield _listed(ids, out)
                out = []
        if out:
            yield _listed(ids, out)

    kind = steps.schema["u"].dataType.simpleString()
    each = steps.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionByRange(shares, "share")
    return each.select("u", "v", "share").mapInArrow(run, f"path array<{kind}>").distinct()


def _listed(ids: pa.Array, paths: list[list[int]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, paths)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array([x for p in paths for x in p], pa.int64())))], ["path"])
