"""Scores of many pairs of fingerprints, summed where they are made instead of listed.

Where bands are so full that pairs by far outnumber records, no pair is kept: records are packed into parts, and a
task compares every two records of two parts.  One matrix product bounds all scores from above (overlaps of sets
and trees by their cosine, rare names by buckets, sizes by limits); only pairs that the bound lets through and that share
a band are scored, first without their trees.  What a task gives are sums and links of records, so disk grows with the
records and the parts.  Names, labels and bands are compared by 64-bit hashes.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of a part.
PART = 10_000
#: Rows and columns of a part that are compared at once.
TILE = 1_000, 2_000
#: Buckets of the bound at most, by kind of hashes.
BUCKETS = {"labels": 96, "grams": 256, "callees": 96, "args": 96, "reads": 64, "near": 64}
#: Equal neighbourhoods and frequent grams that the bound tells apart.
EQUAL, SURE = 64, 8
#: Between which the bound takes counts of arguments, lines and levels as equal.
LIMITS = [-np.inf, 1, 2, 3, 4, 5, 6, 8, 11, 15, 20, 30, 50, 100]
SETS = ["callees", "args", "reads", "near"]
#: Labels of which counts are held as a matrix.
LABELS = 512
#: What rounding may take from the bound.
SLACK = 1e-3
#: Pairs that are scored at once.
HELD = 400_000


def traits(fp: DataFrame, key: str, flags: list[str], near, bands: int, rows: int) -> DataFrame:
    """What is compared of every record, as numbers."""
    names = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.isNotNull()))
    hashed = lambda c: F.transform(c, lambda v: F.xxhash64(v))
    counts = F.coalesce("ast_node_counts", F.create_map().cast("map<string,int>"))
    # Hashes of arrays leave nulls out; signatures have no value below 0.
    sign = F.transform("minhash", lambda v: F.coalesce(v, F.lit(-1)))
    tree = F.coalesce(F.col("ast_tree").cast("array<struct<depth:int,label:string>>"), F.array().cast("array<struct<depth:int,label:string>>"))
    return fp.where(F.size("minhash") == bands * rows).select(
        F.col(key).alias("k"), F.transform(tree, lambda x: F.coalesce(x["depth"], F.lit(0))).alias("depth"), hashed(F.transform(tree, lambda x: F.coalesce(x["label"], F.lit("")))).alias("nodes"),
        F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice(sign, b * rows + 1, F.lit(rows)))).alias("bands"),
        hashed(F.map_keys(counts)).alias("labels"), F.transform(F.map_values(counts), lambda v: F.coalesce(v, F.lit(0)).cast("double")).alias("times"),
        hashed(names(F.col("callees"))).alias("callees"), hashed(names(F.col("arg_names"))).alias("args"), hashed(names(F.col("reads"))).alias("reads"), hashed(near).alias("near"),
        F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("arg_count", "line_count", "max_nesting_depth")]).alias("sizes"),
        F.array(*[F.coalesce(F.col(f).cast("bigint"), F.lit(2)) for f in flags]).alias("flags"),
    )


def packed(records: DataFrame, heads: DataFrame, parts: int) -> DataFrame:
    """(part, blob): the rows of :func:`traits` that are in ``heads`` (k, n), in ``parts`` parts, each one array of bytes."""
    from topoweave.operators.similarity import hashed_grams

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        depth, nodes = (t.column(c).combine_chunks() for c in ("depth", "nodes"))
        size = depth.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        grams = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(hashed_grams(flat(depth), flat(nodes).view(np.uint64), size)))
        one = {c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in ("bands", "sizes", "flags")}
        one["n"] = t.column("n").to_numpy()
        for c, lists in [("grams", grams), *[(c, t.column(c).combine_chunks()) for c in ("labels", *SETS)]]:
            words, codes = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            one |= {f"{c}_words": words.astype(np.int64), f"{c}_codes": codes.astype(np.int32), f"{c}_size": size}
        one["times"] = t.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        keys, out = io.BytesIO(), io.BytesIO()
        with pa.ipc.new_stream(keys, pa.schema([t.schema.field("k")])) as w:
            w.write_table(t.select(["k"]))
        np.savez(out, keys=np.frombuffer(keys.getvalue(), np.uint8), **one)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(out.getvalue(), 1)], pa.binary())], ["part", "blob"])

    return records.repartition(parts, "k").join(heads.repartition(parts, "k"), "k").mapInArrow(run, "part int, blob binary")


class _Part:
    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(zlib.decompress(blob))) as z:
            self.a = {k: z[k] for k in z.files}
        self.keys = pa.ipc.open_stream(self.a.pop("keys").tobytes()).read_all().column("k").combine_chunks()
        self.n, self.bands = self.a["n"], self.a["bands"]
        self.low = self.bands.astype(np.int32)
        self.sizes, self.flags = self.a["sizes"].astype(np.float64), self.a["flags"]
        self.size = {c: self.a[f"{c}_size"] for c in ("grams", "labels", *SETS)}
        self.row = {c: np.repeat(np.arange(len(self.n)), s) for c, s in self.size.items()}
        self.mixed = {"near": np.abs(np.bincount(self.row["near"], self.a["near_words"][self.a["near_codes"]] % 1_000_003, len(self.n))).astype(np.int64)}
        self.norm = np.sqrt(np.bincount(self.row["labels"], self.a["times"] ** 2, len(self.n)))


def _common(x: _Part, y: _Part, c: str):
    """For either part the (row, code, place) of hashes that rows of both have, and the number of codes; of a part with itself those of more than one row."""
    if x is y:
        codes = x.a[f"{c}_codes"]
        many = np.bincount(codes, minlength=len(x.a[f"{c}_words"])) > 1
        code = np.cumsum(many) - 1
        at = np.flatnonzero(many[codes])
        one = x.row[c][at], code[codes[at]], at
        return one, one, int(many.sum())
    words, i, j = np.intersect1d(x.a[f"{c}_words"], y.a[f"{c}_words"], assume_unique=True, return_indices=True)
    sides = []
    for p, held in ((x, i), (y, j)):
        code = np.full(len(p.a[f"{c}_words"]), -1)
        code[held] = np.arange(len(held))
        code = code[p.a[f"{c}_codes"]]
        at = np.flatnonzero(code >= 0)
        sides.append((p.row[c][at], code[at], at))
    return *sides, len(words)


class _Both:
    """Two parts, or one with itself, in terms of what they have in common."""

    def __init__(self, x: _Part, y: _Part, weights: list[float], tree_weight: float, least: float):
        self.x, self.y, self.weights, self.tree_weight, self.least = x, y, weights, tree_weight, least
        self.shared = {c: _common(x, y, c) for c in ("grams", "labels", *SETS)}
        self.counts = [self._counts(0)] if self.shared["labels"][2] <= LABELS else None
        self.bits, self.begin = {}, {}
        for c in SETS:
            (row, _, _), (to, code, _), v = self.shared[c]
            bits = np.zeros((len(y.n), v // 8 + 1), np.uint8)
            np.bitwise_or.at(bits, (to, code >> 3), np.left_shift(1, code & 7).astype(np.uint8))
            self.bits[c], self.begin[c] = bits, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x.n)))))

    def _counts(self, first: int) -> list[np.ndarray]:
        """The counts of up to ``LABELS`` common labels from ``first`` on, a row per record of either part."""
        out = []
        for p, (row, code, at) in zip((self.x, self.y), self.shared["labels"]):
            ok = (code >= first) & (code < first + LABELS)
            m = np.zeros((len(p.n), min(LABELS, self.shared["labels"][2] - first)))
            m[row[ok], code[ok] - first] = p.a["times"][at[ok]]
            out.append(m)
        return out

    def _bucketed(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """For either part a row per record: roots of how many of its common hashes are in each bucket; the most frequent hashes have their own.

        What two records share of a bucket is at most the lesser count, thus at most the product of the roots.
        """
        (row, code, _), (to, other, _), v = self.shared[c]
        most = BUCKETS[c]
        bucket, rest = np.arange(v), most // 4
        if v > most:
            order = np.argsort(-(np.bincount(code, minlength=v) * np.bincount(other, minlength=v)), kind="stable")
            bucket[order] = np.where(np.arange(v) < most - rest, np.arange(v), most - rest + np.arange(v) % rest)
        wide = max(1, min(v, most))
        return tuple(np.sqrt(np.bincount(r * wide + bucket[k], minlength=len(p.n) * wide).reshape(len(p.n), wide)) for r, k, p in ((row, code, self.x), (to, other, self.y)))

    def _sure(self) -> tuple[np.ndarray, np.ndarray]:
        """For either part a row per record: which of the most frequent common grams it has, the first only; who has the same one has an overlap."""
        (row, code, _), (to, other, _), v = self.shared["grams"]
        top = np.argsort(-(np.bincount(code, minlength=v) * np.bincount(other, minlength=v)), kind="stable")[:SURE]
        rank = np.full(max(1, v), SURE)
        rank[top] = np.arange(len(top))
        out = []
        for r, k, p in ((row, code, self.x), (to, other, self.y)):
            first = np.full(len(p.n), SURE)
            np.minimum.at(first, r, rank[k])
            out.append(first[:, None] == np.arange(SURE))
        return tuple(out)

    def bounds(self) -> list[np.ndarray]:
        """Matrices of which the product is at least the sum of weight times (signal - least) over the signals."""
        wc, wn, wr, wa, wk, wf, wd, wl, wm = self.weights
        least, sides = self.least, ([], [])

        def add(weight, u, v):
            sides[0].append(weight * u)
            sides[1].append(v * 1.0)

        both = (self.x, self.y)
        add(-wc * least, *((p.size["labels"] > 0)[:, None] for p in both))
        m = []
        for (row, code, at), p in zip(self.shared["labels"], both):
            wide = max(1, min(BUCKETS["labels"], self.shared["labels"][2]))
            m.append(np.bincount(row * wide + code % wide, np.abs(p.a["times"][at]), len(p.n) * wide).reshape(len(p.n), wide) / np.maximum(p.norm, 1e-300)[:, None])
        add(wc, *m)
        for c, weight in zip(("grams", *SETS), (self.tree_weight, wr, wa, wd, wn)):
            # Jaccard and Dice are at most the cosine; the kernel is 1 for equal sets, else convex in the cosine t, at most 1/15 at 0 and 1/3 at 1.
            add(weight * (4 / 15 if c == "near" else 1), *(u / np.sqrt(np.maximum(p.size[c], 1))[:, None] for u, p in zip(self._bucketed(c), both)))
            if c == "grams":
                add(-weight * least, *self._sure())
            elif c == "near":
                add(-weight * (least - 1 / 15), *((p.size[c] > 0)[:, None] for p in both))
                add(weight * 2 / 3, *(((p.size[c] > 0) * (p.mixed["near"] % EQUAL + 1))[:, None] == np.arange(1, EQUAL + 1) for p in both))
            else:
                # Absent only if both are empty: 1 - empty * empty.
                add(-weight * least, *(np.ones((len(p.n), 1)) for p in both))
                add(weight * least, *((p.size[c] == 0)[:, None] for p in both))
        add(wf / self.x.flags.shape[1], *((p.flags[:, :, None] == np.arange(3)).reshape(len(p.n), -1) for p in both))
        add(-wf * least, *(np.ones((len(p.n), 1)) for p in both))
        for at, weight in enumerate((wk, wl, wm)):
            # Of values between limits at most the ratio of the nearest ones; absent at 0 or less.
            lo = np.array(LIMITS, float)
            hi, pos = np.append(lo[1:], np.inf), lo > 0
            near = np.where(lo[:, None] >= hi, hi / lo[:, None].clip(1e-300), np.where(lo >= hi[:, None], hi[:, None] / lo.clip(1e-300), 1.0))
            if at == 0:
                near = 2 * near / (1 + near)  # 1 - |a - b| / (a + b)
            known = (pos[:, None] & pos) if at == 1 else (pos[:, None] | pos)
            near = np.where(known, np.where(pos[:, None] & pos, near, 0.0) - least, 0.0)
            if any((p.sizes[:, at] < 0).any() for p in both):
                near = np.maximum(near, 0.0)
            kind = [np.searchsorted(lo[1:], p.sizes[:, at], side="right")[:, None] == np.arange(len(lo)) for p in both]
            add(weight, kind[0] @ near, kind[1])
        return [np.concatenate(x, axis=1).astype(np.float32) for x in sides]

    def flat(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weighted signals without the tree, and of their weights."""
        x, y = self.x, self.y
        if x is y and len(i) and (i == j).all():
            common = {c: x.size[c][i] for c in SETS}
            cosine = np.where(x.norm[i] > 0, 1.0, 0.0)
        else:
            common = {c: self._common(c, i, j) for c in SETS}
            dot, norm = np.zeros(len(i)), x.norm[i] * y.norm[j]
            for u, v in self.counts or map(self._counts, range(0, self.shared["labels"][2], LABELS)):
                for k in range(0, len(i), 20_000):
                    dot[k : k + 20_000] += np.einsum("ij,ij->i", u[i[k : k + 20_000]], v[j[k : k + 20_000]])
            cosine = np.divide(dot, norm, out=np.zeros(len(i)), where=norm > 0)
        wc, wn, wr, wa, wk, wf, wd, wl, wm = self.weights
        s, w = np.zeros(len(i)), np.zeros(len(i))

        def add(weight, ok, value):
            s[ok] += weight * value[ok]
            w[ok] += weight

        add(wc, (x.size["labels"][i] > 0) & (y.size["labels"][j] > 0), cosine)
        n, both = x.size["near"][i] + y.size["near"][j], common["near"]
        add(wn, (x.size["near"][i] > 0) & (y.size["near"][j] > 0), np.where(2 * both == n, 1.0, (1 + 2 * both) / (7 + 4 * n - 2 * both)))
        for c, weight in zip(SETS[:3], (wr, wa, wd)):
            union = x.size[c][i] + y.size[c][j] - common[c]
            add(weight, union > 0, common[c] / np.maximum(union, 1))
        (a, la, da), (b, lb, db) = x.sizes[i].T, y.sizes[j].T
        part = lambda p, q, of: 1 - np.abs(p - q) / np.where(of != 0, of, 1)
        add(wk, a + b > 0, part(a, b, a + b))
        add(wf, np.ones(len(i), bool), (x.flags[i] == y.flags[j]).mean(axis=1))
        add(wl, (la > 0) & (lb > 0), part(la, lb, np.maximum(la, lb)))
        add(wm, (da > 0) | (db > 0), part(da, db, np.maximum(da, db)))
        return s, w

    def _common(self, c: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        begin, code = self.begin[c], self.shared[c][0][1]
        size = begin[i + 1] - begin[i]
        pair = np.repeat(np.arange(len(i)), size)
        code = code[np.repeat(begin[i] - (np.cumsum(size) - size), size) + np.arange(len(pair))]
        met = (self.bits[c][j[pair], code >> 3] >> (code & 7).astype(np.uint8)) & 1
        return np.bincount(pair, met, len(i)).astype(np.int64)

    def trees(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Overlap of the grams of pairs in order of ``i``."""
        x, y = self.x, self.y
        total = x.size["grams"][i] + y.size["grams"][j]
        if x is y and len(i) and (i == j).all():
            return np.where(total > 0, 1.0, 0.0)
        (row, code, _), (to, other, _), v = self.shared["grams"]
        begin, to = (np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(p.n))))) for r, p in ((row, x), (to, y)))
        mark, met = np.zeros(v + 1, np.int32), np.zeros(len(i), np.int64)
        at = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True]))) if len(i) else []
        for p, q in zip(at[:-1], at[1:]):
            own = code[begin[i[p]] : begin[i[p] + 1]]
            mark[own] = 1
            b = j[p:q]
            size = to[b + 1] - to[b]
            end = np.cumsum(size)
            sums = np.cumsum(mark[other[np.repeat(to[b] - (end - size), size) + np.arange(end[-1])]])
            sums = np.concatenate(([0], sums))
            met[p:q] = sums[end] - sums[end - size]
            mark[own] = 0
        return np.divide(2.0 * met, total, out=np.zeros(len(i)), where=total > 0)

    def scores(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that reach the least score, and their scores."""
        s, w = self.flat(i, j)
        can = np.round((s + self.tree_weight) / (w + self.tree_weight), 9) >= self.least
        i, j, s, w = i[can], j[can], s[can], w[can]
        tree = self.trees(i, j)
        score = np.round(np.where(tree > 0, (s + tree * self.tree_weight) / (w + self.tree_weight), s / w), 9)
        ok = score >= self.least
        return i[ok], j[ok], score[ok]

    def found(self):
        """All pairs of records that share a band and reach the least score, in batches."""
        (u, v), (high, wide) = self.bounds(), TILE
        held, many = [], 0
        for p in range(0, len(u), high):
            for q in range(p if self.x is self.y else 0, len(v), wide):
                at = np.flatnonzero((u[p : p + high] @ v[q : q + wide].T).ravel() >= -SLACK)
                i, j = np.divmod(at, min(wide, len(v) - q))
                i, j = i + p, j + q
                if self.x is self.y:
                    i, j = i[i < j], j[i < j]
                near = (self.x.low[i] == self.y.low[j]).any(axis=1)
                i, j = i[near], j[near]
                held.append((i, j))
                many += len(i)
                if many >= HELD:
                    yield self._scored(held)
                    held, many = [], 0
        yield self._scored(held)

    def _scored(self, held):
        i, j = (np.concatenate([h[s] for h in held]) if held else np.zeros(0, np.int64) for s in (0, 1))
        near = (self.x.bands[i] == self.y.bands[j]).any(axis=1)
        i, j = i[near], j[near]
        order = np.argsort(i, kind="stable")
        return self.scores(i[order], j[order])


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of every vertex the least one it is linked to."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, root[u], root[v])
        np.minimum.at(root, root[v], root[u])
        while (root[root] != root).any():
            root = root[root]
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root


def summed(parts: DataFrame, kind: str, weights: list[float], tree_weight: float, least: float, of: int) -> DataFrame:
    """(k, root, n_pairs, n_record_pairs, total): records that have a pair of at least ``least``, with one they are linked to; the sums of all rows are those of all pairs."""

    def run(batches):
        last = None
        for b in batches:
            for row in range(b.num_rows):
                i, j = (b.column(c)[row].as_py() for c in ("i", "j"))
                if i != last:
                    last, x = i, _Part(b.column("x")[row].as_py())
                y = x if i == j else _Part(b.column("y")[row].as_py())
                yield _sums(x, y, weights, tree_weight, least)

    x, y = parts.toDF("i", "x").repartitionByRange(of, "i"), parts.toDF("j", "y")
    both = x.join(y.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))
    return both.mapInArrow(run, f"k {kind}, root {kind}, n_pairs bigint, n_record_pairs bigint, total double")


def _sums(x: _Part, y: _Part, weights: list[float], tree_weight: float, least: float) -> pa.RecordBatch:
    both, shift = _Both(x, y, weights, tree_weight, least), 0 if x is y else len(x.n)
    n = len(x.n)
    sums, root, touched = np.zeros((2, n), np.int64), np.arange(shift + len(y.n)), np.zeros(shift + len(y.n), bool)
    total = np.zeros(n)
    for i, j, score in both.found():
        w = x.n[i] * y.n[j]
        np.add.at(sums[0], i, 1)
        np.add.at(sums[1], i, w)
        np.add.at(total, i, w * score)
        touched[i] = touched[j + shift] = True
        root = _roots(np.concatenate((i, np.arange(len(root)))), np.concatenate((j + shift, root)), len(root))
    if x is y:
        i = np.flatnonzero(x.n > 1)
        i, _, score = both.scores(i, i)
        w = x.n[i] * (x.n[i] - 1) // 2
        sums[0][i] += x.n[i] - 1
        sums[1][i] += w
        total[i] += w * score
        touched[i] = True
    at = np.flatnonzero(touched)
    keys = x.keys if x is y else pa.concat_arrays([x.keys, y.keys])
    rest = np.zeros(len(root) - n, np.int64)
    own = [pa.array(np.concatenate((v, rest.astype(v.dtype)))[at]) for v in (*sums, total)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), keys.take(pa.array(root[at])), *own], ["k", "root", "n_pairs", "n_record_pairs", "total"])
