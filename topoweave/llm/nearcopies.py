"""Groups of records whose texts are slightly changed copies, by signature trees.

A text is the set of its runs of ``width`` tokens, held as a bitmap with the
set's size.  One signature tree over all records would prune nothing near its
root, where the OR of very many bitmaps is full; so records are first parted by
the sorted sketches of :mod:`topoweave.llm.forest` (trees of minhash prefixes,
so many that a pair of threshold similarity meets with the chance ``RECALL``;
overfull places are deepened in place and paid for by further trees).  Records
side by side in a tree's order are verified first and their groups made; places
all of one group are settled by that, so that a great group of similar, unequal
records is not compared pair by pair.

The records of a place stand in a signature tree: in order of their sketches,
``FAN`` records to a leaf, ``FAN`` nodes to the node above, up to one root, each
node with the OR of its bitmaps and its range of sizes.  A dual traversal goes
down from the pair (root, root): a pair of nodes is left with everything below
it where the size ranges or the largest possible overlap rule a similarity above
the threshold out, or both lie wholly in one group, else all pairs of their
children are visited; no bound ever drops a pair that could join two groups.  Surviving pairs of records are verified on the whole sets,
and groups are the connected components of verified pairs.  With ``exact`` set
all records stand in one place, in parts, and no pair is missed.

Defined results: null texts and texts of fewer than ``min_tokens`` tokens belong
to no group; records of equal sets are one class and alike whatever their
number; rows with a null id are ignored and of rows with one id one is used;
texts of any length are compared whole.  Other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.llm.forest import grown, in_parts, mixed, signatures, trees_for
from topoweave.llm.setjoin import bitmaps, lists, spans
from topoweave.operators.components import components
from topoweave.plans.tables import keep

TOKEN = re.compile(r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\sA-Za-z_0-9]")
#: Shortest common prefix of records of one place, and records of a place above which it is deepened.
DEPTH, FULL = 2, 4_000
RECALL = 0.9999
FAN = 8
WORDS = 16  # of 64 bits in a bitmap
_PAIRS = 1 << 18


def runs_of(texts: list, width: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that count, and the sorted distinct hashes of their token runs as values and offsets."""
    known: dict[str, int] = {}
    rows, sizes, tokens = [], [], []
    for i, text in enumerate(texts):
        found = TOKEN.findall(text) if text is not None else ()
        if len(found) < max(min_tokens, width):
            continue
        for t in found:
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh3_64_intdigest(t)
            tokens.append(h)
        rows.append(i), sizes.append(len(found))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    h, sizes = np.array(tokens, np.uint64), np.array(sizes)
    n = len(h) - width + 1
    run = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    owner = np.repeat(np.arange(len(rows)), sizes)
    whole = owner[:n] == owner[width - 1 :]
    run, owner = run[whole], owner[:n][whole]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    run, owner = run[new], owner[new]
    return np.array(rows), run, np.searchsorted(owner, np.arange(len(rows) + 1))


def _signed(width: int, min_tokens: int, first_tree: int, trees: int):
    """Maps (id, text) to a row per record: hash and size of its set, bitmap, and its sketch in each tree."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                rows, values, offsets = runs_of(part.column(1).to_pylist(), width, min_tokens)
                if not len(rows):
                    continue
                maps, doubles = bitmaps(values, offsets, WORDS)
                bits = pa.array([m.tobytes() for m in maps], pa.binary())
                columns = [part.column(0).take(pa.array(rows)), pa.array(_set_hash(values, offsets)), pa.array(np.diff(offsets).astype(np.int32)), pa.array(doubles.astype(np.int32)), bits]
                yield pa.RecordBatch.from_arrays([*columns, *signatures(values, offsets, first_tree, trees)], ["id", "h", "n", "doubles", "bits", "hi", "lo"])

    return run


def _set_hash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.add.reduceat(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[:-1]).view(np.int64)


class SignatureTrees:
    """Trees over records in order of their group: at every level the span of children, OR, sizes and doubles of each node."""

    def __init__(self, group: np.ndarray, n: np.ndarray, doubles: np.ndarray, maps: np.ndarray, label: np.ndarray):
        self.least, self.most = [label], [label]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        self.first, self.count = [None], [None]
        self.maps, self.low, self.high, self.loss = [maps], [n], [n], [doubles]
        while True:
            per = -(-size // FAN)
            place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            begin = np.repeat(first, per) + place * FAN
            self.first.append(begin), self.count.append(np.minimum(FAN, np.repeat(first + size, per) - begin))
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], begin, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], begin)), self.high.append(np.maximum.reduceat(self.high[-1], begin))
            self.loss.append(np.maximum.reduceat(self.loss[-1], begin))
            self.least.append(np.minimum.reduceat(self.least[-1], begin)), self.most.append(np.maximum.reduceat(self.most[-1], begin))
            first, size = np.cumsum(per) - per, per
            if size.max() == 1:
                return

    def may_be_alike(self, level: int, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        low, high, maps, loss = self.low[level], self.high[level], self.maps[level], self.loss[level]
        ok = (high[x] >= low[y] * threshold - 1e-9) & (high[y] >= low[x] * threshold - 1e-9)
        ok &= (self.least[level][x] != self.most[level][y]) | (self.most[level][x] != self.least[level][y])  # else all of one group
        at = np.flatnonzero(ok)
        x, y = x[at], y[at]
        most = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(loss[x], loss[y])
        ok[at] = most >= (low[x] + low[y]) * (threshold / (1 + threshold)) - 1e-9
        return ok

    def descend(self, level: int, x: np.ndarray, y: np.ndarray, threshold: float):
        """Pairs of records below the pairs of nodes (x, y) of a level: yields (i, j) arrays."""
        ok = self.may_be_alike(level, x, y, threshold)
        x, y = x[ok], y[ok]
        if level == 0:
            if len(x):
                yield x, y
            return
        first, count = self.first[level], self.count[level]
        kids = count[x] * count[y]
        for a, b in spans(kids, _PAIRS):
            p, q, k = x[a:b], y[a:b], kids[a:b]
            of = np.repeat(np.arange(b - a), k)
            nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            width = count[q][of]
            i, j = first[p][of] + nth // width, first[q][of] + nth % width
            # Below a pair of a node with itself every pair of children once, and no record with itself.
            ok = (p[of] != q[of]) | ((i <= j) if level > 1 else (i < j))
            yield from self.descend(level - 1, i[ok], j[ok], threshold)


def traverse(node: np.ndarray, own: np.ndarray, whole: np.ndarray, n: np.ndarray, doubles: np.ndarray, maps: np.ndarray, label: np.ndarray, threshold: float):
    """Pairs of rows that may be alike, of records in order of (node, own): yields (i, j) arrays.

    Each part ``own`` of a node is a tree; a ``whole`` one meets itself, the two parts of another node meet each other.
    """
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (own[1:] != own[:-1])))
    trees = SignatureTrees(np.cumsum(new), n, doubles, maps, label)
    at = np.flatnonzero(new)
    top, itself = len(trees.maps) - 1, np.flatnonzero(whole[at])
    yield from trees.descend(top, itself, itself, threshold)
    pair = np.flatnonzero(~whole[at[:-1]] & (node[at[:-1]] == node[at[1:]]))
    yield from trees.descend(top, pair, pair + 1, threshold)


def _traverser(threshold: float):
    def pairs(t: pa.Table):
        ids = t.column("id").combine_chunks()
        maps = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, WORDS)
        n, doubles = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "doubles"))
        for x, y in traverse(t.column("node").to_numpy(), t.column("own").to_numpy(), t.column("whole").to_numpy(), n, doubles, maps, t.column("label").to_numpy(), threshold):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Rows come sorted by node; the last node of a batch may go on in the next.
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            held.append(batch.slice(0, cut))
            if cut:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            elif held[0].num_rows and held[-1].num_rows == 0:
                held.pop()
                last = held[-1].column("node")[-1].as_py() if held else None
                if last is not None and last != node[-1]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
            held.append(batch.slice(cut))
            held = [b for b in held if b.num_rows]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _sets(width: int, min_tokens: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                rows, values, offsets = runs_of(part.column(1).to_pylist(), width, min_tokens)
                if len(rows):
                    runs = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(_set_hash(values, offsets)), runs], ["id", "h", "runs"])

    return run


def _alike(threshold: float):
    """Pairs whose sets of runs, given as sorted lists, are alike."""

    def run(batches):
        for batch in batches:
            keep_row = []
            (va, oa), (vb, ob) = lists(batch.column("ra")), lists(batch.column("rb"))
            for k in range(batch.num_rows):
                x, y = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep_row.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep_row, pa.bool_()))

    return run


def _sketches(texts: DataFrame, width: int, min_tokens: int, first: int, trees: int) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, h bigint, n int, doubles int, bits binary, hi array<bigint>, lo array<bigint>"
    return keep(texts.mapInArrow(_signed(width, min_tokens, first, trees), schema), "signatures")[0]


def _meeting(rows: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of records of different groups that come together in the signature trees of their places."""
    kind = rows.schema["id"].dataType.simpleString()
    # A hash stands for the group: two groups of one hash are met with a chance of 1e-19 a pair.
    at = places.select("node", "own", "hi", "lo", "id", "whole", F.xxhash64("group").alias("label")).join(rows.select("id", "n", "doubles", "bits"), "id")
    near = at.select("node", "own", "hi", "lo", "id", "n", "doubles", "bits", "whole", "label").repartition("node").sortWithinPartitions("node", "own", "hi", "lo", "id")
    near = near.select("node", "own", "whole", "id", "n", "doubles", "bits", "label").mapInArrow(_traverser(threshold), f"a {kind}, b {kind}")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _possible(threshold: float):
    """Pairs whose bitmaps and sizes leave it open that they are alike."""
    need = threshold / (1 + threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            maps = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WORDS) for c in ("bits_a", "bits_b")]
            na, nb, da, db = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b", "doubles_a", "doubles_b"))
            most = np.bitwise_count(maps[0] & maps[1]).sum(axis=1, dtype=np.int64) + np.minimum(da, db)
            ok = (most >= (na + nb) * need - 1e-9) & (np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


class _Links:
    """Verified pairs (a, b) of class heads, as they are found; ``texts``: (id, text), ``classes``: (id, h, class)."""

    def __init__(self, texts: DataFrame, classes: DataFrame, threshold: float, width: int, min_tokens: int):
        self.texts, self.classes, self.threshold, self.width, self.min_tokens, self.new, self.label = texts, classes, threshold, width, min_tokens, [], None

    def verify(self, pairs: DataFrame) -> None:
        kind = self.texts.schema["id"].dataType.simpleString()
        pairs, _ = keep(pairs.distinct(), "alike-candidates")
        wanted, _ = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "alike-ids")
        runs = self.texts.join(wanted, "id", "left_semi").mapInArrow(_sets(self.width, self.min_tokens), f"id {kind}, h bigint, runs array<bigint>")
        runs, _ = keep(runs.join(self.classes.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id"]).select("id", "runs"), "alike-runs")
        x = pairs.join(runs.toDF("a", "ra"), "a").join(runs.toDF("b", "rb"), "b").select("a", "b", "ra", "rb")
        self.new.append(keep(x.mapInArrow(_alike(self.threshold), f"a {kind}, b {kind}"), "alike-pairs")[0])

    def groups(self) -> DataFrame:
        """(id, group) of what the pairs found so far connect; later pairs only join the groups of earlier ones."""
        new, self.new = reduce(DataFrame.union, self.new), []
        if self.label is None:
            label = components(new, "a", "b").withColumnRenamed("component", "group")
        elif new.isEmpty():
            return self.label
        else:
            group = lambda c: self.label.select(F.col("id").alias(c), F.col("group").alias(f"g{c}"))
            ends = new.join(group("a"), "a", "left").join(group("b"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
            joined, _ = keep(components(ends, "a", "b"), "joined-groups")
            label = self.label.join(joined.withColumnRenamed("id", "group"), "group", "left").select("id", F.coalesce("component", "group").alias("group"))
            label = label.unionByName(joined.join(self.label.select("id"), "id", "left_anti").withColumnRenamed("component", "group"))
        self.label, _ = keep(label, "groups")
        return self.label


def alike_groups(texts: DataFrame, signed: DataFrame, classes: DataFrame, threshold: float, width: int, min_tokens: int, exact: bool = False) -> DataFrame:
    """(id, group) of the class heads that have an alike one; ``signed``: the rows of the first trees."""
    # The rows that are not the head of their class; few, so that leaving them out moves no signature.
    others, _ = keep(classes.where("id != class").select("id"), "followers")
    kind, links = texts.schema["id"].dataType.simpleString(), _Links(texts, classes, threshold, width, min_tokens)

    def sketches(first: int, trees: int, only: DataFrame | None) -> DataFrame:
        if only is None:
            return signed.join(others, "id", "left_anti")
        rows = _sketches(texts.join(only, "id", "left_semi"), width, min_tokens, first, trees)
        return rows.join(classes.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id"])

    def link(near: DataFrame) -> DataFrame:
        side = lambda s: signed.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("doubles").alias(f"doubles_{s}"), F.col("bits").alias(f"bits_{s}"))
        links.verify(near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_possible(threshold), f"a {kind}, b {kind}"))
        return links.groups()

    if exact:
        rows = sketches(0, 0, None)
        one = rows.select(F.lit(0).cast("bigint").alias("node"), "id", F.col("hi")[0].alias("hi"), F.col("lo")[0].alias("lo"), F.col("id").alias("group")).crossJoin(rows.agg(F.count("*").alias("held")))  # one row
        links.verify(_meeting(rows, in_parts(one, FULL), threshold))
    else:
        for rows, places in grown(sketches, DEPTH, threshold, RECALL, FULL, link):
            links.verify(_meeting(rows, places, threshold))
    return links.groups()


def text_sets(texts: DataFrame, width: int = 3, min_tokens: int = 40) -> DataFrame:
    """(id, members): the runs of every text long enough, of (id, text)."""
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_sets(width, min_tokens), f"id {kind}, h bigint, runs array<bigint>").select("id", F.col("runs").alias("members"))


def near_copies(records: DataFrame, record_id: str, text: str, threshold: float = 0.6, width: int = 3, min_tokens: int = 40, exact: bool = False) -> DataFrame:
    """(id, class, group) of every record long enough: class of equal sets, group of alike records; both named by their least id."""
    texts = records.select(F.col(record_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    signed = _sketches(texts, width, min_tokens, 0, trees_for(DEPTH, threshold, RECALL))
    sets = signed.groupBy("id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))
    least = sets.groupBy("h").agg(F.min("id").alias("class"))
    classes, _ = keep(sets.join(least, "h").select("id", "h", "class", "rows"), "text-classes")
    repeated, _ = keep(classes.where("rows > 1").select("id", "h"), "repeated-ids")
    if not repeated.isEmpty():
        once = signed.join(repeated, ["id", "h"], "left_semi").dropDuplicates(["id"])
        signed, _ = keep(signed.join(repeated, "id", "left_anti").unionByName(once), "signatures")
    groups = alike_groups(texts, signed, classes, threshold, width, min_tokens, exact).withColumnRenamed("id", "class")
    return classes.join(groups, "class", "left").select("id", "class", F.coalesce("group", "class").alias("group"))
