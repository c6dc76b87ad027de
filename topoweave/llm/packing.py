"""Texts packed whole into containers of a fixed number of tokens, by linear grouping.

Tokens are counted where the documents lie.  Longer texts than a container are
cut into full pieces and a rest.  Only the histogram of sizes, of at most
``capacity`` rows whatever the corpus, comes to the driver: sizes above
``capacity / SMALL`` are put into ``GROUPS`` groups of equal cardinality, each
rounded up to its greatest size, and configurations of the few rounded sizes are
chosen by knapsacks until every large piece has a place.  Spark then substitutes
the actual pieces: a piece's rank in its group (a count per bucket of pieces,
summed up, and the place in its bucket) names its configuration and container.
Small pieces go best-fit into what is left, in shards of containers of bounded
size, which wastes at most one part-filled container a shard.

Defined results: a null or empty text has no tokens and comes out with a null
container; repeated documents are packed each by itself; a text of exactly the
capacity is one piece; positions in a container run from 0 by falling size; the
pieces of a text run from 0.  Other columns are not read.
"""

from __future__ import annotations

import base64
import math
import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoweave.plans.tables import keep

CAPACITY = 2_048
#: The default vocabulary: byte-level BPE ranks in the public tiktoken format, and its splitting pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space are tokenised in parts of so many characters, as the splitting pattern recurses on them.
BLANKS = 4_096
_BLANKS = re.compile(r"(\s{%d})" % BLANKS)
GROUPS = 64
SMALL = 16
#: Pieces in a ranking bucket, and containers or small pieces in a best-fit shard, on average.
BUCKET = 50_000
SHARD = 20_000


@lru_cache(2)
def encoding(path: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    import tiktoken

    from pyspark import SparkFiles

    sent = SparkFiles.get(os.path.basename(path))
    with open(sent if os.path.exists(sent) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(text: str | None, enc) -> int:
    if not text:
        return 0
    parts = _BLANKS.split(text) if len(text) > BLANKS else [text]
    return sum(len(enc.encode_ordinary(p)) for p in parts if p)


def _counter(path: str):
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            n = [tokens_of(t, enc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


@dataclass(frozen=True)
class Plan:
    """group_of: group of each size, -1 for small ones; rows: (group, first rank, count per container, container)."""

    group_of: list[int]
    rows: list[tuple[int, int, int, int]]
    containers: int


def grouped(counts: np.ndarray, smallest: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each size, rounded size and cardinality of each group of the large sizes."""
    sizes = np.flatnonzero(counts[smallest:]) + smallest
    group_of = np.full(len(counts), -1)
    if not len(sizes):
        return group_of, np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.cumsum(counts[sizes])
    number = np.minimum((held - 1) * groups // held[-1], groups - 1)
    _, number = np.unique(number, return_inverse=True)
    group_of[sizes] = number
    top = np.zeros(number.max() + 1, np.int64)
    np.maximum.at(top, number, sizes)
    return group_of, top, np.bincount(number, counts[sizes]).astype(np.int64)


def best_configuration(size: np.ndarray, left: np.ndarray, capacity: int, bend: float) -> np.ndarray:
    """Pieces of each group whose rounded sizes fill a container best, large ones counting more by ``bend``."""
    worth = size.astype(float) ** bend
    best = np.zeros(capacity + 1)
    taken = []
    for g in np.argsort(-size):
        most, chunk = min(int(left[g]), capacity // int(size[g])), 1
        while most > 0:
            k = min(chunk, most)
            most, chunk = most - k, chunk * 2
            w = k * int(size[g])
            with_it = np.full(capacity + 1, -1.0)
            with_it[w:] = best[: capacity + 1 - w] + k * worth[g]
            better = with_it > best + 1e-9
            taken.append((g, k, w, better))
            best = np.where(better, with_it, best)
    out, at = np.zeros(len(size), np.int64), capacity
    for g, k, w, better in reversed(taken):
        if better[at]:
            out[g] += k
            at -= w
    return out


def configurations(size: np.ndarray, cardinality: np.ndarray, capacity: int, bend: float) -> list[tuple[np.ndarray, int]]:
    left, out = cardinality.copy(), []
    while left.any():
        c = best_configuration(size, left, capacity, bend)
        used = c > 0
        times = int((left[used] // c[used]).min())
        left = left - times * c
        out.append((c, times))
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Containers for the large sizes of a histogram (counts[n]: pieces of n tokens)."""
    group_of, size, cardinality = grouped(counts, capacity // SMALL + 1, groups)
    if not len(size):
        return Plan(group_of.tolist(), [], 0)
    tried = [configurations(size, cardinality, capacity, bend) for bend in (1.0, 1.1, 1.3)]
    chosen = min(tried, key=lambda cs: sum(t for _, t in cs))
    rank, rows, container = np.zeros(len(size), np.int64), [], 0
    for c, times in chosen:
        for g in np.flatnonzero(c):
            rows.append((int(g), int(rank[g]), int(c[g]), container))
        rank += times * c
        container += times
    return Plan(group_of.tolist(), rows, container)


def _best_fit(capacity: int, shards: int, used: int):
    """Small pieces of one shard into the free space of its containers, largest first, each where least stays free."""

    def run(key, small: pd.DataFrame, spaces: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        there = 0
        for c, free in zip(spaces["container"].tolist(), spaces["free"].tolist()):
            stacks[free].append(c)
            there |= 1 << free
        small = small.sort_values(["n_tokens", "uid"], ascending=[False, True])
        out, opened = [], 0
        for n in small["n_tokens"].tolist():
            fits = there >> n
            if fits:
                free = n + (fits & -fits).bit_length() - 1
                c = stacks[free].pop()
                if not stacks[free]:
                    there &= ~(1 << free)
            else:
                c, free = used + opened * shards + shard, capacity
                opened += 1
            out.append(c)
            if free > n:
                stacks[free - n].append(c)
                there |= 1 << (free - n)
        return small[["uid", "doc_id", "piece", "start", "n_tokens"]].assign(container=np.array(out, np.int64))

    return run


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container, position) of every text."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)  # tasks need not have the folder of vocabularies
    kind = docs.schema[doc_id].dataType.simpleString()
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_counter(vocabulary), f"doc_id {kind}, tokens bigint")
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int")))
    items = counted.withColumn("piece", F.explode(pieces)).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"),
        F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"),
    )
    items, _ = keep(items, "pieces")  # ids of pieces are fixed from here on
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("n_tokens").agg(F.count("*").alias("k")).collect():  # at most capacity + 1 rows
        counts[r["n_tokens"]] = r["k"]
    p = plan(counts, capacity, groups)
    group = F.element_at(F.lit(p.group_of), F.col("n_tokens") + 1)
    sized = items.withColumn("g", group)
    shown = ["uid", "doc_id", "piece", "start", "n_tokens", "container"]

    buckets = max(1, math.ceil(counts.sum() / BUCKET))
    large = sized.where("g >= 0").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    per = large.groupBy("g", "bucket").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("g").orderBy("bucket")) - F.col("k")
    large = large.withColumn("nth", F.row_number().over(Window.partitionBy("g", "bucket").orderBy("uid")) - 1).join(per.select("g", "bucket", before.alias("before")), ["g", "bucket"])
    # At most GROUPS times the number of configurations, independent of the corpus.
    schema = "g int, first bigint, each bigint, base bigint, until bigint"
    ends: dict[tuple[int, int], int] = {}
    by_group: dict[int, list[tuple[int, int, int]]] = {}
    for g, first, each, base in p.rows:
        by_group.setdefault(g, []).append((first, each, base))
    for g, rows in by_group.items():
        for (first, _, _), nxt in zip(rows, [*(x[0] for x in rows[1:]), 1 << 60]):
            ends[g, first] = nxt
    slots = spark.createDataFrame([(g, first, each, base, ends[g, first]) for g, first, each, base in p.rows], schema)
    rank = F.col("nth") + F.col("before")
    placed = large.join(F.broadcast(slots), (large["g"] == slots["g"]) & (rank >= F.col("first")) & (rank < F.col("until"))).withColumn("container", F.col("base") + F.floor((rank - F.col("first")) / F.col("each")))
    placed, _ = keep(placed.select(*shown), "packed-large")

    shards = max(1, math.ceil(max(p.containers, int(counts[: capacity // SMALL + 1].sum())) / SHARD))
    free = placed.groupBy("container").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("free")).where("free > 0")
    spaces = free.withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(shards)))
    small = sized.where("g < 0 and n_tokens > 0").drop("g").withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    filled = small.groupBy("shard").cogroup(spaces.groupBy("shard")).applyInPandas(
        _best_fit(capacity, shards, p.containers), f"uid bigint, doc_id {kind}, piece int, start bigint, n_tokens int, container bigint"
    )
    full = placed.unionByName(filled)
    position = F.row_number().over(Window.partitionBy("container").orderBy(F.desc("n_tokens"), "uid")) - 1
    full = full.withColumn("position", position)
    empty = items.where("n_tokens = 0").withColumn("container", F.lit(None).cast("bigint")).withColumn("position", F.lit(None).cast("int"))
    return full.unionByName(empty).select("doc_id", "piece", F.col("start").alias("start_token"), "n_tokens", "container", "position")


def packing_faults(rows: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row of counts, all 0 where a packing (:func:`packed`) is right, and its number of pieces."""
    held = rows.where("container is not null").groupBy("container").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.max("position").alias("last"), F.min("position").alias("first"), F.count_distinct("position").alias("places")
    )
    c = held.agg(F.count_if(F.col("n") > capacity).alias("overfull"), F.count_if((F.col("first") != 0) | (F.col("last") + 1 != F.col("k")) | (F.col("places") != F.col("k"))).alias("positions_not_dense"))
    # Pieces of one id: those of all its texts; a piece that is no text's last one is full.
    by = rows.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("texts"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"))
    want = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("want"), F.count_if(F.length(F.coalesce(F.col(text), F.lit(""))) > 0).alias("with_text"))
    x = want.join(by, want["doc_id"].eqNullSafe(by["doc_id"]), "full_outer")
    t = x.agg(
        F.count_if(F.coalesce("texts", F.lit(0)) != F.coalesce("want", F.lit(0))).alias("texts_lost_or_doubled"),
        F.count_if(F.col("with_text").eqNullSafe(1) & (F.col("want") == 1) & (F.col("pieces") != F.ceil(F.col("n") / capacity))).alias("cut_without_need"),
    )
    p = rows.agg(F.count("*").alias("n_pieces"), F.count_if((F.col("n_tokens") > 0) & F.col("container").isNull()).alias("without_container"), F.count_if(F.col("start_token") != F.col("piece") * capacity).alias("wrong_start"))
    return p.crossJoin(c).crossJoin(t)  # one row each
