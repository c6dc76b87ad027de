"""Evaluation passages inside corpus documents, by shift-table multi-pattern search over words.

Patterns are the runs of ``window`` successive words of every item (or the
whole item where it is shorter).  For patterns cut to their least length m, a
table tells for each block of two words how far a search window may move on
(m - 1 where the block is in no pattern); where the move is 0 the block ends a
pattern, a bucket by that suffix block names the patterns, and a comparison of
all words, then of the letters themselves, confirms.  Documents are read once
per block of patterns and never shuffled; numpy moves all windows of an Arrow
batch at the same time, long documents being searched from many places at once.

Items are cut into overlapping passages, and distinct passages grouped into
blocks of about ``BLOCK_WORDS`` words; only one block at a time is collected and
broadcast, so an item set of any size is searched whole.  Which items own a
passage, however many, is a table that hits are joined with.

Defined results: words are runs of ASCII letters and digits, lower-cased; null
and wordless texts and items give no row; each (doc, item) pair comes once, so
repeated documents and items with equal text are each reported; null ids are
kept as null.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.plans.tables import keep

WINDOW = 13
#: Words of items in one broadcast block (about 40 MB with its tables).
BLOCK_WORDS = 400_000
#: Words of one passage; longer items are cut, overlapping by WINDOW - 1 words.
PASSAGE_WORDS = 2_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
_SLICE = 1 << 21
_LANE = 256
_TABLE_BITS = 18


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _MUL, np.uint64), dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word in UTF-8 ``data``; texts meet at ``offsets`` and share no word."""
    hashes, begins, ends = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets - offsets[0]] = True
    at, total = 0, len(data)
    while at < total:
        to = min(total, at + _SLICE)
        while to < total and _FOLD[data[to]] and not edge[to]:  # never inside a word
            to += 1
        t = _FOLD[data[at:to]]
        on = t != 0
        before = np.concatenate(([False], on[:-1])) & ~edge[at:to]
        s = np.flatnonzero(on & ~before)
        if len(s):
            idx = np.flatnonzero(on)
            first = np.searchsorted(idx, s)
            length = np.diff(np.append(first, len(idx)))
            where = np.arange(len(idx)) - np.repeat(first, length)
            with np.errstate(over="ignore"):
                h = np.add.reduceat((t[idx].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[where], first)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            hashes.append(h), begins.append(s + at), ends.append(s + at + length)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and its n + 1 offsets, from 0; null is empty."""
    a = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _block(w: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (1 or 2) words that end at each of ``at``."""
    with np.errstate(over="ignore"):
        return w[at] if size == 1 else w[at - 1] * _MUL + w[at]


def shift_tables(patterns: list[tuple[str, ...]]) -> list[dict]:
    """Search tables over distinct word patterns: one for the full windows, one for all shorter patterns."""
    tables = []
    longest = max((len(p) for p in patterns), default=0)
    for keep_long in (True, False):
        own = [i for i, p in enumerate(patterns) if (len(p) == longest) == keep_long]
        if not own:
            continue
        m = min(len(patterns[i]) for i in own)
        size = min(2, m)
        joined = " ".join(" ".join(patterns[i]) for i in own).encode()
        w, _, _ = words_of(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        lengths = np.array([len(patterns[i]) for i in own])
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        shift = np.full(1 << _TABLE_BITS, m - size + 1, np.uint8 if m < 256 else np.int32)
        for j in range(size - 1, m):
            slot = (_block(w, start + j, size) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            np.minimum.at(shift, slot, m - 1 - j)
        suffix = _block(w, start + m - 1, size)
        order = np.argsort(suffix, kind="stable")
        keys, first = np.unique(suffix[order], return_index=True)
        tables.append(
            {"m": m, "size": size, "shift": shift, "keys": keys, "first": np.append(first, len(order)), "order": order, "w": w, "start": start, "length": lengths, "prefix": _block(w, start + size - 1, size), "pattern": np.array(own)}
        )
    return tables


def search(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, pattern, first word) of every place where all word hashes agree; texts are w[lo:hi]."""
    m, size = t["m"], t["size"]
    texts = np.flatnonzero(hi - lo >= m)
    lanes = -(-(hi[texts] - lo[texts] - m + 1) // _LANE)
    text = np.repeat(texts, lanes)
    step = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    pos = lo[text] + m - 1 + step * _LANE
    stop = np.minimum(pos + _LANE, hi[text])
    hit_text, hit_pos = [], []
    while len(pos):
        move = t["shift"][(_block(w, pos, size) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.int64)
        hit = move == 0
        if hit.any():
            hit_text.append(text[hit]), hit_pos.append(pos[hit])
        pos = pos + np.maximum(move, 1)
        live = pos < stop
        pos, stop, text = pos[live], stop[live], text[live]
    none = np.zeros(0, np.int64)
    if not hit_pos:
        return none, none, none
    text, pos = np.concatenate(hit_text), np.concatenate(hit_pos)
    at = np.searchsorted(t["keys"], suffix := _block(w, pos, size))
    ok = (at < len(t["keys"])) & (t["keys"][np.minimum(at, len(t["keys"]) - 1)] == suffix)
    text, pos, at = text[ok], pos[ok], at[ok]
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(text), 20_000):  # bounds the expansion by bucket
        tx, ps, k = text[a : a + 20_000], pos[a : a + 20_000], at[a : a + 20_000]
        n = t["first"][k + 1] - t["first"][k]
        own = t["order"][np.repeat(t["first"][k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        tx, begin = np.repeat(tx, n), np.repeat(ps, n) - m + 1
        ok = (_block(w, begin + size - 1, size) == t["prefix"][own]) & (begin + t["length"][own] <= hi[tx])
        tx, begin, own = tx[ok], begin[ok], own[ok]
        for j in range(int(t["length"][own].max()) if len(own) else 0):
            inside = j < t["length"][own]
            ok = ~inside | (w[np.where(inside, begin + j, 0)] == t["w"][np.where(inside, t["start"][own] + j, 0)])
            tx, begin, own = tx[ok], begin[ok], own[ok]
        out[0].append(tx), out[1].append(t["pattern"][own]), out[2].append(begin)
    return tuple(np.concatenate(x) if x else none for x in out)


def item_passages(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """Words of every item, as passages that overlap by ``window`` - 1 words."""
    words = F.split(F.trim(F.lower(F.regexp_replace(F.col(text), "[^A-Za-z0-9]+", " "))), " ")
    i = items.select(F.col(item_id).alias("item_id"), words.alias("w")).where("w[0] != ''")
    step = PASSAGE_WORDS - window + 1
    last = F.greatest(F.size("w") - window, F.lit(0))
    return i.withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(step)))).select("item_id", F.slice("w", F.col("at") + 1, PASSAGE_WORDS).alias("words"))


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) of every document that holds ``window`` successive words of the item, or all of a shorter one."""
    spark = docs.sparkSession
    passages, _ = keep(item_passages(items, item_id, item_text, window).distinct(), "leak-passages")
    # Each distinct passage counts once, whoever owns it; its owners stay a table.
    texts, _ = keep(passages.select("words").distinct(), "leak-texts")
    total = texts.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * total / BLOCK_WORDS))
    id_type = docs.schema[doc_id].dataType
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    found = None
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        patterns = list({tuple(r["words"][k : k + window]) for r in rows for k in range(max(1, len(r["words"]) - window + 1))})
        shared = spark.sparkContext.broadcast((shift_tables(patterns), [" ".join(p).encode() for p in patterns]))
        part = base.mapInArrow(_searcher(shared), f"doc_id {id_type.simpleString()}, pattern string")
        found = part if found is None else found.union(part)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    owners = passages.select("item_id", F.explode(F.transform(begins, lambda k: F.array_join(F.slice("words", k, window), " "))).alias("pattern")).distinct()
    return found.join(owners, "pattern").select("doc_id", "item_id").distinct()


def _searcher(shared):
    def run(batches):
        tables, letters = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            w, begin, end = words_of(data, offsets)
            lo, hi = np.searchsorted(begin, offsets[:-1]), np.searchsorted(begin, offsets[1:])
            rows, found = [], []
            for t in tables:
                text, pattern, first = search(w, lo, hi, t)
                _, one = np.unique(text * len(letters) + pattern, return_index=True)
                for k in one:
                    p = letters[pattern[k]]
                    last = first[k] + p.count(b" ")
                    got = b" ".join(_FOLD[data[begin[j] : end[j]]].tobytes() for j in range(first[k], last + 1))
                    if got == p:
                        rows.append(text[k]), found.append(p.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["doc_id", "pattern"])

    return run
