"""Leakage, reading levels, packing and documented functions against plain versions of themselves."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topoweave.llm import leakage
from topoweave.llm.docpairs import documented_functions
from topoweave.llm.leakage import leaked_items
from topoweave.llm.packing import CAPACITY, VOCABULARY, encoding, packed, packing_faults, plan, tokens_of
from topoweave.llm.reading import fit, held_out, reading_levels, vocabulary, with_counts


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, u in docs:
            v = words(u)
            if grams and any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def leaks(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, "s") for r in items], "item_id bigint, text string, suite string")
    return {tuple(r) for r in leaked_items(d, i).collect()}


@pytest.mark.parametrize("block", [400_000, 40])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(30)]
    items += [(100, None), (101, " .,"), (102, "One-Two"), (103, items[3][1]), (104, "KK")]
    docs = []
    for d in range(120):
        w = r.choices(vocabulary, k=r.randrange(1, 400))
        part = words(r.choice(items)[1])
        at = r.randrange(len(w))
        docs.append((d, r.choice([" ", ", ", "\r\n"]).join(w[:at] + part[: r.choice([5, 13, 40])] + w[at:]).upper()))
    docs += [(500, None), (501, ""), (502, "äone\ntwoö"), (503, "one" * 100_000), (504, "bone two"), (7, docs[7][1]), (505, "K k")]
    assert leaks(spark, docs, items) == brute_leaks(docs, items)


def test_leaks_of_nothing(spark):
    assert leaks(spark, [], [(1, "a")]) == set() and leaks(spark, [(1, "a")], []) == set()


def test_very_long_text_and_item(spark):
    w = [f"u{k}" for k in range(60_000)]
    assert leaks(spark, [(1, " ".join(w)), (2, " ".join(w[30_000:30_013])), (3, " ".join(w[::2]))], [(1, " ".join(w))]) == {(1, 1), (2, 1)}


TEXTS = [
    "One two. Three four five! Six?", "No end", "", None, "# head\n- list item one.\n1. two\n  > quote\nReal words here.\r\n| a | b |\nand more",
    "a```code one. two```b c", "x ```open fence. never closed", "A.B c... D?! e", "Äpfel und Öl.", "word " * 50_000,
]


def plain_counts(t):
    p = re.sub(r"```.*?(?:```|\Z)", "", t or "", flags=re.S)
    p = "\n".join(x for x in re.split(r"\r\n|\n|\r", p) if not re.match(r"[ \t]*(?:[#|\-*>]|[0-9]+\.)", x))
    w = re.findall("[A-Za-z]+", p)
    return len(w), max(1, len(re.findall(r"[.!?]+(?=\s|\Z)", p))), sum(map(len, w))


def test_prose_counts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "i int, text string, n_words_ string")
    got = {r.i: (r.n_words, r.n_sentences, r.n_letters) for r in with_counts(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(TEXTS)}


def test_ranker_orders_held_out_documents(spark):
    r = random.Random(1)
    easy, hard = "the cat sat on a mat and ran to it".split(), "notwithstanding epistemological considerations whenever heterogeneous infrastructure determines equivalence".split()

    def doc(level):
        return " ".join(" ".join(r.choices(hard if r.random() < level / 6 else easy, k=3 + 4 * level)) + "." for _ in range(12))

    levels = [1 + k % 5 for k in range(200)]
    docs = spark.createDataFrame([(k, doc(v)) for k, v in enumerate(levels)] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, levels[k] if k % 7 else None, x) for k in range(0, 150) for x in "ab"] + [(5000, 3, "a"), (None, 2, "b")], "doc_id bigint, reading_level int, rater string")
    rows = {x.doc_id: x for x in reading_levels(docs, fit(docs, labels)).collect()}
    held = [(levels[k], rows[k].reading_score, rows[k].reading_level) for k in range(150, 200)]
    pairs = [(a, b) for a in held for b in held if a[0] > b[0]]
    assert sum(a[1] > b[1] for a, b in pairs) / len(pairs) > 0.95
    assert np.mean([abs(a - c) for a, _, c in held]) < 0.8
    assert rows[900].reading_level is None and rows[901].n_words == 0
    told = held_out(docs, labels).first()
    assert told.n_documents > 10 and told.order > 0.9 and told.error < told.plain_error
    words, shares = vocabulary(docs, size=5)
    assert len(words) == 5 and shares == sorted(shares, reverse=True)
    none = fit(docs, labels.limit(0))
    assert {x.reading_level for x in reading_levels(docs, none).collect()} == {None}


def test_packing_loses_cuts_and_overfills_nothing(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(["alpha", "beta", " gamma", "x1", "..."], k=int(r.expovariate(1 / 200)) + 1))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "word " * 7_000), (903, " " * 20_000), (7, docs[7][1]), (None, "no id")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id bigint, text string, container int")
    done = packed(df).cache()
    faults = packing_faults(done, df).first().asDict()
    assert faults.pop("n_pieces") == done.count() and not any(faults.values()), faults
    broken = done.where("doc_id != 5").unionByName(done.where("doc_id = 6")).withColumn("container", F.least("container", F.lit(1)))
    faults = packing_faults(broken, df).first()
    assert faults.texts_lost_or_doubled == 3 and faults.overfull > 0 and faults.positions_not_dense > 0
    rows = done.collect()
    enc = encoding(VOCABULARY)
    want, got = defaultdict(list), defaultdict(list)
    for i, t in docs:
        want[i].append(tokens_of(t, enc))
    held, places = defaultdict(int), defaultdict(list)
    for x in rows:
        got[x.doc_id].append(x.n_tokens)
        if x.container is not None:
            held[x.container] += x.n_tokens
            places[x.container].append(x.position)
            assert x.n_tokens > 0 and x.start_token == x.piece * CAPACITY
    assert {k: sum(v) for k, v in got.items()} == {k: sum(v) for k, v in want.items()}
    assert max(held.values()) <= CAPACITY and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(got[i]) == sum(max(1, -(-n // CAPACITY)) for n in v) for i, v in want.items())
    assert sum(held.values()) / (len(held) * CAPACITY) > 0.95
    assert packed(df.limit(0)).count() == 0


def test_configurations_fit_and_place_every_piece():
    counts = np.zeros(CAPACITY + 1, np.int64)
    r = np.random.default_rng(3)
    np.add.at(counts, np.clip(r.lognormal(6, 1, 5_000).astype(int), 1, CAPACITY), 1)
    p = plan(counts)
    by = np.zeros(max(p.group_of) + 1, np.int64)
    for n, g in enumerate(p.group_of):
        if g >= 0:
            by[g] += counts[n]
    assert by.sum() == counts[129:].sum()
    assert p.containers >= (counts[129:] * np.arange(129, CAPACITY + 1)).sum() / CAPACITY


def test_inherited_documentation_of_random_hierarchies(spark):
    """Every undocumented method gets the documentation of the nearest level of bases, of equals the leftmost."""
    r = random.Random(12)
    bases = {k: r.sample(range(k), r.randrange(min(k, 3) + 1)) for k in range(60)}
    state = {(k, m): r.choice(["none", "none", "told", "bare"]) for k in bases for m in "ab" if r.random() < 0.7}
    says = lambda k, m: f"Explains number {chr(97 + k // 26)}{chr(97 + k % 26)}x of every single method {m}{m}"
    text = ""
    for k, up in bases.items():
        text += f"class C{k}({', '.join(f'C{b}' for b in up)}):\n    x = 1\n"
        for m in "ab":
            if (s := state.get((k, m))) is not None:
                doc = says(k, m) if s == "told" else "TODO"
                text += f"    def {m}(self):\n        {'pass' if s == 'none' else repr(doc)}\n"
    want = {}
    for (k, m), s in state.items():
        level, seen = ([(k, ())], {k}) if s == "none" else ([], set())
        while level:
            nxt = {}
            for c, route in level:
                for n, b in enumerate(bases[c]):
                    if b not in seen:
                        nxt[b] = min(nxt.get(b, (9,) * 99), (*route, n))
            seen |= set(nxt)
            hits = [(route, b) for b, route in nxt.items() if state.get((b, m)) in ("told", "bare")]
            if hits:
                b = min(hits)[1]
                if state[b, m] == "told":
                    want[f"m.C{k}.{m}"] = f"m.C{b}.{m}"
                break
            level = list(nxt.items())
    df = spark.createDataFrame([(1, "m.py", "m", text, None)], "file_id bigint, path string, module string, content string, mtime timestamp_ntz")
    got = {x.qualified_name: x.doc_from for x in documented_functions(df).where("doc_origin = 'inherited'").collect()}
    assert got == want and len(want) > 5


SOURCE = '''
import base.core as bc
from base import core
from .near import Other

class Child(core.Base, Other):
    def run(self):
        return 1
    def told(self):
        """Explain clearly what happens to every single record."""
    def silent(self): pass
    def empty(self):
        ""
class Grand(Child):
    async def run(self, a: int = 1, *, b) -> str:
        pass
    def told(self): pass
def load_data(x):
    """load data data"""
# describes the loading of
#   remote configuration files
@deco
def plain():
    def inner():
        """TODO explain the inner workings of this function"""
    def other(x):
        """Args:
            x: not a description at all here
        """
if True:
    def guarded():
        "Counts the remaining open\\nconnections of a pool.\\nReturns:\\n a b c d"
'''
BASE = 'class Root:\r\n\tdef run(self):\r\n\t\t"""Runs the whole task until every step has finished."""\r\nclass Base(Root):\r\n    pass\r\nclass Loop(Loop):\r\n    def f(self): pass\r\n'


def test_documented_functions(spark):
    t = lambda d: __import__("datetime").datetime(2024, 1, d)
    files = [
        (1, "pkg/mod.py", "pkg.mod", "def old(): pass", t(1)), (2, "pkg/mod.py", None, SOURCE, t(2)), (3, "base/core.py", None, BASE, None), (4, "bad.py", "bad", "def (", t(1)),
        (5, "gone.py", "gone", 'def f():\n    "says what the function does here"', t(1)), (6, "gone.py", "gone", None, t(1)), (7, None, "x", "def f(): pass", t(1)), (8, "nul.py", "nul", "a\0b", t(1)),
    ]
    df = spark.createDataFrame([(*f, "x") for f in files], "file_id bigint, path string, module string, content string, mtime timestamp_ntz, name string")
    rows = {r.qualified_name: r for r in documented_functions(df).collect()}
    assert set(rows) == {"pkg.mod.Child.run", "pkg.mod.Grand.run", "pkg.mod.Child.told", "pkg.mod.Grand.told", "pkg.mod.plain", "pkg.mod.guarded", "base.core.Root.run"}
    assert rows["pkg.mod.Grand.run"].doc_from == "base.core.Root.run" and rows["pkg.mod.Grand.run"].doc_origin == "inherited"
    assert rows["pkg.mod.Grand.run"].signature == "async def run(self, a: int=1, *, b) -> str"
    assert rows["pkg.mod.Grand.told"].description.startswith("Explain clearly") and rows["pkg.mod.plain"].doc_origin == "comment"
    assert rows["pkg.mod.guarded"].description == "Counts the remaining open\nconnections of a pool." and rows["pkg.mod.guarded"].tags == ["Returns"]
    assert rows["pkg.mod.plain"].code.startswith("@deco\ndef plain():")
    assert documented_functions(df.limit(0)).count() == 0
