"""Similar sets and near copies against brute force, and their edge cases."""

import random
import re

from pyspark.sql import functions as F

from topoweave.llm import nearcopies, setjoin
from topoweave.llm.forest import pairs_within
from topoweave.llm.nearcopies import near_copies
from topoweave.llm.setjoin import member_pairs, similar_sets

FIELDS = ("x", "y")
SETS = "id bigint, x array<string>, y array<string>, a int, members int"


def set_pairs(spark, rows, t=0.7, least=5):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SETS)
    pairs, classes = similar_sets(df, "id", {f: F.col(f) for f in FIELDS}, t, least)
    return sorted(tuple(r) for r in member_pairs(pairs, classes).collect()), classes


def brute_sets(rows, t=0.7, least=5):
    s = {i: {(f, v.strip(" \t")) for f, a in (("x", x), ("y", y)) for v in a or [] if v is not None and v.strip(" \t")} for i, x, y in rows if i is not None}
    ids = sorted(i for i in s if len(s[i]) >= least)
    return sorted((a, b) for a in ids for b in ids if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9)


def test_sets_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        if i % 3 and rows:
            _, x, y = r.choice(rows[-30:])
            x, y = list(x), list(y)
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = f"w{r.randrange(400)}"
        else:
            x, y = [f"w{r.randrange(400)}" for _ in range(r.randrange(4, 14))] + ["all"], [f"w{r.randrange(60)}" for _ in range(r.randrange(4))]
        rows.append((i, x, y))
    rows += [(1000, None, None), (1001, [], ["a"]), (1002, [None, " ", "\t"], None), (1003, [" p ", "p", "q", "r", "s", "t"], None), (1004, ["p", "q", "r", "s\t", "t", None], []), (1005, ["p", "q", "r", "s"], ["t"]), (None, ["p", "q", "r", "s", "t"], None)]
    got, _ = set_pairs(spark, rows)
    want = brute_sets(rows)
    assert (1003, 1004) in got and not any(1005 in p for p in got)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_equal_sets_stay_one_class_and_overfull_neighbourhoods_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FULL", 3)
    base = [f"b{k}" for k in range(30)]
    rows = [(i, base[: 20 + i % 8], None) for i in range(120)]
    got, classes = set_pairs(spark, rows)
    assert got == brute_sets(rows)
    assert classes.select("class").distinct().count() == 8


def test_exact_mode_and_search_in_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FULL", 20)
    monkeypatch.setattr(setjoin, "QUERY_MEMBERS", 100)
    r = random.Random(8)
    rows = [(i, [f"m{k}" for k in r.sample(range(14), 9)], None) for i in range(150)]
    want = brute_sets(rows)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SETS)
    fields = {f: F.col(f) for f in FIELDS}
    pairs, classes = similar_sets(df, "id", fields, 0.7, 5, exact=True)
    assert sorted(tuple(x) for x in member_pairs(pairs, classes).collect()) == want
    heads, _ = setjoin.set_classes(df, "id", fields, 5)
    found = sorted((x.q, x.id) for x in setjoin.partners_in_blocks(heads.where("id % 5 = 0"), heads, 0.7).collect())
    ids = {x.id for x in heads.collect()}
    assert found == sorted((a, b) for p in want for a, b in (p, p[::-1]) if a % 5 == 0 and a in ids and b in ids)


def test_accounts_are_filled_by_further_trees(spark, monkeypatch):
    """Groups of similar, unequal sets overfill their places at every depth; no pair may be lost by deepening."""
    monkeypatch.setattr(setjoin, "FULL", 6)
    r = random.Random(6)
    rows = [(i, [f"g{i % 5}.{k}" for k in range(24) if r.random() < 0.9], None) for i in range(250)]
    want = brute_sets(rows)
    got, _ = set_pairs(spark, rows)
    assert set(got) <= set(want) and len(got) >= 0.998 * len(want)


def test_pairs_of_a_hot_group_are_cut_into_parts(spark):
    df = spark.createDataFrame([(i, 0 if i < 90 else i // 2) for i in range(120)], "id bigint, g bigint")
    got = sorted(tuple(x) for x in pairs_within(df, "g", 7).collect())
    assert got == sorted((a, b) for a in range(120) for b in range(a + 1, 120) if (a < 90 and b < 90) or (a >= 90 and a // 2 == b // 2))


def test_empty_set_tables(spark):
    assert set_pairs(spark, [])[0] == [] and set_pairs(spark, [(1, None, None)])[0] == []


TOKEN = re.compile(r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\sA-Za-z_0-9]")


def brute_groups(rows, t=0.6, least=40):
    s = {}
    for i, text in rows:
        w = TOKEN.findall(text or "")
        if len(w) >= least:
            s[i] = set(zip(w, w[1:], w[2:]))
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: find(i) for i in s}


def texts(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta ( ) = : 17 trace . emit".split()) + r.choice(["", "_x", str(r.randrange(50))])
    rows = []
    for i in range(n):
        if i % 2 and rows:
            w = r.choice(rows[-20:])[1].split()
            for _ in range(r.randrange(8)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = [word()] * r.randrange(2)
        else:
            w = [word() for _ in range(r.randrange(35, 160))]
        rows.append((i, " ".join(w)))
    return rows


def groups_of(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "rid bigint, text string, id string")
    return {r["id"]: (r["class"], r["group"]) for r in near_copies(df, "rid", "text").collect()}


def test_near_copies_against_brute_force(spark):
    rows = texts(260, 3) + [(900, None), (901, ""), (902, "few words only")]
    got = groups_of(spark, rows)
    assert {i: g for i, (_, g) in got.items()} == brute_groups(rows)


def test_copies_hot_nodes_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "FULL", 4)
    base = [f"t{k}" for k in range(100)]
    rows = [(i, " ".join(base[:40] + [f"edit{i % 9}"] + base[40:])) for i in range(90)]
    rows += [(500, " ".join(f"z{k}" for k in range(60_000))), (501, " ".join(f"z{k}" for k in range(60_010)))]
    got = groups_of(spark, rows)
    assert {i: g for i, (_, g) in got.items()} == brute_groups(rows)
    assert len({c for i, (c, _) in got.items() if i < 90}) == 9


def test_exact_mode_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "FULL", 30)
    rows = texts(120, 9)
    df = spark.createDataFrame([(*r, "x") for r in rows], "rid bigint, text string, id string")
    assert {r["id"]: r["group"] for r in near_copies(df, "rid", "text", exact=True).collect()} == brute_groups(rows)


def test_a_great_group_of_unequal_texts_is_settled_by_neighbours(spark, monkeypatch):
    """Texts that are all alike but never equal, far more than a place may hold, beside others; groups as by brute force."""
    monkeypatch.setattr(nearcopies, "FULL", 16)
    r, rows = random.Random(4), texts(40, 5)
    for i in range(1_000, 1_300):
        w = [f"t{k}" for k in range(90)]
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(90)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = groups_of(spark, rows)
    assert {i: g for i, (_, g) in got.items()} == brute_groups(rows)


def test_no_texts_and_repeated_ids(spark):
    assert groups_of(spark, []) == {} and groups_of(spark, [(1, None)]) == {}
    t = " ".join(f"t{k}" for k in range(50))
    assert groups_of(spark, [(1, t), (1, t), (1, t + " more"), (2, t), (None, t)]) in ({1: (1, 1), 2: (1, 1)}, {1: (1, 1), 2: (2, 1)})
