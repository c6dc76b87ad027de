"""Cycles walked and completed inside tasks: few tables however long they are, and the same rows as level by level."""

import random

import numpy as np
import pytest

from test_all_cycles import brute, pairs
from tests_helpers import edges
from topoweave.operators import cycles, intask
from topoweave.operators.cycles import all_cycles


def laid(p):
    ids = sorted({x for s in p for x in s})
    at = {x: k for k, x in enumerate(ids)}
    u, v = (np.array([at[s[k]] for s in p]) for k in (0, 1))
    return ids, u, v


def levels(p, most):
    """Cycles by walking all open paths a step at a time, to the first length of more than ``most``."""
    open_, found = [s for s in p if s[1] > s[0]], set()
    while open_:
        if len(open_) > most:
            return found, True
        on = [(x, t) for x in open_ for s, t in p if s == x[-1]]
        found |= {x for x, t in on if t == x[0]}
        open_ = [(*x, t) for x, t in on if t > x[0] and t not in x]
    return found, False


@pytest.mark.parametrize("most,starts,held", [(10**6, 1000, 4_000_000), (40, 1000, 7), (40, 2, 7), (12, 1, 7), (3, 2, 4_000_000)])
def test_walked_by_parts(monkeypatch, most, starts, held):
    monkeypatch.setattr(intask, "STARTS", starts)
    monkeypatch.setattr(intask, "HELD", held)
    r = random.Random(5)
    p = sorted({(f"v{k}", f"v{(k + 1) % 9}") for k in range(9)} | {s for s in ((f"v{r.randrange(9)}", f"v{r.randrange(9)}") for _ in range(14)) if s[0] != s[1]})
    ids, u, v = laid(p)
    found, dense = intask._walked(u, v, len(ids), most)
    got = [tuple(ids[k] for k in row) for x in found.values() for rows in x for row in rows]
    want, full = levels(p, most)
    assert len(got) == len(set(got)) and (set(got), dense) == (want, full)
    if not full:
        assert want == brute(p)


def test_long_ring_and_dense_component_take_few_tables(spark, monkeypatch):
    tags, keep = [], cycles.keep
    monkeypatch.setattr(cycles, "keep", lambda df, tag, *by: (tags.append(tag), keep(df, tag, *by))[1])
    ring = [(f"r{k:02}", f"r{(k + 1) % 40:02}") for k in range(40)]
    thick = [(f"k{a:02}", f"k{(a + b) % 30:02}") for a in range(30) for b in (1, 2)]
    got = {(tuple(x.path), x.truncated) for x in all_cycles(edges(spark, " ".join(f"{s}>{t}" for s, t in [*ring, *thick])), 100).collect()}
    assert (tuple(f"r{k:02}" for k in range(40)), False) in got
    rest = {c for c, t in got if t}
    assert {s for c in rest for s in zip(c, (*c[1:], c[0]))} == set(thick) and {len(c) for c in rest} == {15, 16}
    assert all(c[0] == min(c) for c in rest) and len(tags) < 10


def test_pairs_match(spark):
    p = pairs(3)
    assert {tuple(x.path) for x in all_cycles(edges(spark, " ".join(f"{s}>{t}" for s, t in p))).collect()} == brute(p)
