"""Cycles of any length against brute force, and what a component too dense for that gives."""

import random

import pytest

from tests_helpers import edges
from topoweave.operators.cycles import all_cycles


def brute(pairs):
    out = {(s,) for s, t in pairs if s == t}

    def go(path):
        for s, t in pairs:
            if s == path[-1] and s != t:
                if t == path[0]:
                    out.add(path)
                elif t > path[0] and t not in path:
                    go((*path, t))

    for v in {s for s, _ in pairs}:
        go((v,))
    return out


def pairs(seed):
    r = random.Random(seed)
    ring = [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)]
    return [*ring, ("s", "s"), *{(f"v{r.randrange(6)}", f"v{r.randrange(6)}") for _ in range(11)}]


@pytest.mark.parametrize("seed", [1])
def test_long_cycles(spark, seed):
    p = pairs(seed)
    got = [(tuple(x.path), x.truncated) for x in all_cycles(edges(spark, " ".join(f"{s}>{t}" for s, t in p))).collect()]
    assert len(got) == len(set(got)) and set(got) == {(c, False) for c in brute(p)}
    assert max(len(c) for c, _ in got) == 7


def test_dense_component_covers_every_step(spark):
    p = [(f"k{a}", f"k{b}") for a in range(5) for b in range(5) if a != b and (a, b) != (1, 0)] + [("a", "b"), ("b", "c"), ("c", "a")]
    got = {(tuple(x.path), x.truncated) for x in all_cycles(edges(spark, " ".join(f"{s}>{t}" for s, t in p)), 5).collect()}
    every = brute(p)
    assert {c for c, _ in got} <= every and (("a", "b", "c"), False) in got
    steps = lambda c: {(c[i], c[(i + 1) % len(c)]) for i in range(len(c))}
    covered = {}
    for c, t in got:
        for s in steps(c):
            assert t == s[0].startswith("k")
            covered[s] = min(covered.get(s, 99), len(c))
    assert covered == {s: min(len(c) for c in every if s in steps(c)) for s in p}
