"""Reachability and paths beyond six steps and over all edge types, against brute force."""

import random

from tests_helpers import edges, ids, nodes
from topoweave.operators.graph import PropertyGraph
from topoweave.queries.flow_queries import all_call_distances, all_paths_all_types, call_chain_deep, isolate_deep, shortest_path_all_types


def walked(steps, start, most):
    seen, at, d = {start: 0}, {start}, 0
    while at and d < most:
        d += 1
        at = {t for s, t in steps if s in at} - set(seen)
        seen.update(dict.fromkeys(at, d))
    return seen


def simple(steps, path, end, most):
    if path[-1] == end:
        return {path}
    return set() if len(path) > most else set().union(*(simple(steps, (*path, t), end, most) for s, t in steps if s == path[-1] and t not in path))


def test_flows_against_brute_force(spark):
    r, names = random.Random(5), [f"v{k:02}" for k in range(40)]
    chain = [(f"v{k:02}", f"v{k + 1:02}") for k in range(24)]
    calls = [*chain, *[(f"w{k}", "v00") for k in range(9)], *[("v00", f"x{k}") for k in range(9)]]
    reads = [("v01", "y0"), ("y0", "y1"), ("y1", "v03"), ("v05", "y2"), ("y2", "v06"), ("v02", "z0"), ("z0", "z1"), *[(f"z{k}", f"z{k + 1}") for k in range(1, 5)], *[tuple(r.sample(names[30:], 2)) for _ in range(6)]]
    every = sorted({x for e in calls + reads for x in e})
    g = PropertyGraph(nodes(spark, function=" ".join(every)), edges(spark, " ".join([*(f"{s}>{t}" for s, t in calls), *(f"{s}>{t}:reads" for s, t in reads)])))
    m, both = "v00", calls + reads
    assert {r["id"]: r.depth for r in all_call_distances(g, spark, None).collect()} == walked(calls, m, 99)
    near = walked(both, m, 8)
    far = min(near, key=lambda v: (-near[v], v))
    want = simple(both, (m,), far, 8)
    assert near[far] > 6 and {tuple(r.path) for r in all_paths_all_types(g, spark, None).collect()} == want
    assert tuple(shortest_path_all_types(g, spark, None).first().path) == min(want, key=lambda p: (len(p), p))
    called = walked(calls, m, 8)
    end = min(called, key=lambda v: (-called[v], v))
    assert ids(call_chain_deep(g, spark, None)) == sorted({v for p in simple(calls, (m,), end, 8) for v in p})
    assert ids(isolate_deep(g, spark, None)) == sorted(walked(both + [(t, s) for s, t in both], m, 3))
