import random
from collections import defaultdict
from itertools import permutations

import pytest

from tests_helpers import edges, ids, nodes
from topoweave.operators.centrality import betweenness, pagerank
from topoweave.operators.components import components
from topoweave.operators.cycles import cycles, is_cyclic, layers, strong_components
from topoweave.operators.deadcode import dead_imports, dead_returns, dead_symbols
from topoweave.operators.graph import PropertyGraph, proposal
from topoweave.operators.resolve import resolve_targets, structural_types
from topoweave.operators.traverse import reach, shortest_path, simple_paths, trace_function, trace_variable

def one(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "id string")


def test_reach_and_depth(spark):
    e = edges(spark, "a>b b>c c>a c>d d>d x>a")
    assert ids(reach(e, one(spark, "a"))) == list("abcd")
    assert ids(reach(e, one(spark, "a"), "backward")) == list("abcx")
    assert {r.id: r.depth for r in reach(e, one(spark, "a"), "both", 1).collect()} == {"a": 0, "b": 1, "c": 1, "x": 1}
    assert ids(reach(e, one(spark, "nowhere"))) == ["nowhere"]
    assert ids(reach(e.limit(0), one(spark))) == []


def test_paths(spark):
    e = edges(spark, "a>b a>c b>d c>d d>e b>e b>e:reads e>a")
    assert shortest_path(e, "a", "e").collect()[0].path == ["a", "b", "e"]
    assert shortest_path(e, "e", "d").collect()[0].path == ["e", "a", "b", "d"]
    assert shortest_path(e, "zz", "a").count() == 0
    got = sorted(tuple(r.path) for r in simple_paths(e, one(spark, "a"), one(spark, "e"), 3).collect())
    assert got == [("a", "b", "d", "e"), ("a", "b", "e"), ("a", "c", "d", "e")]
    twice = [tuple(r.path) for r in simple_paths(e, one(spark, "a"), one(spark, "e"), 2, distinct=False).collect()]
    assert twice == [("a", "b", "e")] * 2


def test_trace_function_roles(spark):
    roles, links = trace_function(edges(spark, "up>me me>down loop>me me>loop up>down:reads m>up:contains"), "me")
    assert {r.id: r.role for r in roles.collect()} == {"me": "origin", "up": "passthrough", "down": "destination", "loop": "mutator"}
    assert ("up", "down", "read") in {tuple(r) for r in links.collect()}


def test_trace_variable_roles(spark):
    e = edges(spark, "w>m.v:writes w2>m.v:writes both>m.v:reads both>m.v:writes r>m.v:reads w>p p>r r2>m.v:reads r2>r far>z")
    roles = {r.id: r.role for r in trace_variable(nodes(spark, function="w"), e, "v")[0].collect()}
    assert roles == {"m.v": "origin", "w": "origin", "w2": "mutator", "both": "mutator", "r": "destination", "p": "passthrough", "r2": "passthrough"}
    assert trace_variable(nodes(spark, function="w"), e, "unknown")[0].count() == 0


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(f"v{r.randrange(n):02}", f"v{r.randrange(n):02}") for _ in range(m)]


def closure(pairs):
    vs = {v for p in pairs for v in p}
    out = {v: {v} for v in vs}
    while True:
        new = {v: out[v].union(*(out[t] for s, t in pairs if s in out[v])) for v in vs}
        if new == out:
            return out
        out = new


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    pairs = random_edges(40, 38, seed)
    e = edges(spark, " ".join(f"{s}>{t}" for s, t in pairs))
    strong = defaultdict(set)
    c = closure(pairs)
    for v in c:
        for w in c[v]:
            if v in c[w] and v != w:
                strong[v].add(w)
    assert {r.id: r.component for r in strong_components(e).collect()} == {v: min(ws | {v}) for v, ws in strong.items()}
    weak = closure(pairs + [(t, s) for s, t in pairs])
    assert {r.id: r.component for r in components(e, "source", "target").collect()} == {v: min(ws) for v, ws in weak.items() if len(ws) > 1}
    want = {(min(range(len(p)), key=lambda i: p[i]), p) for k in range(1, 5) for p in permutations(sorted(c), k) if k < 3 and all((p[i], p[(i + 1) % k]) in set(pairs) for i in range(k))}
    want = {p for i, p in want if i == 0}
    assert {tuple(r.path) for r in cycles(e, 2).collect()} == want
    assert is_cyclic(e) == bool(want or strong)


def test_long_chain_components(spark):
    e = edges(spark, " ".join(f"v{i:03}>v{i + 1:03}" for i in range(120)) + " z>z")
    assert {r.component for r in components(e, "source", "target").collect()} == {"v000"}
    assert not is_cyclic(edges(spark, "a>b b>c")) and is_cyclic(edges(spark, "a>a"))


def test_layers(spark):
    e = edges(spark, "a>b b>c c>b c>d a>d x>d")
    got = {r.id: r.layer for r in layers(e, one(spark, *"abcdx")).collect()}
    assert got == {"a": 0, "x": 0, "b": 1, "c": 1, "d": 2}


def test_betweenness_of_star_and_chain(spark):
    e = edges(spark, "a>b b>c c>d")
    got = {r.id: round(r.score, 6) for r in betweenness(e, one(spark, *"abcd")).collect()}
    assert got == {"a": 0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0}
    e = edges(spark, "a>m b>m m>x m>y a>n n>x")
    got = {r.id: round(r.score, 6) for r in betweenness(e, one(spark, *"abmnxy")).collect()}
    assert got["m"] == round(3.5 / 20, 6) and got["n"] == round(0.5 / 20, 6)


def test_pagerank_keeps_mass_with_dangling(spark):
    e = edges(spark, "a>b a>b:reads a>c b>c")
    v = one(spark, *"abcd")
    got = {r.id: r["rank"] for r in pagerank(e, v, rounds=100).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["c"] > got["b"] > got["d"] and abs(got["a"] - got["d"]) < 1e-9


def test_dead_code(spark):
    n = nodes(spark, module="m", **{"function": "m.used m.unused m.main m.test_x m.cb", "class": "m.C m.D", "method": "m.C.go m.D.go", "parameter": "m.used.p m.used.q m.unused.p m.cb.z m.used.self", "variable": "m.v m.w m.D.f"})
    e = edges(spark, "m>m.used m>m.C:calls m.C>m.C.go:contains m.used>m.used.p:reads m.used>m.used.p:contains m.used>m.used.q:contains m>m.v:writes m>m.w:writes m>m.w:reads m.D>BaseModel:inherits m.D.go>m.D.f:writes m>m.cb:reads m.cb>m.cb.z:contains m.used>m.v2:returns m>m.x:imports m>mm:imports")
    g = PropertyGraph(n, e)
    dead = {r.id: r.reason for r in dead_symbols(g).collect()}
    assert dead == {"m.unused": "unreachable", "m.D": "unreachable", "m.D.go": "unreachable", "m.unused.p": "dead owner", "m.used.q": "never read", "m.v": "written, never read"}
    assert [tuple(r) for r in dead_returns(g, dead_symbols(g)).collect()] == [("m.used", "m.v2")]
    assert dead_imports(g).count() == 0


def test_views_and_overlay(spark):
    n = nodes(spark, module="a b", **{"class": "a.K", "function": "a.K.f a.g b.h"})
    g = PropertyGraph(n, edges(spark, "a.K.f>b.h a.g>a.K.f a>a.K:contains a.K.f>ext.x"))
    assert {tuple(r) for r in g.rolled_up_edges(g.visible("module")).collect()} == {("a", "b", "calls")}
    roles = spark.createDataFrame([("a.K.f", "destination"), ("a.g", "mutator"), ("zz.q", "origin")], "id string, role string")
    assert {tuple(r) for r in g.rolled_up_roles(roles, g.visible("module")).collect()} == {("a", "mutator")}
    more = proposal(g, "new", "a", calls=["b.h"], called_by=["a.g"])
    assert ids(more.callers_of("b.h")) == ["a.K.f", "a.new"] and g.nodes.count() == n.count()
    assert ids(more.all_nodes(False)) == ids(n) and more.all_nodes().count() == n.count() + 1
    assert ids(g.external_calls(), "target") == ["ext.x"]


def test_resolution(spark):
    n = nodes(spark, module="p.b", function="p.a.f p.b.f p.b.g q.flush")
    e = edges(spark, "p.b.g>f p.b.f>f p.b.g>b.f p.b.g>nothing p.b.g>x.flush p.b.g>p.a.f")
    got = {(r.source, r.target): r.resolved for r in resolve_targets(e, n).collect()}
    assert got == {("p.b.g", "f"): "p.b.f", ("p.b.f", "f"): "p.a.f", ("p.b.g", "b.f"): "p.b.f", ("p.b.g", "nothing"): "nothing", ("p.b.g", "x.flush"): "x.flush", ("p.b.g", "p.a.f"): "p.a.f"}
    uses = spark.createDataFrame([("v", "x"), ("v", "y"), ("w", "x"), ("u", "q")], "variable string, field string")
    fields = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "class string, field string")
    assert [tuple(r) for r in structural_types(uses, fields).collect()] == [("v", "A")]
