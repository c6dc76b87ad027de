"""Strong components and layers: the same by rounds of all tasks and by one task, and few tables for long chains."""

from tests_helpers import edges
from topoweave.operators import components as comp, cycles, traverse


def tables(monkeypatch):
    """The tags of tables as they are written."""
    seen = []
    for m in (comp, cycles, traverse):
        monkeypatch.setattr(m, "keep", lambda df, tag, *by, keep=m.keep: (seen.append(tag), keep(df, tag, *by))[1])
    return seen


def rings(n):
    """Rings of two, each with a step to the next."""
    return " ".join(f"a{k:02}>b{k:02} b{k:02}>a{k:02}" + (f" b{k:02}>a{k + 1:02}" if k + 1 < n else "") for k in range(n))


def test_rings_one_after_another(spark, monkeypatch):
    seen = tables(monkeypatch)
    e = edges(spark, rings(12))
    assert {(r.id, r.component) for r in cycles.strong_components(e).collect()} == {(f"{x}{k:02}", f"a{k:02}") for k in range(12) for x in "ab"}
    assert len(seen) <= 4


def test_layers_of_a_long_chain(spark, monkeypatch):
    seen = tables(monkeypatch)
    e = edges(spark, rings(3) + " b02>c00 " + " ".join(f"c{k:02}>c{k + 1:02}" for k in range(20)))
    ids = e.selectExpr("explode(array(source, target, 'alone')) as id").distinct()
    want = {"alone": 0} | {f"{x}{k:02}": k for k in range(3) for x in "ab"} | {f"c{k:02}": k + 3 for k in range(21)}
    assert {r.id: r.layer for r in cycles.layers(e, ids).collect()} == want
    assert len(seen) <= 8


def test_rounds_of_all_tasks(spark):
    e = edges(spark, "a>b b>a b>c c>d d>c d>e x>x")
    ids = e.selectExpr("explode(array(source, target)) as id").distinct()
    assert {tuple(r) for r in cycles.strong_components(e, 0).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    assert {(r.id, r.layer) for r in cycles.layers(e.where("source in ('b', 'd') and target in ('c', 'e')"), ids, 1).collect()} == {("a", 0), ("b", 0), ("c", 1), ("d", 0), ("e", 1), ("x", 0)}


def test_no_steps(spark):
    e = edges(spark, "x>x")
    assert cycles.strong_components(e).collect() == []
    assert [tuple(r) for r in cycles.layers(e, e.selectExpr("source as id")).collect()] == [("x", "x", 0)]


def test_components_and_reach_of_a_long_chain(spark, monkeypatch):
    seen = tables(monkeypatch)
    e = edges(spark, " ".join(f"c{k:02}>c{k + 1:02}" for k in range(20)) + " d>e e>d x>x")
    assert {(r.id, r.component) for r in comp.components(e, "source", "target").collect()} == {(f"c{k:02}", "c00") for k in range(21)} | {("d", "d"), ("e", "d")}
    assert sorted(r.id for r in traverse.reach(e, spark.createDataFrame([("c05",), ("y",), (None,)], "id string")).collect()) == [f"c{k:02}" for k in range(5, 21)] + ["y"]
    assert len(seen) <= 3


def test_components_and_reach_by_rounds(spark):
    e, seeds = edges(spark, "a>b c>b c>d x>y"), spark.createDataFrame([("c",)], "id string")
    assert {tuple(r) for r in comp.components(e, "source", "target", 0).collect()} == {tuple(r) for r in comp.components(e, "source", "target").collect()}
    assert sorted(r.id for r in traverse.closure(traverse.directed(e), seeds, 0).collect()) == ["b", "c", "d"]
