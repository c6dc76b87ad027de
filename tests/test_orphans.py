import datetime as dt

from topoweave.operators.orphans import in_scope, orphan_references, orphan_report, parent_rows, reference_rows

T = lambda d, h=0: dt.datetime(2024, 1 + d // 28, 1 + d % 28, h)
EDGE = "edge_id bigint, source string, target string, observed_at timestamp_ntz, `key` string, period int"
NODE = "id string, observed_at timestamp_ntz, deleted_at timestamp_ntz, valid_to int"


def found(spark, edges, nodes):
    e = spark.createDataFrame([(*r, "clash", 1) for r in edges], EDGE)
    n = spark.createDataFrame([(*r, 7) for r in nodes], NODE)
    refs = reference_rows(e, "edges", "edge_id", ["source", "target"], "observed_at")
    return refs, orphan_references(refs, parent_rows(n, "id", "observed_at", "deleted_at"))


def brute(edges, nodes):
    out = []
    for i, s, t, at in edges:
        for end, v in (("source", s), ("target", t)):
            v = v.strip(" \t") if v is not None else ""
            if v and not any(n == v and o is not None and at is not None and o <= at and (x is None or x > at) for n, o, x in nodes):
                out.append((i, end))
    return sorted(out)


def test_each_row_is_judged_at_its_own_time(spark):
    nodes = [("a", T(1), T(5)), ("a", T(20), None), ("a", T(20), None), ("b", T(3), T(3)), ("c", None, None), ("A", T(0), None), (None, T(0), None)]
    edges = [(k, v, w, T(d, h)) for k, (v, w, d, h) in enumerate((v, w, d, h) for v in ("a", " a\t", "b", "c", None, "", "  ") for w in ("a", "zz") for d in (0, 1, 4, 5, 19, 20, 40) for h in (0, 3))]
    edges += [(1000, "a", "b", None), (1001, "a", "a", T(4)), (1001, "a", "a", T(4))]
    got = sorted((r.row_id, r.endpoint) for r in found(spark, edges, nodes)[1].collect())
    assert got == brute(edges, nodes)


def test_hot_key_and_overlapping_spans(spark):
    nodes = [("hot", T(d), T(d + 2)) for d in range(0, 30, 3)] + [("hot", T(0), T(4)), ("hot", T(50), None)]
    edges = [(k, "hot", "gone" if k % 3 else "hot", T(k % 60, k % 24)) for k in range(3000)]
    got = sorted((r.row_id, r.endpoint) for r in found(spark, edges, nodes)[1].collect())
    assert got == brute(edges, nodes)


def test_empty_tables(spark):
    assert found(spark, [], [("a", T(0), None)])[1].count() == 0
    assert found(spark, [(1, "a", None, T(1))], [])[1].count() == 1


def test_report_counts_and_scope(spark):
    refs, lost = found(spark, [(1, "p.a", "p.b", T(1)), (2, "p.b", "p.b", T(40)), (3, "q.b", None, None)], [("p.a", T(0), None)])
    rows = {(r.endpoint, r.period): (r.n_references, r.n_orphans, r.n_orphan_keys) for r in orphan_report(refs, lost).collect()}
    assert rows == {("source", "2024-01"): (1, 0, 0), ("target", "2024-01"): (1, 1, 1), ("source", "2024-02"): (1, 1, 1), ("target", "2024-02"): (1, 1, 1), ("source", None): (1, 1, 1)}
    scope = spark.createDataFrame([("q",), ("q",), (None,)], "root string")
    assert [r.row_id for r in in_scope(refs, scope).collect()] == [3]
