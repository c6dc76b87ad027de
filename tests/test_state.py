import datetime as dt

from topoweave.functions.rank import global_rank
from topoweave.operators.layout import circular, hierarchical, spiral
from topoweave.operators.similarity import candidates, duplicate_groups, gram_overlap, neighbourhood_kernel, scored, tree_grams
from topoweave.sources.pysource import extract, relationships, symbols
from topoweave.streaming.changes import Versions, apply_edge_delta, apply_node_delta, as_of, edge_delta, edges_as_of, latest_by_stream, node_delta, refresh, remove_module, replace_files, run_to_table, windowed_counts
from tests_helpers import edges, ids, nodes

from pyspark.sql import functions as F

T = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def test_stream_of_changes_equals_one_rebuild(spark, tmp_path):
    schema = "path string, mtime timestamp_ntz, seq bigint, content string"
    rows = [(f"p{k % 7}", T(k * 37 % 50), k, f"v{k}") for k in range(60)]
    for b in range(6):
        spark.createDataFrame(rows[b * 10 : b * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r.path: r.content for r in latest_by_stream(stream, "path", ["mtime", "seq"]).collect()}
    want = {}
    for p, t, k, c in rows:
        want[p] = max(want.get(p, (dt.datetime.min, -1, "")), (t, k, c))
    assert got == {p: v[2] for p, v in want.items()}


def test_windows_on_table_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(T(k), "a" if k % 3 else "b") for k in range(0, 300)], "ts timestamp_ntz, kind string")
    df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    table = {tuple(r) for r in windowed_counts(df, "ts", "1 hour", "5 minutes", "kind").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path))
    seen = {tuple(r) for r in run_to_table(windowed_counts(stream, "ts", "1 hour", "5 minutes", "kind")).collect()}
    assert len(table) == 10 and seen <= table and len(seen) >= 8


def test_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    schema, src, state = "path string, seq bigint, content string", str(tmp_path / "in"), str(tmp_path / "state")
    run = lambda: {r.path: r.content for r in latest_by_stream(spark.readStream.schema(schema).parquet(src), "path", ["seq"], folder=state).collect()}
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1, "a1"), ("b", 5, "b5"), (None, 1, "n")])
    assert run() == {"a": "a1", "b": "b5", None: "n"}
    put([("a", 2, "a2"), ("b", 4, "b4"), ("c", 1, "c1")])
    # A new object and query, as after a lost driver: only the second file is read, the first is in the state.
    assert run() == {"a": "a2", "b": "b5", "c": "c1", None: "n"}
    v = Versions(spark, state)
    before = dict(v.where)
    v.upsert(spark.createDataFrame([("a", 9, "a9")], schema), "path", ["seq"], v.version)  # a batch that came through already
    assert v.where == before and run()["a"] == "a2"


def test_delta_round_trip(spark):
    schema = "seq bigint, id string, name string, symbol_type string, line_start int, line_end int, is_dead boolean, observed_at timestamp_ntz, deleted_at timestamp_ntz"
    n = spark.createDataFrame(
        [(1, "a", "a", "f", 1, 2, False, T(0), None), (2, "b", "b", "f", 1, 2, False, T(0), T(5)), (3, "c", "c", "f", 1, 2, False, T(6), None), (4, "d", "d", "f", 1, 2, False, T(0), None), (5, "d", "d", "f", 1, None, False, T(7), None)], schema
    )
    e = spark.createDataFrame([("a", " d", "CALLS", T(0)), ("b", "a", "calls", T(1)), ("c", "a", "calls", T(1)), ("a", "x", "calls", T(9)), (None, "x", "calls", T(0)), ("a", "", "calls", T(0))], "source string, target string, edge_type string, observed_at timestamp_ntz")
    times = "2024-01-01 00:03:00", "2024-01-01 00:10:00"
    old, new = (as_of(n, t) for t in times)
    d = node_delta(old, new)
    assert {r.id: r.change for r in d.collect()} == {"b": "removed", "c": "added", "d": "updated"}
    assert sorted(map(tuple, apply_node_delta(old, d).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)
    eo, en = (edges_as_of(e, x, t) for x, t in zip((old, new), times))
    de = edge_delta(eo, en)
    assert {(r.source, r.target, r.change) for r in de.collect()} == {("b", "a", "removed"), ("c", "a", "added"), ("a", "x", "added")}
    assert sorted(map(tuple, apply_edge_delta(eo, de, new).collect())) == sorted(map(tuple, en.collect()))
    assert refresh(old, eo, d, de).first() == (5, 6, True) and not refresh(old, eo, d.limit(1), de.limit(0)).first().whole


def test_updated_files_give_what_a_rebuild_gives(spark):
    files = "file_id bigint, path string, module string, content string, mtime timestamp_ntz"
    old = [
        (1, "p/__init__.py", "p", "from p.x import helper\n", T(0)), (2, "p/x.py", "p.x", "class K:\n    def go(self): pass\ndef helper() -> K: pass\n", T(0)),
        (3, "p/y.py", "p.y", "from p.x import K, helper\ndef use():\n    helper().go()\n    K().go()\n", T(0)), (4, "q.py", "q", "import p.y\ndef far():\n    p.y.use()\n", T(0)),
    ]
    new = [(5, "p/x.py", "p.x", "class Base:\n    def go(self): pass\nclass K(Base):\n    pass\ndef helper() -> K: pass\n", T(1)), (6, "q.py", "q", None, T(1)), (7, "p/z.py", "p.z", "from p import helper\ndef late():\n    helper()\n", T(1))]
    graph = lambda rows: {tuple(r)[:3] for r in relationships(rows, symbols(rows)).collect()}
    rows = extract(spark.createDataFrame(old, files))
    before, got = graph(rows), graph(replace_files(rows, spark.createDataFrame(new, files)))
    want = graph(extract(spark.createDataFrame([x for x in old if x[0] in (1, 3)] + [x for x in new if x[3]], files)))
    assert got == want and ("p.y.use", "p.x.K.go", "calls") in before and ("p.y.use", "p.x.Base.go", "calls") in got and ("p.z.late", "p.x.helper", "calls") in got
    n = nodes(spark, module="p pq", function="p.f pq.f")
    left, links = remove_module(n, edges(spark, "p.f>pq.f pq.f>p.f pq.f>pq"), "p")
    assert ids(left) == ["pq", "pq.f"] and [(r.source, r.target) for r in links.collect()] == [("pq.f", "pq")]


def test_ranks_and_layouts(spark):
    df = spark.createDataFrame([(f"i{k:03}", "module" if k < 3 else "function" if k < 9 else "odd") for k in range(50)], "id string, symbol_type string")
    assert [(r.id, r.nth) for r in global_rank(df.repartition(7), "id").orderBy("id").collect()] == [(f"i{k:03}", k) for k in range(50)]
    for f in (spiral, circular, hierarchical):
        p = f(df).collect()
        assert len({(r.x, r.y) for r in p}) == 50 and min(r.x for r in p) >= 79.99 and min(r.y for r in p) >= 79.99
    assert len({r.y for r in hierarchical(df).collect()}) == 3
    assert spiral(df.limit(0)).count() == 0


FP = "fp_id bigint, minhash array<bigint>, ast_tree array<struct<depth int, label string>>, ast_node_counts map<string,int>, callees array<string>, callers array<string>, reads array<string>, writes array<string>, arg_names array<string>, arg_count int, line_count int, max_nesting_depth int, has_loops boolean, has_conditionals boolean, has_try_except boolean, has_yield boolean, has_await boolean"


def fp(i, m, tree=((0, "F"), (1, "A"), (1, "B")), callees=("x.a", "y.b"), lines=10):
    return (i, m, list(tree) if tree is not None else None, {"A": 1, "B": 2}, list(callees), [], ["r"], None, ["p"], 1, lines, 1, True, False, False, False, False)


def test_tree_grams(spark):
    trees = [[(0, "F"), (1, "A"), (2, "C"), (1, "B")], [(0, "F"), (1, "A"), (2, "D"), (1, "B")], [(0, "F"), (1, "B"), (1, "A"), (2, "C")], [(0, "F"), (1, "A"), (1, "A"), (1, "A")], None, []]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(trees)], "k int, t array<struct<depth int, label string>>")
    df = tree_grams(df, "k", "t").withColumnRenamed("grams", "g")
    x = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), gram_overlap(F.col("a.g"), F.col("b.g")).alias("s"))
    got = {(r.i, r.j): r.s for r in x.collect()}
    # Changing one of four labels leaves three grams; a swap of siblings changes those that name the sibling before.
    assert got[0, 0] == 1 and got[0, 1] == 0.75 and got[0, 2] == 0.5 and got[3, 3] == 1 and got[0, 3] == 0.5 and got[0, 4] == got[4, 4] == got[5, 0] == 0


def test_kernel_closed_form(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["a", "c", "d"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(neighbourhood_kernel(F.col("a"), F.col("b"))).collect()] == [1.0, round(3 / 25, 6), 0.0, 0.0]


def test_duplicate_groups(spark):
    m = list(range(100))
    df = spark.createDataFrame([fp(1, m), fp(2, m), fp(3, m[:50] + [x + 1000 for x in m[50:]], lines=12), fp(4, [x + 5000 for x in m]), fp(5, None), fp(6, [])], FP)
    assert {tuple(r) for r in candidates(df).collect()} == {(1, 2), (1, 3)}
    scores = {(r.a, r.b): r.score for r in scored(candidates(df), df).collect()}
    assert scores[1, 2] == 1.0 and 0.9 < scores[1, 3] < 1.0
    assert scored(candidates(df), df, least=1.0).count() == 1
    members, summary = duplicate_groups(df, 0.6)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 1)} and summary.first().n_pairs == 2


def test_store_of_keyed_rows(spark, tmp_path):
    schema = "id string, v int, at int"
    row = lambda *r: spark.createDataFrame([*r], schema)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "id string")
    held = lambda df: sorted((r["id"], r.v) for r in df.collect())
    s = Versions(spark, str(tmp_path / "store"), buckets=4)
    assert s.count(schema) == 0 and held(s.get(keys("a"), schema)) == []
    s.delete(keys("a"), schema)  # nothing there to take out
    s.upsert(row(*[(f"k{i}", i, 1) for i in range(20)]), "id", ["at"])
    s.upsert(row(("k1", 100, 2), ("k2", 200, 0)), "id", ["at"])
    assert held(s.get(keys("k1", "k1", "k2", "none", None), schema)) == [("k1", 100), ("k2", 2)]
    s.delete(keys("k1", "k3", "none", None), schema)
    again = Versions(spark, str(tmp_path / "store"), buckets=4)
    assert again.count(schema) == 18 and held(again.get(keys("k1", "k2"), schema)) == [("k2", 2)]
    again.delete(again.rows(schema).select("id"), schema)  # every bucket becomes empty
    assert again.count(schema) == 0 and Versions(spark, str(tmp_path / "store"), buckets=4).count(schema) == 0
    again.upsert(row(("x", 1, 1)), "id", ["at"])
    again.clear()
    assert Versions(spark, str(tmp_path / "store"), buckets=4).count(schema) == 0
