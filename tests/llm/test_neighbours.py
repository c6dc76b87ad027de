import datetime as dt

import numpy as np

from topoweave.llm.neighbours import brute_force, exact, fit_trees, leaf_rows, nearest_pairs, neighbour_graph, search, usable, vertices

from pyspark.sql import functions as F

ROW = "vec_id bigint, function_id string, embedding array<float>, created_at double, id string"


def rows(n, seed=0, width=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 5, width))
    x = centres[np.arange(n) % len(centres)] + 0.25 * r.standard_normal((n, width))
    return [(k, f"f{k}", [float(v) for v in x[k]], float(k), "x") for k in range(n)]


def test_usable_rows(spark):
    good = [1.0] * 4
    data = [
        (1, "a", good, 1.0, ""), (2, "a", good, 2.0, ""), (3, "a", [0.0] * 4, 3.0, ""), (4, "b", None, 1.0, ""), (5, "b", [1.0], 1.0, ""), (6, "b", [1.0, None, 1.0, 1.0], 1.0, ""),
        (7, "b", [float("nan"), 1.0, 1.0, 1.0], 1.0, ""), (8, "b", [float("inf"), 1.0, 1.0, 1.0], 1.0, ""), (9, None, good, None, ""), (10, None, good, 1.0, ""), (11, "c", good, 5.0, ""), (12, "c", good, 5.0, ""), (None, "d", good, 1.0, ""),
    ]
    got = usable(spark.createDataFrame(data, ROW), "vec_id", "function_id", "embedding", "created_at", 4)
    assert sorted(r.id for r in got.collect()) == [2, 9, 10, 12]


def graph_of(spark, data, width=16):
    v = usable(spark.createDataFrame(data, ROW), "vec_id", "function_id", "embedding", "created_at", width)
    codes, owners = vertices(v)
    return v, codes, owners, *neighbour_graph(codes)


def test_recall_of_graph_and_search(spark):
    v, codes, owners, graph, leaves = graph_of(spark, rows(1500))
    truth = {(r.query, r["id"]) for r in brute_force(v, v, 5).collect()}
    got = {(r["id"], r.nbr) for r in nearest_pairs(v, graph, owners, 5).collect()}
    assert len(truth & got) >= 0.95 * len(truth)
    q = v.where("id % 100 = 0")
    shared = spark.sparkContext.broadcast(fit_trees(codes, codes.count()))
    own = leaf_rows(vertices(q)[0], shared, 8).groupBy("id", "code").agg(F.collect_list("leaf").alias("leaves")).withColumnRenamed("id", "query")
    found = {(r.query, r["id"]) for r in search(own, codes, graph, leaves, 6).where("query != id").collect()}
    want = {p for p in truth if p[0] % 100 == 0}
    assert len(want & found) >= 0.95 * len(want)


def test_copies_are_each_others_nearest(spark):
    data = rows(200)
    data += [(1000 + k, f"c{k}", data[3][2], 1.0, "x") for k in range(400)]
    v, _, owners, graph, _ = graph_of(spark, data)
    got = nearest_pairs(v, graph, owners, 5, 0.999999).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r.nbr)
    copies = {3, *range(1000, 1400)}
    assert all(len(by[i]) == 5 and set(by[i]) <= copies for i in copies)


def test_few_vectors(spark):
    assert graph_of(spark, [])[3].count() == 0
    v, _, owners, graph, _ = graph_of(spark, rows(10)[:2])
    assert sorted((r["id"], r.nbr) for r in nearest_pairs(v, graph, owners, 5).collect()) == [(0, 1), (1, 0)]


def test_exact_cosine_of_extreme_values(spark):
    v = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1e-30, 0.0]), (3, [1.0, 1.0])], "id bigint, vector array<float>")
    p = spark.createDataFrame([(1, 2), (1, 3)], "id bigint, nbr bigint")
    got = {r.nbr: round(r.similarity, 6) for r in exact(p, v).collect()}
    assert got == {2: 1.0, 3: 0.707107}
