"""Search on vectors of which a third are copies of one, and large groups of near-copies."""

import numpy as np

from topoweave.llm.neighbours_queries import QUERIES

ROW = "vec_id bigint, function_id string, embedding array<float>, created_at double, model_name string"


def written(spark, tmp_path, x):
    rows = [(k, f"f{k}", [float(v) for v in x[k]], float(k), "codemini-2") for k in range(len(x))]
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "function_vectors.parquet"))
    return str(tmp_path)


def test_every_query_gets_five_rows_with_copies(spark, tmp_path):
    r = np.random.default_rng(3)
    x = (r.standard_normal((120, 64))[np.arange(1200) % 120] + 0.25 * r.standard_normal((1200, 64))).astype(np.float32)
    x[1:400] = x[1]  # copies, among them queries that are not the first of them
    x[[500, 707, 803]] = x[500]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for row in QUERIES["p2_search"](spark, written(spark, tmp_path, x)).collect():
        got.setdefault(row.vec_id, []).append((row.neighbour_id, row.similarity))
    assert sorted(got) == list(range(0, 1200, 100))
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        assert len(found) == 5 and q not in [i for i, _ in found]
        hits += sum(v >= np.sort(s)[-5] - 1e-9 for _, v in found)
    assert hits >= 0.95 * 60
    assert {i for i, _ in got[100]} == {1, 2, 3, 4, 5} and {707, 803} <= {i for i, _ in got[500]}


def test_near_copies_below_a_code_step(spark, tmp_path):
    r = np.random.default_rng(4)
    x = (r.standard_normal((200, 64))[np.arange(2400) % 200] + 0.3 * r.standard_normal((2400, 64))).astype(np.float32)
    # Groups of near-copies: far below a code step, about one, between; small ones that share a code; copies among them.
    for first, last, jitter in ((0, 700, 1e-4), (700, 900, 1e-2), (900, 1100, 2e-3), (1100, 1103, 1e-5), (1103, 1130, 1e-4)):
        x[first:last] = x[first] * (1 + jitter * r.standard_normal((last - first, 64)))
    x[50:60] = x[50]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    last = np.sort(s, axis=1)[:, -5]
    d = written(spark, tmp_path, x)

    def hits(rows, low, high):
        return sum(s[q, v] >= last[q] - 1e-15 for q, v in rows if low <= q < high)

    near = [(a.vec_id, a.neighbour_id) for a in QUERIES["p2_neighbours"](spark, d).collect()]
    assert len(set(near)) == len(near) == 5 * 2400
    for low, high in ((0, 700), (700, 900), (900, 1100), (1100, 1103), (1103, 1130), (1130, 2400)):
        assert hits(near, low, high) >= 0.9 * 5 * (high - low), (low, hits(near, low, high))
    found = [(a.vec_id, a.neighbour_id) for a in QUERIES["p2_search"](spark, d).collect()]
    assert len(found) == 5 * 24 and hits(found, 0, 2400) >= 0.9 * 5 * 24
