import math
import random

from emberline.llm import topk


def brute(rows, params, is_query):
    vs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vs[(i, tuple(math.floor(params.scale * x) for x in v))] = None
    out = []
    for i, q in vs:
        if not is_query(i):
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vs if j != i and len(v) == len(q))[: params.k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, params, is_query="vec_id % 5 = 0"):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    v = topk.quantise(df, params)
    return sorted(tuple(r) for r in topk.top_k(v, v.where(is_query), params).collect())


def test_against_brute_force(spark):
    random.seed(3)
    rows = [(i, [round(random.gauss(0, 0.3) * 8) / 8 for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    rows += [(2000, None), (2005, []), (2010, [1.0, None]), (2015, [float("nan")] * 6), (2020, [float("inf")] * 6)]
    rows += [(2040, []), (2041, []), (2025, [1.0, -2.0]), (2030, [3.0, 0.5]), (2035, [0.0] * 6), rows[10], (None, rows[3][1])]
    for params in (topk.TopKParams(k=7, block_rows=64, query_rows=50), topk.TopKParams(k=20)):
        assert run(spark, [(*r, 0) for r in rows], params) == brute(rows, params, lambda i: i % 5 == 0)


def test_large_components_stay(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [2.0**40, -1.0]), (2, [-(2.0**45), 0.0]), (3, [0.5, 2.0**52]), (5, [1.0, 1.0]), (10, [0.0, 2.0**40])]
    params = topk.TopKParams(k=4)
    want = [(q, r, v, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, r, v, s in brute(rows, params, lambda i: i % 5 == 0)]
    assert run(spark, [(*r, 0) for r in rows], params) == want
    assert run(spark, [(0, [1e30, 1.0], 0), (1, [0.0, 2.0], 0)], params) == [(0, 1, 1, 64 * 128)]


def test_fewer_rows_than_k_and_empty(spark):
    params = topk.TopKParams(k=20)
    assert run(spark, [(0, [1.0], 0), (1, [2.0], 0), (2, [-1.0], 0)], params) == [(0, 1, 1, 64 * 128), (0, 2, 2, -64 * 64)]
    assert run(spark, [], params) == []
