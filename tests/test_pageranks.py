"""PageRank of many graphs at once, and as the role chain uses it."""

import random

import pytest

from emberline.operators import graph
from emberline.queries import chain
from emberline.schema import Views


def by_steps(edges, steps=20):
    """{node: (degree, rank)} of edges (a, b, w)."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    rank, degree = dict.fromkeys(near, 0.15), {n: sum(near[n].values()) for n in near}
    for _ in range(steps):
        rank = {n: 0.15 + 0.85 * sum(w / degree[m] * rank[m] for m, w in near[n].items()) for n in near}
    return {n: (degree[n], pytest.approx(rank[n])) for n in near}


@pytest.mark.parametrize("local_edges", [10**6, 12, 0])
def test_each_graph_by_itself(spark, local_edges):
    rng = random.Random(5)
    graphs = {g: [(a, b, float(rng.randrange(1, 5))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6 or b == a + 1] for g, n in (("x", 4), ("y", 7), ("z", 9))}
    df = spark.createDataFrame([(1, g, *e) for g, rows in graphs.items() for e in rows], "battle int, side string, a long, b long, w double")
    got = {}
    for r in graph.pageranks(df, ["battle", "side"], local_edges=local_edges).collect():
        got.setdefault(r.side, {})[r.id] = (r.degree, r.rank)
    assert got == {g: by_steps(rows) for g, rows in graphs.items()}


def test_metrics_rank_by_more_than_a_step(spark):
    """The chain took the first step for the rank (F12)."""
    v = Views(spark, "/root/testdata/sf0.01")
    _, _, rows, met = chain.chain(v)
    graphs = {}
    for r in chain.edges(met).collect():
        graphs.setdefault((r.battle, r.side), []).append((r.a, r.b, r.w))
    want = {(*g, n): x for g, rows_ in graphs.items() for n, x in by_steps(rows_).items()}
    got = {(r.battle, r.side, r.actor_id): (r.degree, r.rank) for r in chain.metrics(met, rows).where("degree is not null").collect()}
    assert want and got == want
