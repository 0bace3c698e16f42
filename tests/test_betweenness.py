"""Betweenness against all shortest paths of small graphs."""

import hashlib
import random
from itertools import combinations

import pytest

from emberline.operators import graph
from emberline.operators.aggregates import co_occurrence
from emberline.operators.graph import betweenness


def by_paths(edges, ends=None):
    """Half of each path's share for either end that is a source."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = dict.fromkeys(near, 0.0)

    def walks(s):
        paths, seen = {s: [[s]]}, {s}
        front = [s]
        while front:
            new = {}
            for x in front:
                for y in near[x] - seen:
                    new.setdefault(y, []).extend(p + [y] for p in paths[x])
            paths |= new
            seen |= set(new)
            front = list(new)
        return paths

    ends = set(near) if ends is None else ends
    for s, t in combinations(sorted(near), 2):
        found = walks(s).get(t, [])
        for p in found:
            for x in p[1:-1]:
                out[x] += ((s in ends) + (t in ends)) / 2 / len(found)
    return out


def scores(spark, edges, **params):
    rows = spark.createDataFrame(edges, "a long, b long")
    return {r.id: r.betweenness for r in betweenness(rows, **params).collect()}


@pytest.mark.parametrize("nodes, n", [(7, 9), (14, 16), (12, 30)])
def test_all_sources(spark, nodes, n):
    rng = random.Random(n)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(50, 51), (51, 50), (3, 3)]
    assert scores(spark, edges) == pytest.approx(by_paths(edges))


def test_a_line_and_a_star(spark):
    assert scores(spark, [(i, i + 1) for i in range(6)]) == {i: i * (6 - i) for i in range(7)}
    assert scores(spark, [(0, i) for i in range(1, 9)]) == {0: 28.0} | {i: 0.0 for i in range(1, 9)}


def test_sampled_sources(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    ends = set(sorted(nodes, key=lambda x: hashlib.md5(f"{x}:7".encode()).hexdigest())[:4])
    assert scores(spark, edges, sources=4, seed=7) == pytest.approx(by_paths(edges, ends))


def test_no_edges(spark):
    assert scores(spark, []) == {} and scores(spark, [(1, 1)]) == {}


def test_many_slabs_and_parts(spark, monkeypatch):
    for name, size in (("_NEAR", 2), ("_NODES", 5), ("_ARCS", 4), ("_SUMS", 7)):
        monkeypatch.setattr(graph, name, size)
    rng = random.Random(3)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(60)]
    assert len(graph._Slabs(graph.both_ways(spark.createDataFrame(edges, "a long, b long"))).parts) > 2
    assert scores(spark, edges) == pytest.approx(by_paths(edges))


def test_edges_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    def edges():
        return spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long").mapInPandas(counted, "a long, b long")

    for walk in (lambda: graph.hops(edges(), [0], 6), lambda: graph.shortest_path(edges(), 0, 6, 6), lambda: graph.betweenness(edges())):
        before = read.value
        assert walk().collect()
        assert read.value == before + 6


def test_pairs_of_an_event_take_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 7), (1, 7), (1, 5), (1, 9), (2, 5), (2, None), (None, 5), (None, 7)], "event long, actor long")
    pairs = co_occurrence(rows, "event", "actor")
    assert sorted(map(tuple, pairs.collect())) == [(1, 5, 7), (1, 5, 9), (1, 7, 9)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_pairs_of_an_event_of_two_columns(spark):
    rows = spark.createDataFrame([(1, 1, 7), (1, 1, 5), (1, 2, 5), (1, 2, 9), (None, 2, 5), (None, 2, 9)], "battle long, event long, actor long")
    assert sorted(map(tuple, co_occurrence(rows, ["battle", "event"], "actor").collect())) == [(1, 1, 5, 7), (1, 2, 5, 9)]


def test_more_nodes_than_were_sampled(spark):
    """Of 620 nodes 500 were sources (F11)."""
    assert scores(spark, [(0, i) for i in range(1, 620)])[0] == 619 * 618 / 2


@pytest.mark.parametrize("dense", [0, 4, 2000])
def test_parts_by_matrix_and_by_slabs(spark, monkeypatch, dense):
    monkeypatch.setattr(graph, "_DENSE", dense)
    monkeypatch.setattr(graph, "_SUMS", 40)
    rng = random.Random(dense)
    edges = [(10 * g + rng.randrange(n), 10 * g + rng.randrange(n)) for g, n in enumerate((3, 9, 2, 7, 10)) for _ in range(2 * n)]
    assert scores(spark, edges) == pytest.approx(by_paths(edges))


def test_parts_of_a_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "_ARCS", 5)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.id: r.part for r in graph.parts(df).collect()} == least
