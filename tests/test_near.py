import math
import random

import pytest

from pyspark.sql import functions as F

from emberline.operators import battles, cliques, proximity
from emberline.queries import load
from emberline.streaming import state


def test_points_are_not_sent_to_the_driver_and_meet_once(spark):
    points = spark.createDataFrame([(i, float(i % 4), float(i % 3), 0.0) for i in range(60)], "id long, x double, y double, z double")
    out = proximity.within_distance(points, 1.5)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) and all(r.a < r.b for r in rows)
    cells = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(array(" in n]
    assert len(cells) == 1 and cells[0].count("__own") <= 14


def test_new_rows_of_a_repeated_key_are_counted_before_they_meet(spark):
    old = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "a", True), (None, "a", False), (5, None, False), (6, "z", False)], "id long, slug string, locked boolean")
    new = spark.createDataFrame([(10, "a"), (11, "a"), (12, "a"), (13, None), (14, "q"), (14, "q")], "id long, slug string")
    known = old.select("slug", F.col("id").alias("i"), F.col("locked").alias("l"))
    want = new.join(known, "slug", "left").where("not coalesce(l, false)").select(F.coalesce("i", "id"), "slug", F.lit(False))
    out = state.reconcile(old, new, "slug")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [*map(tuple, want.collect()), (3, "a", True)]))
    assert "repartition" in out._jdf.queryExecution().logical().toString().lower() and "sequence(1, __n" in out._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_joins_of_each_actor_without_all_pairs(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(40), rng.randrange(3), rng.randrange(12)) for _ in range(150)})
    out = battles.joined_together(spark.createDataFrame(rows, "actor_id long, grp int, day long"), 4, 3)
    want = []
    for x in {r[0] for r in rows}:
        gaps = {}
        for a, g, d in rows:
            for o, h, e in rows:
                if a == x != o and g == h and abs(d - e) <= 4:
                    gaps[o] = min(gaps.get(o, 9), abs(d - e))
        want += [(x, o, gap) for gap, o in sorted((v, k) for k, v in gaps.items())[:3]]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    joins = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in n]
    assert joins and all("abs" not in j and "<>" not in j for j in joins)


def test_circles_grow_in_batches_of_targets(spark):
    met = spark.createDataFrame([(t, o, d) for t in range(30) for o in (100, 101, 102) for d in (1, 2)], "target long, opponent long, day int")
    out = cliques.circles(met)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(t, [100, 101, 102], 3, 2, 6.0) for t in range(30)]


def test_fit_similarity_joins_no_actors_of_a_type(spark):
    plan = load()[0]["b20_fit_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [type_id" in plan and not any("Join " in n and "type_id" in n for n in plan.splitlines())


@pytest.mark.parametrize("together", [1000, 2])
def test_points_of_one_place_cross_as_a_row(spark, monkeypatch, together):
    """Each point crossed fourteen times (F5)."""
    monkeypatch.setattr(proximity, "TOGETHER", together)
    rng = random.Random(6)
    rows = [(i, *(float(rng.randrange(-4, 5)) for _ in "xyz")) for i in range(150)] + [(900 + i, 1.0, 1.0, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    want = {(p[0], q[0]): round(math.dist(p[1:], q[1:]), 9) for p in rows for q in rows if p[0] < q[0] and math.dist(p[1:], q[1:]) <= 2.5}
    got = proximity.within_distance(df, 2.5, 9)
    found = got.collect()
    assert {(r.a, r.b): r.distance for r in found} == want and len(found) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(__bs") < plan.index("Join Inner")


def test_pairs_of_fits_are_sent_once(spark):
    """They were joined with either size (F7)."""
    plan = load()[0]["b20_fit_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
