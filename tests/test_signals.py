"""Signals on small hand-made tables: ties, nulls and empty input."""

import datetime as dt

from pyspark.sql import functions as F

from emberline.operators import signals as G

D = lambda n: dt.datetime(2024, 1, n, 12)


def test_running_benefit_restarts_after_a_gap(spark):
    df = spark.createDataFrame([("x", 0, 10, 1), ("x", 5, 10, 2), ("x", 100, 7, 3), ("y", None, 5, 4), ("z", 3, 1, 5), ("z", 3, 1, 6)], "k string, t long, s long, id int")
    got = G.running_benefit(df, "k", F.col("t"), F.col("s"), "id").collect()
    assert sorted(map(tuple, got)) == [("x", 107), ("z", 5)]
    assert G.running_benefit(df.limit(0), "k", F.col("t"), F.col("s"), "id").count() == 0


def test_asymmetric_pairs_take_the_smaller_opponent_of_a_tie(spark):
    events = spark.createDataFrame([(i, v, D(day)) for i, (v, day) in enumerate([(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (8, 3), (9, 5)])], "event_id int, victim_id int, killed_at timestamp")
    actors = spark.createDataFrame([(i, 1) for i in range(7)] + [(0, 1)], "event_id int, actor_id int")
    got = {r.me: (r.opp, r.battles, r.outbound, r.inbound) for r in G.asymmetric_pairs(actors, events).collect()}
    assert got == {1: (7, 3, 0.75, 1.0), 7: (1, 3, 1.0, 0.75), 8: (1, 3, 1.0, 0.75)}


def test_a_null_affiliation_is_not_hostile(spark):
    actors = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "event_id int, actor_id int")
    sides = spark.createDataFrame([(2, 1), (3, None)], "actor_id int, bloc_id int")
    got = {r.actor_id: (r.neighbors, r.hostile_pct) for r in G.community_hostile_share(actors, sides, F.col("bloc_id") == 1).collect()}
    assert got == {1: (2, 0.5), 2: (2, 0.0), 3: (2, 0.5)}


def test_clusters_split_where_the_gap_is_larger(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(0), 1), (1, at(60), 2), (1, at(121), 3), (1, at(181), 3), (2, at(0), 1)], "p int, t timestamp, w int")
    got = [(r.p, r.events, r.participants) for r in G.event_clusters(df, "p", "t", "w", 60, 2).collect()]
    assert got == [(1, 2, 2)]
