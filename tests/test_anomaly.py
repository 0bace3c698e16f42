"""Combat anomalies by hand: peers, survival among the dying, cohort and past."""

import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import anomaly as A

END = datetime(2024, 6, 30)


def frames(spark, features, deaths=(), exchange=(), items=(), doctrine=()):
    return (
        spark.createDataFrame(features, "battle long, side long, category string, actor_id long, type_id long, damage_share double, started timestamp"),
        spark.createDataFrame(list(deaths), "battle long, actor_id long"),
        spark.createDataFrame(list(exchange), "battle long, side long, killed double, lost double"),
        spark.createDataFrame(list(items), "event_id long, actor_id long, killed_at timestamp, hull long, flag int, type_id long"),
        spark.createDataFrame(list(doctrine), "hull long, flag int, type_id long"),
        spark.createDataFrame([(1,)], "side long"),
    )


def run(spark, *args, **params):
    out = A.anomalies(*frames(spark, *args), F.lit(END.isoformat()).cast("timestamp"), A.AnomalyParams(**params)).collect()
    return {r.actor_id: r for r in out}


def fights(battles, actors, share=lambda b, a: 0.1 + 0.01 * a + 0.001 * b, **more):
    return [(b, 1, "tackle", a, 7, share(b, a), END - timedelta(days=b + 1)) for b in range(battles) for a in range(1, actors + 1)]


def test_peers_survival_and_bands(spark):
    rows = fights(6, 5)
    deaths = [(b, a) for b in range(6) for a in (1, 2, 3)]
    got = run(spark, rows, deaths, [(b, 1, 1.0, 2.0 if b < 5 else 0.0) for b in range(6)], min_cohort=5)
    shares = [0.1 + 0.01 * a for a in range(1, 6)]
    middle, spread = statistics.median(shares), statistics.stdev(shares)
    assert got[1].damage_z_battle == pytest.approx((shares[0] - middle) / spread, abs=1e-3)
    assert [got[a].survival_rate for a in range(1, 6)] == [0.0, 0.0, 0.0, 1.0, 1.0]
    assert got[1].qualifying == 6 and got[1].feed_rate == 0.833 and got[1].feeding_score == 1.333
    assert [got[a].band for a in (1, 3, 4)] == ["reinforces", "neutral", "reinforces"] and got[4].confidence == "medium"
    assert got[1].reinforcing == 2 and got[1].weakening == 1  # little damage and heavy losses, but it dies with its peers
    assert not got[1].has_baseline and got[1].damage_z_self is None


def test_too_few_peers_battles_or_cohort(spark):
    got = run(spark, fights(6, 2) + [(9, 1, None, 8, 7, 0.5, END)])
    assert set(got) == {1, 2} and got[1].damage_z_battle is None and got[1].qualifying == 0
    assert got[1].band == "insufficient_data" and got[1].cohort_size == 2 and got[1].damage_z_cohort is None and got[1].feed_rate == 0.0
    assert run(spark, []) == {}


def test_peers_are_capped_by_id(spark):
    rows = [(0, 1, "tackle", a, 7, 0.1 * a, END) for a in range(1, 9)]
    f, d, *_ = frames(spark, rows, [(0, 1), (0, 8)])
    one = A.peer_stats(f, d, A.AnomalyParams(peers=4)).first()
    assert (one.peers, one.middle, one.dead, one.last_peer) == (4, pytest.approx(0.25), 1, 4)


def test_a_special_hull_has_no_survival(spark):
    got = run(spark, [(b, 1, "tackle", a, 45534 if a == 1 else 7, 0.1 * a, END) for b in range(6) for a in range(1, 6)], [(b, a) for b in range(6) for a in (2, 3, 4)])
    assert got[1].qualifying == 0 and got[1].damage_z_battle is None and got[5].qualifying == 6


def test_cohort_and_past(spark):
    rows = fights(6, 4, lambda b, a: 0.1 * a) + [(100 + b, 1, "tackle", 1, 7, 0.2, END - timedelta(days=100 + b)) for b in range(5)]
    rows += [(200, 2, "tackle", 77, 7, 0.9, END)]  # not of the viewer's bloc
    got = run(spark, rows, min_cohort=4)
    means = [(6 * 0.1 + 5 * 0.2) / 11, 0.2, 0.3, 0.4]
    assert got[1].cohort_size == 4
    assert got[3].damage_z_cohort == pytest.approx((0.3 / 0.25 - statistics.median(means)) / statistics.stdev(means), abs=2e-3)
    assert got[1].has_baseline and got[1].damage_z_self == pytest.approx((0.1 / 0.25 - 0.2) / 0.06, abs=2e-3)


def test_fits_are_held_against_the_doctrine(spark):
    at = END - timedelta(days=1)
    doctrine = [(5, 11, 1), (5, 12, 2), (5, 13, 3), (6, 11, 1)]
    items = [(1, 1, at, 5, 11, 1), (1, 1, at, 5, 12, 9), (2, 1, at, 5, 11, 9), (2, 1, at, 5, 12, 9), (2, 1, at, 5, 13, 3), (2, 1, at, 5, 30, 9)]
    items += [(3, 1, at, 5, 11, 9), (4, 1, at, 6, 11, 9), (5, 1, at, 45534, 11, 9), (6, 1, END - timedelta(days=95), 5, 11, 9), (6, 1, END - timedelta(days=95), 5, 12, 9)]
    one = run(spark, fights(1, 1), (), (), items, doctrine)[1]
    assert (one.fit_median, one.fit_losses, one.as_victim) == (1, 2, 5) and one.reinforcing == 1
