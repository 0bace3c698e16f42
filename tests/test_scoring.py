"""Scores and sinks on small rows: empty tables, nulls, ties, failures."""

from datetime import datetime, timedelta

import pytest

from emberline.operators import scoring as P
from emberline.sources import lines
from emberline.streaming import sinks

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_similar_finds_the_nearest_across_blocks_and_takes_empty_tables(spark):
    points = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(60)], "id long, x double, y double")
    whole, parted = (rows(P.similar(points, ("x", "y"), 5, 0.6, b)) for b in (1000, 9))
    assert whole and whole == parted
    assert rows(P.similar(points.limit(0), ("x", "y"))) == []


def test_incidents_without_a_place_are_one_place_and_long_signals_bridge_gaps(spark):
    schema = "place long, kind string, started_at timestamp, ended_at timestamp, reporter long, character long, cluster_id long, quality string, ships int"
    at = lambda m: T0 + timedelta(minutes=m)
    told = [
        (None, "hostile_cluster", at(0), at(50), 1, 1, 1, "strategic", None), (None, "combat_spike", at(5), at(5), None, 2, None, None, None),
        (None, "disengagement", at(60), at(60), None, 3, None, None, None), (None, "unknown", at(90), at(90), None, None, None, None, None),
        (7, "hostile_cluster", at(0), at(0), 1, 1, 2, None, 200),
    ]
    out = P.fused_incidents(spark.createDataFrame(told, schema)).select("place", "n", "type", "severity", "confidence").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 3, "engagement", "escalation", "low"), (None, 1, "telemetry_gap", "noise", "insufficient"), (7, 1, "hostile_contact", "escalation", "insufficient")], key=str)
    assert P.fused_incidents(spark.createDataFrame([], schema)).count() == 0


def test_sides_by_kills_then_by_allegiance(spark):
    pilots = spark.createDataFrame([(1, 10, 9), (1, 20, 9), (1, 30, 2), (1, 40, 1), (1, 50, 1)], "battle long, who long, n long")
    kills = spark.createDataFrame([(1, 10, 20, 4), (1, 20, 10, 1), (1, 30, 20, 3), (1, 40, 10, 1)], "battle long, killer long, victim long, n long")
    assert rows(P.sides(pilots, kills)) == [(1, 10, "A"), (1, 20, "B"), (1, 30, "A"), (1, 40, "C"), (1, 50, "C")]
    known = spark.createDataFrame([(50, 20, 4, 0), (40, 10, 1, 1)], "who long, other long, allied long, opposed long")
    assert rows(P.sides(pilots, kills, known)) == [(1, 10, "A"), (1, 20, "B"), (1, 30, "A"), (1, 40, "C"), (1, 50, "B")]
    assert rows(P.sides(pilots, kills.limit(0))) == []


def test_seeds_and_headers_of_nothing(spark):
    assert rows(P.seeds(spark.createDataFrame([], "who long, history long, met long"))) == []
    files = spark.createDataFrame([(1, "﻿Listener: A\nListener: B\n"), (2, ""), (3, None)], "id long, body string")
    assert rows(lines.headers(files).select("id", "listener"))[0] == (1, "B")
    got = lines.chunk_lines(spark.createDataFrame([(1, "é\r\n\n x", 100), (2, None, 0), (3, "", 0)], "id long, body string, start long"))
    assert rows(got) == [(1, 0, 100, "é"), (1, 2, 105, " x")]


def test_replace_window_keeps_other_windows(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write = sinks.replace_window(path, "day")
    for i, batch in enumerate(([(1, 1), (2, 2)], [(3, 2)], [(3, 2)])):
        write(spark.createDataFrame(batch, "x int, day int"), i)
    assert rows(spark.read.parquet(path).select("x", "day")) == [(1, 1), (3, 2)]


def test_relay_of_a_stream_isolates_a_failing_kind(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, kind string").write.parquet(f"file://{tmp_path}/in")
    got, dead, tries = [], [], []

    def broken(df):
        tries.append(1)
        raise ValueError("down")

    write = sinks.relay({"b": broken, "a": lambda df: got.extend(rows(df))}, lambda df: dead.extend(r["id"] for r in df.collect()))
    stream = spark.readStream.schema("id int, kind string").parquet(f"file://{tmp_path}/in")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert got == [(1, "a")] and sorted(dead) == [2, 3, 4] and len(tries) == 3


@pytest.mark.parametrize("leader, band", [(True, "leadership_exempt"), (False, "critical"), (None, "critical")])
def test_leaders_are_exempt(spark, leader, band):
    schema = "who long, affiliation double, hostile_overlap double, bridge double, churn double, inner_pct double, recent_join boolean, seeds long, is_seed boolean, ring long, leader boolean"
    out = P.review_priority(spark.createDataFrame([(1, 0.9, 0.9, None, None, 0.99, True, None, None, None, leader)], schema)).first()
    assert out["band"] == band and out["signals"] == 4 and (out["score"] == 0) == (leader is True)
