"""File sources and stored state, by hand."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from emberline.operators import proximity
from emberline.sources import nested, prices
from emberline.streaming import state


def test_price_history_checks_its_header(spark, tmp_path):
    good = "date,region_id,type_id,average,highest,lowest,volume,order_count,extra\n2024-01-01,1,34,5.5,6,5,100,3,x\nno,1,34,1,1,1,1,1,\n2024-01-02,1,,1,1,1,1,1,\n"
    (tmp_path / "a.csv.bz2").write_bytes(bz2.compress(good.encode()))
    rows = prices.price_history(spark, f"file://{tmp_path}").collect()
    assert [(str(r.date), r.type_id, r.average, r.volume) for r in rows] == [("2024-01-01", 34, 5.5, 100)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/b.csv").write_text("date,type_id\n2024-01-01,3\n")
    with pytest.raises(ValueError, match="region_id"):
        prices.price_history(spark, f"file://{tmp_path}/bad")


def test_price_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,region_id,type_id,average,highest,lowest,volume,order_count\n2024-01-01,1,34,5.5,6,5,100,3\n")
    (tmp_path / "b.csv").write_text("type_id,order_count,lowest,highest,date,average,region_id,volume\n35,4,7,9,2024-01-02,8,2,50\n")
    rows = prices.price_history(spark, f"file://{tmp_path}").collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(1, 34, 5.5, 6.0, 5.0, 100, 3), (2, 35, 8.0, 9.0, 7.0, 50, 4)]
    (tmp_path / "c.csv").write_text("date,region_id,type_id,average,lowest,highest,volume\n2024-01-01,1,77,5.5,6,5,100\n")
    (tmp_path / "d.csv").write_text("2024-01-01,1,78,5.5,6,5,100,2\n")
    with pytest.raises(ValueError, match="c.csv has no order_count|d.csv has no date"):
        prices.price_history(spark, f"file://{tmp_path}")
    bad = {r.file.split("/")[-1]: r.missing for r in prices.bad_files(spark, f"file://{tmp_path}").collect()}
    assert bad == {"c.csv": ["order_count"], "d.csv": list(prices.COLUMNS)}
    assert sorted(r.type_id for r in prices.price_history(spark, f"file://{tmp_path}", skip_bad_files=True).collect()) == [34, 35]


def test_nested_events(spark):
    one = {"event_id": 1, "killed_at": "2024-01-01T00:00:00Z", "system_id": 9, "victim": {"character_id": 5, "items": [{"type_id": 3, "flag": 27}]}, "attackers": [{"character_id": 7, "final_blow": True}, {"ship_type_id": 2}]}
    two = {"event_id": 2, "attackers": [{"ship_type_id": 2}]}
    raw = spark.createDataFrame([(json.dumps(one),), (json.dumps(two),), ("not json",), (None,), ('{"event_id": 3}',)], "value string")
    e = nested.parsed(raw)
    got = {r.event_id: (r.attacker_count, r.is_npc, r.is_solo, r.victim_id) for r in nested.event_rows(e).collect()}
    assert got == {1: (2, False, True, 5), 2: (1, True, False, None), 3: (0, True, False, None)}
    assert nested.attacker_rows(e).count() == 3 and nested.item_rows(e).count() == 1


def test_reconcile_keeps_ids_and_locked_rows(spark):
    old = spark.createDataFrame([(1, "a", False, "x"), (2, "b", True, "x"), (3, "c", False, "x")], "id long, slug string, locked boolean, v string")
    new = spark.createDataFrame([(10, "a", "y"), (11, "b", "y"), (12, "d", "y")], "id long, slug string, v string")
    got = sorted(tuple(r) for r in state.reconcile(old, new, "slug").collect())
    assert got == [(1, "a", False, "y"), (2, "b", True, "x"), (12, "d", False, "y")]


def test_sweep_and_dry_run(spark):
    rows = [(1, "2024-01-01", "k"), (2, "2024-01-20", "k"), (3, None, "k"), (4, "2024-01-29", "junk"), (5, "2024-01-29", None)]
    table = spark.createDataFrame(rows, "id int, t string, kind string").withColumn("at", F.to_timestamp("t"))
    rules = [state.Retention("at", 14), state.Retention("at", 0, "kind = 'junk'")]
    now = F.lit("2024-01-30").cast("timestamp")
    assert tuple(state.dry_run(table, rules, now).first()) == (1, 1)
    assert sorted(r.id for r in state.sweep(table, rules, now).collect()) == [2, 3, 5]


def test_within_distance_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    points = [(i, *(rng.uniform(-9, 9) for _ in range(3))) for i in range(150)] + [(500, 0.0, 0.0, 0.0), (501, 0.0, 0.0, 2.0)]
    got = {(r.a, r.b) for r in proximity.within_distance(spark.createDataFrame(points, "id long, x double, y double, z double"), 2.0).collect()}
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) ** 0.5
    assert got == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and far(p, q) <= 2.0}
