"""Archives and dimension files that the tests write, against what was put in."""

import bz2
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from emberline.queries import archives as queries
from emberline.schema import Views
from emberline.sources import archives, dimensions, nested


def archive(path, members):
    path.parent.mkdir(exist_ok=True)
    with tarfile.open(path, "w:bz2") as tar:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            if raw is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw or b""))


def test_days_are_read_member_by_member(spark, tmp_path):
    event = lambda n, **more: json.dumps({"event_id": n, **more}).encode()
    archive(tmp_path / "2023/killmails-2023-12-31.tar.bz2", [("9/x.json", event(9))])
    archive(tmp_path / "2024/killmails-2024-01-01.tar.bz2", [("1", None), ("1/abc.json", event(1)), ("2.json", event(2)), ("3/abd.json", event(3, killmail_hash="own")), ("bad/a.json", b"{"), ("bad/b.json", b"\xff"), ("bad/c.json", b"[1]"), ("empty.json", b"")])
    archive(tmp_path / "2024/killmails-2024-01-02.tar.bz2", [(f"{n}/h{n}.json", event(n, killed_at="2024-01-02T00:00:00Z")) for n in range(10, 1210)])
    (tmp_path / "2024/killmails-2024-01-03.tar.bz2").write_bytes(b"no archive")
    (tmp_path / "2024/other.txt").write_text("x")
    base = f"file://{tmp_path}"
    rows = archives.members(archives.archive_files(spark, base, "2024-01-01", "2024-01-03")).cache()
    assert {(r.event_hash, json.loads(r.value)["event_id"]) for r in rows.where("day = '2024-01-01' and value is not null").collect()} == {("abc", 1), (None, 2), ("own", 3)}
    assert sorted((str(r.day), r.read, r.bad_members, r.broken) for r in archives.faults(rows).collect()) == [("2024-01-01", 3, 4, False), ("2024-01-02", 1200, 0, False), ("2024-01-03", 0, 0, True)]
    assert nested.parsed(rows.where("day = '2024-01-02'")).selectExpr("count(distinct event_id)").first()[0] == 1200
    assert archives.archive_files(spark, base, "2025-01-01", "2025-01-02").count() == 0


def test_only_the_days_asked_for_are_opened(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        archive(tmp_path / f"2024/killmails-{day}.tar.bz2", [("1/a.json", b"{}")])
    files = archives.archive_files(spark, f"file://{tmp_path}", "2024-01-02", "2024-01-02")
    assert [p.rsplit("/", 1)[1] for p in files.inputFiles()] == ["killmails-2024-01-02.tar.bz2"]


def test_an_archive_cut_off_keeps_its_first_members(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for n in range(40):
            raw = json.dumps({"event_id": n, "x": "y" * 9000}).encode()
            info = tarfile.TarInfo(f"{n}/h.json")
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    whole = out.getvalue()
    rows = [("a/killmails-2024-01-01.tar.bz2", bz2.compress(whole[: len(whole) // 2])), ("a/killmails-2024-01-02.tar.bz2", None)]
    got = {str(r.day): (r.read, r.broken) for r in archives.faults(archives.members(spark.createDataFrame(rows, archives.FILES))).collect()}
    assert 15 <= got["2024-01-01"][0] <= 20 and got["2024-01-01"][1] and got["2024-01-02"] == (0, True)


def test_packed_archives_read_back(spark):
    rows = [("2024-01-01", n % 2, f"{n}/h{n}.json", json.dumps({"event_id": n})) for n in range(9)]
    events = spark.createDataFrame(rows, "day string, part int, member string, value string").withColumn("day", F.to_date("day"))
    files = archives.packed(events)
    assert files.count() == 2
    assert sorted((str(r.day), r.member, r.value) for r in archives.members(files).collect()) == sorted((r[0], r[2], r[3]) for r in rows)


def test_columns_by_specification(spark, tmp_path):
    rows = [
        {"_key": 1, "name": {"en": "One", "de": "Eins"}, "position": {"x": 1.5}, "factionID": "7"},
        {"_key": 2.9, "name": {"de": "Zwei", "fr": "Deux"}, "position": 3, "factionID": "7.5"},
        {"_key": "x", "name": "n" * 150, "position": {"x": "2"}, "factionID": None},
        {"_key": 4, "name": {}, "position": {"x": None}, "more": [1]},
        {"_key": 5, "name": {"en": "", "it": "Cinque"}},
    ]
    text = "\n".join([*map(json.dumps, rows), "", "  ", "{bad", "[1]", "3"])
    (tmp_path / "mapRegions.jsonl").write_text(text)
    (tmp_path / "unknown.jsonl").write_text("{}\n")
    tables, unmapped = dimensions.load(spark, f"file://{tmp_path}")
    assert unmapped == ["unknown.jsonl"] and [*tables] == ["mapRegions.jsonl"]
    got = tables["mapRegions.jsonl"].collect()
    want = [(1, "One", 1.5, 7), (2, "Zwei", None, None), (None, "n" * 100, 2.0, None), (4, "", None, None), (5, "", None, None)]
    assert [(r.id, r.name, r.position_x, r.faction_id) for r in got] == want
    assert [json.loads(r.data) for r in got] == rows
    assert dimensions.bad_lines(spark.read.text(f"file://{tmp_path}/mapRegions.jsonl")).count() == 3


def test_kinds(spark):
    lines = spark.createDataFrame([('{"b": true, "s": 12, "j": {"k": [1, 2]}}',), ('{"b": 0, "s": "%s", "j": "t"}' % ("s" * 300),), ('{"b": "no"}',), ("{}",)], "value string")
    got = dimensions.rows_of(lines, dimensions.specification("b bool\ns str\nj json")).collect()
    assert [(r.b, r.s, r.j) for r in got] == [(True, "12", '{"k":[1,2]}'), (False, "s" * 255, '"t"'), (True, None, None), (False, None, None)]
    with pytest.raises(ValueError, match="kind"):
        dimensions.Field("a", "a", "date")


def test_a_day_is_one_archive_until_it_is_full(spark, monkeypatch):
    """Before, an archive was a range of ids of a day, so that most archives of a large table held some events only."""
    v = Views(spark, "/root/testdata/sf0.001")
    events, days = v.events.count(), v.events.select(F.to_date("killed_at")).distinct().count()
    monkeypatch.setattr(queries, "PART", 10_000)
    rows = archives.members(queries.day_archives(v))
    assert queries.day_archives(v).count() == days and rows.where("fault is null").count() == events
    monkeypatch.setattr(queries, "PART", 2)
    assert queries.day_archives(v).count() > days
    assert archives.members(queries.day_archives(v)).select("event_hash").distinct().count() == events


def test_blocks_are_unpacked_once_and_streams_follow_one_another():
    random = __import__("random").Random(5)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for i in range(400):
            info = tarfile.TarInfo(f"{i}/h{i}.json")
            raw = json.dumps({"n": i, "pad": random.randbytes(400).hex()}).encode()
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    whole = out.getvalue()
    half = len(whole) // 2
    for content in (bz2.compress(whole), bz2.compress(whole[:half]) + bz2.compress(whole[half:])):
        got = list(archives._members(content))
        assert [r[1] for r in got] == [f"h{i}" for i in range(400)] and {r[3] for r in got} == {None}
    broken = list(archives._members(bz2.compress(whole[:half])))
    assert broken[-1][3] == "archive" and len(broken) == sum(1 for r in broken if r[3] is None) + 1 > 100
    assert list(archives._members(b"")) == [(None, None, None, "archive")]
