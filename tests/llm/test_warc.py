import hashlib

import pytest

from emberline.llm import warc

SCHEMA = "page_id long, url string, html string, host string"


def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    big = "x" * 2000
    rows = [
        (1, "https://a.org/é x\r\nEvil: 1", "<p>plain</p>", "h"),
        (2, None, None, "h"),
        (3, "https://b.org/", big, "h"),
        (7, "https://b.org/2", big, "h"),
        (5, "https://b.org/3", big, "h"),
        (8, "https://c.org/", fake * 3 + "tail WARC/1.1\r\n", "h"),
        (9, "https://c.org/", "WARC/1.1\r\nno header", "h"),
        (10, "https://d.org/", "WARC/1.1\r\n", "h"),
        (None, "https://e.org/", big, "h"),
        (11, "u", "short", "h"),
        (12, "u", "short", "h"),
        (13, "", "Content-Length: 5\r\n\r\nWARC/1.1\r\nContent-Length: 9999\r\n\r\nñandú 🎉", "h"),
    ]
    rows += [(100 + i, f"https://n.org/{i}", f"<p>{i}</p>" * (i % 40) + (fake if i % 9 == 0 else ""), "h") for i in range(60)]
    return rows


def expected(rows):
    groups = {}
    for i, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        best = max((x for x in groups[raw] if x is not None), default=None)
        again = len(raw) >= 1000 and i is not None and i < best
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "2500b"])
def test_round_trip_over_splits(spark, tmp_path, split):
    rows = pages()
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split != "128m" else "4m")
    try:
        out = warc.read_warc(spark, path, keep_payload=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    assert got == expected(rows)
    text = {i: (h or "").encode() for i, _, h, *_ in rows}
    assert all(bytes(r.payload) == text[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_warc(spark, path).count() == 0


def test_broken_chain_ends_at_the_last_sound_record(spark, tmp_path):
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes((good + good.replace("Length: 2", "Length: 1").replace(":1>", ":2>") + good).encode())
    path = f"file://{tmp_path}/w"
    assert [r.page_id for r in warc.read_warc(spark, path).collect()] == [1]
    (told,) = warc.broken_chains(spark, path).collect()
    assert (told.sound_until, told.size) == (len(good), 3 * len(good))


def test_digests_are_compared_and_older_versions_read(spark, tmp_path):
    def record(version, digest):
        return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{digest[:4]}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"

    real = hashlib.sha1(b"ok").hexdigest()
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes((record("1.0", real.upper()) + record("1.1", "0" * 40) + record("1.0", "?")).encode())
    path = f"file://{tmp_path}/w"
    out = {r.record_id: (r.page_id, r.payload_digest, r.digest_ok) for r in warc.read_warc(spark, path).collect()}
    assert out == {
        f"<urn:uuid:{real.upper()[:4]}>": (None, real, True),
        "<urn:uuid:0000>": (None, real, False),
        "<urn:uuid:?>": (None, real, None),
    }
    assert warc.broken_chains(spark, path).count() == 0


def test_very_long_payload(spark, tmp_path):
    text = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "0123456789" * 300_000
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(1, "u", text, "h"), (2, "u", text, "h")], SCHEMA), path)
    out = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert (out[2].record_type, out[2].payload_bytes, out[2].digest_ok) == ("response", len(text), True)
    assert (out[1].refers_to, out[1].payload_digest) == (2, hashlib.sha1(text.encode()).hexdigest())
