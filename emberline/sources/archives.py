"""Daily event archives: a tar.bz2 per day, a JSON text per member.

Archives are read as binary files, so from any store that Spark reads; only files of the days asked for are opened. An
archive is unpacked in one task, member by member, some hundred members a batch. What can't be read is a row with a
fault, so that bad members are counted and never stop a day: `json` for a member that isn't a JSON object or not UTF-8,
`archive` (without member) for the unread rest of an archive that is cut off or damaged.
"""

from __future__ import annotations

import bz2
import datetime
import io
import json
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the archives' format.
NAME = r"killmails-(\d{4}-\d{2}-\d{2})[^/]*\.tar\.bz2$"
HASH = "killmail_hash"

MEMBERS = "day date, member string, event_hash string, value string, fault string"
FILES = "path string, content binary"
_BATCH = 500


def archive_files(spark: SparkSession, base: str, first: str, last: str) -> DataFrame:
    """(path, content) of the archives below base with days from first to last, both included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.bz2")
    days = {p: m[1] for p in files.load(base).inputFiles() if (m := re.search(NAME, p))}
    chosen = sorted(p for p, day in days.items() if first <= day <= last)
    if not chosen:
        return spark.createDataFrame([], FILES)
    return spark.read.format("binaryFile").load(chosen).select("path", "content")


def _member(name: str, raw: bytes) -> tuple:
    """(event_hash, value, fault): the hash is the payload's own, or else the last part of a name that has a folder."""
    try:
        value = raw.decode()
        event = json.loads(value)
    except ValueError:
        return None, None, "json"
    if not isinstance(event, dict):
        return None, None, "json"
    parts = name.replace(".json", "").split("/")
    own = event.get(HASH)
    return str(own) if own is not None else parts[-1] if len(parts) > 1 else None, value, None


class _Unpacked:
    """A file over bz2 streams. tarfile's own copies what is left of a block, up to 900 kB, each time it reads 10 kB of it."""

    def __init__(self, content: bytes):
        self._rest, self._stream = content, bz2.BZ2Decompressor()

    def read(self, size: int) -> bytes:
        """Up to size bytes; less, in the end none, where the content breaks off."""
        out = b""
        while len(out) < size:
            if self._stream.eof:
                self._rest, self._stream = self._stream.unused_data, bz2.BZ2Decompressor()
            more = self._stream.decompress(self._rest, size - len(out))
            self._rest = b""
            if not more and not self._stream.eof:
                break
            out += more
        return out


def _members(content: bytes) -> Iterator[tuple]:
    try:
        with tarfile.open(fileobj=_Unpacked(content), mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    yield (member.name, *_member(member.name, tar.extractfile(member).read()))
    except (tarfile.TarError, OSError, EOFError):
        yield None, None, None, "archive"


def members(files: DataFrame) -> DataFrame:
    """(day, member, event_hash, value, fault): a row per member of the archives, a row per archive that breaks off."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.date32(), *[pa.string()] * 4]
        names = ["day", "member", "event_hash", "value", "fault"]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                found = re.search(NAME, path.as_py())
                day = found and datetime.date.fromisoformat(found[1])
                rows: list[tuple] = []
                for row in _members(content.as_py()):
                    rows.append((day, *row))
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(read, MEMBERS)


def faults(rows: DataFrame) -> DataFrame:
    """(day, read, bad_members, broken): what a day's archives gave."""
    of = lambda kind: F.count(F.when(F.col("fault") == kind, 1))
    return rows.groupBy("day").agg(F.count("value").alias("read"), of("json").alias("bad_members"), (of("archive") > 0).alias("broken"))


def packed(events: DataFrame) -> DataFrame:
    """(path, content): archives of (day, part, member, value) rows, one for each day and part, members in order of name.

    A part is held by one task, so it must be bounded.
    """

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("member")
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:bz2", compresslevel=1) as tar:
            for name, value in zip(group["member"].to_pylist(), group["value"].to_pylist()):
                raw = value.encode()
                info = tarfile.TarInfo(name)
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
        day, part = group["day"][0].as_py(), group["part"][0].as_py()
        return pa.table({"path": [f"{day.year}/killmails-{day}-{part}.tar.bz2"], "content": pa.array([out.getvalue()], pa.binary())})

    return events.select("day", "part", "member", "value").groupBy("day", "part").applyInArrow(pack, FILES)
