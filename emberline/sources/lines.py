"""Lines of client logs, classified by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed formats of a line: a time stamp in brackets, then a kind in parentheses or a speaker and his message.
STAMP = r"^﻿?\[ (\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}) \] ?(.*)$"
PARTIAL = r"^﻿?\[ ?(\d{2}:\d{2}:\d{2}) ?\] ?(.*)$"
KIND = r"^\((\w+)\) ?(.*)$"
SPOKEN = r"^(.+?) > (.*)$"


def stamp(line: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(line, STAMP, 1), F.lit("")), F.lit("yyyy.MM.dd HH:mm:ss"))


def body(line: Column) -> Column:
    """What stands behind the time stamp, or the whole line."""
    return F.when(line.rlike(STAMP), F.regexp_extract(line, STAMP, 2)).when(line.rlike(PARTIAL), F.regexp_extract(line, PARTIAL, 2)).otherwise(line)


def line_class(line: Column, system_speaker: str) -> Column:
    """blank, header, combat_event, notify_event, motd, session_event, chat, continuation or unknown; null for null."""
    text = body(line)
    timed = line.rlike(STAMP) | line.rlike(PARTIAL)
    speaker, said = F.regexp_extract(text, SPOKEN, 1), F.regexp_extract(text, SPOKEN, 2)
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(r"^﻿?\s*(-{5,}|Listener:|Session [Ss]tarted:|Channel)"), "header")
        .when(~timed, "continuation")
        .when(text.rlike(r"^\(combat\)"), "combat_event")
        .when(text.rlike(KIND), "notify_event")
        .when((speaker == system_speaker) & said.contains("MOTD"), "motd")
        .when(speaker == system_speaker, "session_event")
        .when(speaker != "", "chat")
        .when(line.isNotNull(), "unknown")
    )


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(id, no, line_offset, line): the lines of text chunks (id, body, start), each with the byte at which it stands in its
    file, start being that of the chunk. Blank lines are counted but left out; a carriage return at a line's end goes."""
    rows = chunks.select("id", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.posexplode(F.split("body", "\n")).alias("no", "line"))
    before = W.partitionBy("id", "start").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0))
    rows = rows.withColumn("line_offset", at).where(F.col("line").rlike(r"[^\x00\x09-\x0B\x0D\x20]"))
    return rows.select("id", "no", "line_offset", F.regexp_replace("line", "\r$", "").alias("line"))


#: Fixed patterns of a file's header.
HEADER = {
    "listener": r"(?i)^Listener:\s*(.+)$",
    "session_started": r"(?i)^Session\s+Started:\s*(\d{4}\.\d{2}\.\d{2}\s+\d{2}:\d{2}:\d{2})",
    "channel_id": r"(?i)^Channel\s+ID:\s*(.+)$",
    "channel_name": r"(?i)^Channel\s+Name:\s*(.+)$",
}


def headers(files: DataFrame) -> DataFrame:
    """(id, listener, session_started, channel_id, channel_name) of files (id, body), from the lines above the first with a
    time stamp; the last of several holds, and what is absent is null."""
    lines = F.transform(F.split(F.regexp_replace("body", "^﻿", ""), "\r\n|\r|\n"), lambda x: F.trim(x))
    timed = F.transform("lines", lambda x: x.rlike(STAMP))
    upto = F.coalesce(F.nullif(F.array_position("timed", F.lit(True)), F.lit(0)) - 1, F.size("lines"))
    rows = files.select("id", lines.alias("lines")).withColumn("timed", timed).withColumn("head", F.slice("lines", F.lit(1), upto.cast("int")))

    def last(pattern: str) -> Column:
        return F.trim(F.regexp_extract(F.try_element_at(F.filter("head", lambda x: x.rlike(pattern)), F.lit(-1)), pattern, 1))

    return rows.select("id", *[last(p).alias(name) for name, p in HEADER.items()])
