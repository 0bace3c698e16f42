"""WARC archives: writing records, and reading them back with boundary-chain verification.

Writing: one record per page, its payload the html in UTF-8. Of records with equal payloads of at least `revisit_bytes`
the one with the largest page_id is the response, the others are revisits without a block, which name the response and
the payload's digest and length.

Reading: the archives split at the record magic, by Spark's own line reader, so any file splits into tasks. Each task
tells for every magic it meets, by the header behind it, where the record would end: a candidate edge from its offset to
its successor's. A magic inside a payload gives a candidate too. Within a split the edges are followed to the first
offset outside it; between splits pointer jumping from the start of the file doubles the distance each round, so a file
of n splits takes log2(n) rounds over few rows. Only candidates that the chain from offset 0 reaches are records.
Payloads that hold the magic are put together again from their pieces.

Defined cases: null html is an empty payload; null url gives no target header; control and non-ASCII bytes of a url are
percent-encoded in the header; rows that repeat a page are written each; a null page_id is written without an id, is
always a response and is read back as null; an empty table gives no archive and an empty result; a payload of any length
is written and read whole; a record counts only if a blank line pair stands behind its block, so a chain that breaks
(damaged file) ends at the last sound record, and broken_chains tells where; a payload that doesn't have the digest its
header tells is returned with digest_ok false; versions 1.0 and 1.1 are read, ids of other archives as record_id; other
columns of pages are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialise, unzipped, zipped

#: Fixed values of the format.
MAGIC = "WARC/1."
VERSION = "1\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    revisit_bytes: int = 1000
    date: str = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _in_header(url: Column) -> Column:
    """Bytes outside printable ASCII are percent-encoded."""
    each = F.split(url, "")
    return F.when(
        url.rlike(r"[^\x21-\x7E]"),
        F.array_join(F.transform(each, lambda c: F.when(c.rlike(r"^[\x21-\x7E]*$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), ""),
    ).otherwise(url)


def write_warc(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Writes archives below path; each file starts with a record."""
    body = F.coalesce(F.col("html"), F.lit(""))
    plain = pages.select("page_id", "url", body.alias("html"))
    keyed = plain.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html").cast("long")})
    copies = keyed.where(F.col("n") >= params.revisit_bytes).select("page_id", "digest")
    keeper = copies.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"))
    keeper = keeper.where("least < keeper").select("digest", "keeper")
    revisits = copies.join(keeper, "digest").where("page_id < keeper").distinct()
    revisits = revisits.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "keeper")
    # the html crosses the shuffle compressed
    keyed = zipped(keyed, "html")
    rows = keyed.join(revisits, (keyed["page_id"] == revisits["__id"]) & (keyed["digest"] == revisits["__digest"]), "left")
    rows = unzipped(rows.drop("__id", "__digest"), "html")
    again = F.col("keeper").isNotNull()
    name = lambda i: F.concat(F.lit("<urn:page:"), i.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + VERSION),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(params.date)),
        _line("WARC-Target-URI", _in_header(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", name(F.col("keeper"))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("X-Payload-Length", F.when(again, F.col("n").cast("string"))),
        F.lit("Content-Type: text/html; charset=UTF-8\r\n"),
        _line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    # the line separator of the text writer ends each record
    rows.select(record.alias("value")).write.option("lineSep", BLANK).text(path)


def segments(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """What lies between two magics, with its place in the file and what its header says, as a written table.

    Long content is kept only where a payload may have to be put together, or with keep_payload.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    raw = raw.withColumn("seq", F.monotonically_increasing_id())
    head = F.substring_index("value", BLANK, 1)
    field = lambda n, p=r"([^\r\n]*)": F.regexp_extract("head", rf"(?i)(?:^|\r\n){n}:[ \t]*{p}[ \t]*(?:\r\n|$)", 1)
    out = raw.withColumn("head", head).withColumn("size", F.octet_length("value").cast("long"))
    out = out.withColumn("head_size", F.octet_length("head").cast("long"))
    versioned = F.col("head").rlike(r"^[01]\r\n")
    length = F.when(versioned & (F.col("head_size") < F.col("size")), F.try_to_number(field("Content-Length", r"(\d{1,18})"), F.lit("9" * 18)).cast("long"))
    out = out.withColumn("length", length)
    body = F.col("size") - F.col("head_size") - F.lit(4)
    out = out.withColumn("closes", F.endswith("value", F.lit(BLANK)))
    out = out.withColumn("whole", F.coalesce((body == F.col("length") + 4) & F.col("closes"), F.lit(False)))
    payload = F.substring(F.col("value").cast("binary"), F.col("head_size").cast("int") + 5, F.col("length").cast("int"))
    out = out.withColumn("payload", F.when(F.col("whole"), payload))
    columns = [
        "file",
        "block",
        "seq",
        "size",
        "head_size",
        "length",
        "whole",
        "closes",
        field("WARC-Record-ID").alias("record_id"),
        F.lower(field("WARC-Type")).alias("record_type"),
        F.try_to_number(field("WARC-Record-ID", r"<urn:page:(-?\d{1,19})>"), F.lit("S" + "9" * 19)).cast("long").alias("page_id"),
        F.try_to_number(field("WARC-Refers-To", r"<urn:page:(-?\d{1,19})>"), F.lit("S" + "9" * 19)).cast("long").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), r"(?i)^sha1:([0-9a-f]{40})$", 1).alias("told_digest"),
        F.try_to_number(field("X-Payload-Length", r"(\d{1,18})"), F.lit("9" * 18)).cast("long").alias("told_length"),
        field("WARC-Target-URI").alias("url"),
        F.sha1(F.col("payload")).alias("payload_digest"),
        F.when(~F.col("whole"), F.col("value").cast("binary")).alias("piece"),
    ]
    if keep_payload:
        columns.append("payload")
    return materialise(out.select(*columns), "warc-segments")


def _placed(found: DataFrame) -> DataFrame:
    """Adds the offset of the magic before each segment and that of the record's successor."""
    step = F.col("size") + F.lit(len(MAGIC))
    sizes = found.groupBy("file", "block").agg(F.sum(step).alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    out = found.withColumn("__in", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(sizes, ["file", "block"])
    out = out.withColumn("at", F.col("base") + F.col("__in") - F.lit(len(MAGIC)))
    ends = F.col("at") + F.lit(len(MAGIC)) + F.col("head_size") + F.lit(4) + F.col("length") + F.lit(4)
    return out.withColumn("next", F.when(F.col("at") >= 0, ends)).drop("__in", "base")


def _exits(split: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of a split: the first offset of its chain that isn't a candidate of the split."""
    split = split.sort_values("at")
    exit_of: dict[int, int] = {}
    for at, after in zip(split["at"].tolist()[::-1], split["next"].tolist()[::-1]):
        exit_of[at] = exit_of.get(after, after)
    return pd.DataFrame({"file": split["file"], "at": split["at"], "exit": [exit_of[a] for a in split["at"]]})


def _walk(split: pd.DataFrame) -> pd.DataFrame:
    """The records of a split: what the chain reaches from its entries."""
    after = dict(zip(split["at"], split["next"]))
    todo, reached = split.loc[split["entry"], "at"].tolist(), []
    seen = set()
    for at in todo:
        while at in after and at not in seen:
            seen.add(at)
            reached.append(at)
            at = after[at]
    return pd.DataFrame({"file": split["file"].iloc[0], "at": reached})


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at): of the candidate edges (file, block, at, next) those whose start a chain from offset 0 reaches."""
    edges = candidates.select("file", "block", F.col("at").cast("long"), F.col("next").cast("long")).where("next is not null")
    exits = materialise(edges.groupBy("file", "block").applyInPandas(_exits, "file string, at long, exit long"), "warc-exits")
    splits = edges.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    starts = exits.where("at = 0").select("file", "at")
    reached = starts
    if splits > 1:
        nodes = exits.select("file", F.col("exit").alias("at")).distinct().unionByName(starts).distinct()
        jump = materialise(nodes.join(exits, ["file", "at"]).select("file", "at", F.col("exit").alias("to")), "warc-jump")
        for _ in range(max(1, int(splits).bit_length())):
            more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
            reached = materialise(reached.unionByName(more).distinct(), "warc-reached")
            onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
            jump = materialise(jump.join(onward, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "warc-jump")
    entries = edges.join(reached.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(False))
    )
    return entries.groupBy("file", "block").applyInPandas(_walk, "file string, at long")


def _texts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, at, piece) of the wanted segments, read again."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    raw = raw.withColumn("seq", F.monotonically_increasing_id()).withColumn("size", F.octet_length("value").cast("long"))
    blank = F.lit(None).cast("long")
    placed = _placed(raw.withColumn("head_size", blank).withColumn("length", blank))
    return placed.join(wanted, ["file", "at"], "left_semi").select("file", "at", F.col("value").cast("binary").alias("piece"))


def _joined(spark: SparkSession, path: str, placed: DataFrame, real: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, at, payload) of the records whose payload goes on behind a magic."""
    inside = placed.where("at >= 0").join(real, ["file", "at"], "left_anti")
    pieces = inside.where("not whole").select("file", "at", "piece")
    # a magic inside a payload may head something that looks like a whole record; its text wasn't kept
    whole = inside.where("whole").select("file", "at")
    if whole.limit(1).count():
        pieces = pieces.unionByName(_texts(spark, path, whole))
    starts = broken.select(
        "file", "at", "piece", F.struct(F.col("at").alias("start"), F.col("next").alias("end"), "head_size", "length").alias("of")
    )
    rows = starts.unionByName(pieces.withColumn("of", F.lit(None).cast(starts.schema["of"].dataType)))
    rows = rows.withColumn("first", F.col("of").isNotNull())
    rows = rows.withColumn("of", F.last("of", ignorenulls=True).over(W.partitionBy("file").orderBy("at")))
    rows = rows.where("of is not null and at < of.end")
    text = F.when(F.col("first"), F.expr("substring(piece, cast(of.head_size as int) + 5)")).otherwise(
        F.concat(F.lit(MAGIC.encode()), F.col("piece"))
    )
    got = rows.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("at", F.hex(text).alias("x")))).alias("parts"))
    body = F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), ""))
    got = got.withColumn("body", body).where("octet_length(body) >= of.length")
    return got.select("file", F.col("of.start").alias("at"), F.expr("substring(body, 1, cast(of.length as int))").alias("payload"))


def _chained(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates whose block ends in a blank line pair, and (file, at) of those that the chain reaches."""
    candidates = placed.where("next is not null")
    parted = candidates.where("not whole")
    if parted.limit(1).count():  # the pair has to end the segment before the successor
        step = F.col("at") + F.col("size") + F.lit(len(MAGIC))
        ends = placed.where("closes").select("file", step.alias("next")).distinct()
        candidates = candidates.where("whole").unionByName(parted.join(ends, ["file", "next"], "left_semi").select(*candidates.columns))
    return candidates, materialise(reachable(candidates.select("file", "block", "at", "next")), "warc-records")


def broken_chains(spark: SparkSession, path: str) -> DataFrame:
    """(file, sound_until, size) of the files below path whose chain of records ends before the file does."""
    placed = _placed(segments(spark, path))
    candidates, real = _chained(placed)
    sizes = placed.groupBy("file").agg(F.max(F.col("at") + F.col("size") + F.lit(len(MAGIC))).alias("size"))
    ends = candidates.join(real, ["file", "at"]).groupBy("file").agg(F.max("next").alias("sound_until"))
    out = sizes.join(ends, "file", "left").select("file", F.coalesce("sound_until", F.lit(0)).alias("sound_until"), "size")
    return out.where("sound_until < size and size > 0")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """page_id, record_id, url, record_type, payload_bytes, payload_digest, digest_ok, refers_to (and payload) of every
    record below path.

    Digest and length of a response are those of the payload as read, and digest_ok compares the digest with the
    header's; a revisit has none and tells them in its header.
    """
    placed = _placed(segments(spark, path, keep_payload))
    candidates, real = _chained(placed)
    records = candidates.join(real, ["file", "at"])
    whole = records.where("whole")
    broken = records.where("not whole")
    if broken.limit(1).count():
        joined = _joined(spark, path, placed, real, broken)
        joined = joined.withColumn("payload_digest", F.sha1("payload"))
        more = broken.drop("payload_digest", "payload").join(joined, ["file", "at"])
        whole = whole.unionByName(more if keep_payload else more.drop("payload"))
    again = F.col("record_type") == "revisit"
    return whole.select(
        "page_id",
        "record_id",
        F.when(F.col("url") != "", F.col("url")).alias("url"),
        "record_type",
        F.when(again, F.col("told_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(again, F.lower("told_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(~again & (F.col("told_digest") != ""), F.lower("told_digest") == F.col("payload_digest")).alias("digest_ok"),
        F.when(again, F.col("refers_to")).alias("refers_to"),
        *(["payload"] if keep_payload else []),
    )
