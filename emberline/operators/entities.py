"""Names in messages: links first, then system codes, then the longest known names, no word used twice.

Messages are cut into words once. A word meets the table of names' first words by a join on its lower case; only where
one begins a name, the runs of as many words as such names have are made and meet the names. So nothing is looked up per
message and Catalyst chooses the joins by the tables' sizes. What is left per message is the list of its matches, over
which one pass marks used words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, words that are never names, and kinds of links by their type number.
SYSTEM = r"^[A-Z0-9]{1,4}(?:-[A-Z0-9]{1,4})+$|^J\d{6}$"
LINK = r"(?is)<url=showinfo:(\d+)//(\d+)>(.*?)</url>"
SCAN = r"(?i)https?://dscan\.info/[a-z0-9/]+"
BREAKS = r"[\s,;.:!?\\/`()\[\]{}<>\"'’“”]+"
STOPWORDS = (
    "omw warp gate station dock undock ic ico red blue go back to from out off in on at the and or fleet x xup wtb wts o7 o/ gf gg wp sup hi "
    "safe safely ok tysm ty thx plz please tnx danke reds blues neut neuts neutral sorry jb bridge jbg sd hold hic dic cyno jump tackled target "
    "primary secondary overheating fc xo co ceo dir director fcs linkboost links linksabh fits fit doc docked undocked need want have more less "
    "all any none no yes maybe wait waiting soon fast slow"
).split()
LINK_KINDS = {5: "system", 2: "corporation", 16159: "alliance", 3: "region"}
CHARACTERS = (1373, 1390)
LONGEST = 3
OUT = ["event_id", "token", "type", "id", "name", "method", "confidence", "token_offset"]


def words(message: Column) -> Column:
    """Patterns are looked for only in texts that hold the characters they can't do without."""
    rest = F.when(message.contains("<"), F.regexp_replace(message, LINK, " ")).otherwise(message)
    rest = F.when(message.contains("://"), F.regexp_replace(rest, SCAN, " ")).otherwise(rest)
    return F.array_remove(F.split(rest, BREAKS), "")


def links(messages: DataFrame, names: DataFrame, systems: DataFrame) -> DataFrame:
    """What a message's links name; systems, characters, corporations and alliances by their known name if there is one."""
    group = lambda n: F.regexp_extract_all("message", F.lit(LINK), F.lit(n))
    at = F.posexplode(F.arrays_zip(group(1).alias("kind"), group(2).alias("id"), group(3).alias("label"))).alias("token_offset", "l")
    rows = messages.where(F.col("message").contains("<")).select("event_id", at).select("event_id", "token_offset", F.col("l.kind").try_cast("long").alias("kind"), F.col("l.id").try_cast("long").alias("id"), "l.label")
    rows = rows.where("kind > 0 and id > 0")
    named = F.lit("unknown")
    for number, name in LINK_KINDS.items():
        named = F.when(F.col("kind") == number, name).otherwise(named)
    rows = rows.withColumn("type", F.when(F.col("kind").between(*CHARACTERS), "character").otherwise(named))
    known = systems.select("id", "name", F.lit("system").alias("family")).unionByName(names.select(F.col("entity_id").alias("id"), "name", F.lit("other").alias("family")))
    known = known.groupBy("id", "family").agg(F.min("name").alias("known"))
    family = F.when(F.col("type") == "system", "system").when(F.col("type").isin("character", "corporation", "alliance"), "other")
    told = rows.withColumn("family", family).join(known, ["id", "family"], "left")
    token = F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit("showinfo:"), "kind", F.lit("/"), "id"))
    return told.select("event_id", token.alias("token"), "type", "id", F.coalesce("known", "label").alias("name"), F.lit("showinfo_link").alias("method"), F.lit("high").alias("confidence"), "token_offset")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _unused(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """For each match in order, whether none of its words was used by one before it."""

    def marks(pairs: Iterator[tuple[int, int]]) -> list[bool]:
        used: set[int] = set()
        out = []
        for start, size in pairs:
            span = range(start, start + size)
            out.append(used.isdisjoint(span))
            if out[-1]:
                used.update(span)
        return out

    return pd.Series([marks(zip(a, b)) for a, b in zip(starts, sizes)])


def resolve(messages: DataFrame, names: DataFrame, systems: DataFrame) -> DataFrame:
    """(event_id, token, type, id, name, method, confidence, token_offset) of what messages (event_id, message) name.

    names: name, entity_id, category; of equal names in lower case the smallest entity counts. systems: name, id. Longer
    names go before shorter ones, and of equal length the first in the message; a single word must have three letters and
    not be a number. Links count by their place among the links, all else by their first word's place. Null messages and
    those without words name nothing; messages with the same event_id are one another's rows.
    """
    cut = messages.where("message is not null").select("event_id", F.monotonically_increasing_id().alias("row"), words(F.col("message")).alias("words"))
    ws = [f"w{n}" for n in range(LONGEST)]
    ahead = F.arrays_zip(*[F.slice("words", n + 1, F.size("words")).alias(w) for n, w in enumerate(ws)])
    each = cut.select("event_id", "row", F.posexplode(ahead).alias("start", "w")).select("event_id", "row", "start", "w.*")

    best = names.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("entity_id", "name", "category")).alias("e"))
    best = best.select("key", F.col("e.category").alias("type"), F.col("e.entity_id").alias("id"), F.col("e.name").alias("name"), F.lit("exact_name").alias("method"))
    codes = systems.where(F.col("name").rlike(SYSTEM)).groupBy("name").agg(F.min("id").alias("id"))
    codes = codes.select(F.lower("name").alias("key"), F.lit("system").alias("type"), "id", "name", F.lit("system_code").alias("method"))
    known = best.unionByName(codes)
    parts = F.split("key", " ")
    heads = known.where(F.size(parts) <= LONGEST).groupBy(parts[0].alias("head")).agg(F.collect_set(F.size(parts)).alias("sizes"))

    begun = each.join(heads, F.lower("w0") == F.col("head")).select("event_id", "row", "start", F.explode("sizes").alias("size"), F.array(*ws).alias("ws"))
    every = begun.where(F.get("ws", F.col("size") - 1).isNotNull()).select("event_id", "row", "start", "size", F.array_join(F.slice("ws", 1, F.col("size")), " ").alias("token"))
    few, coded = F.col("size") > 1, F.col("method") == "system_code"
    may = ~F.lower("token").isin(STOPWORDS) & (few | ((F.length("token") >= 3) & ~F.col("token").rlike("^[0-9]+$")))
    found = every.join(known, F.lower("token") == F.col("key")).where(F.when(coded, F.col("token") == F.col("name")).otherwise(may))
    found = found.withColumn("confidence", F.when(coded | few, "high").otherwise("medium"))
    order = F.struct((F.col("method") != "system_code").alias("late"), (-F.col("size")).alias("shorter"), "start", "size", "token", "type", "id", "name", "method", "confidence")
    lists = found.groupBy("event_id", "row").agg(F.sort_array(F.collect_list(order)).alias("m"))
    kept = lists.withColumn("kept", _unused(F.col("m.start"), F.col("m.size")))
    won = kept.select("event_id", F.explode(F.arrays_zip("m", "kept")).alias("z")).where("z.kept").select("event_id", "z.m.*")
    return links(messages, names, systems).select(*OUT).unionByName(won.withColumnRenamed("start", "token_offset").select(*OUT))
