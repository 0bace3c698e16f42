"""Archives and dimension lines, written from the stored tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Views
from ..sources import archives, dimensions, nested
from .registry import query

#: Events of one archive, at most.
PART = 10_000

KINDS = dimensions.specification("""id _key int
    name name
    category kind.category str
    size kind.size int
    base_price price float
    published bool
    kind json""")


def day_archives(v: Views) -> DataFrame:
    """An archive per day and about 9000 of its events, with a member per event: the event, its victim and attackers.

    A day's events are dealt by hash, so the archives are as many as the days until a day has more events than one holds.
    """
    attacker = F.struct(F.col("actor_id").alias("character_id"), F.col("damage").cast("long").alias("damage_done"), "final_blow")
    hits = v.actors.groupBy("event_id").agg(F.collect_list(attacker).alias("attackers"))
    stamp = F.date_format("killed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("killed_at")
    value = F.to_json(F.struct("event_id", stamp, F.struct(F.col("victim_id").alias("character_id")).alias("victim"), "attackers"))
    day = F.to_date("killed_at").alias("day")
    parts = v.events.groupBy(day.alias("__day")).agg(F.ceil(F.count(F.lit(1)) / (PART * 0.9)).alias("parts"))
    return archives.packed(
        v.events.join(hits, "event_id", "left").withColumn("day", day).join(F.broadcast(parts), F.col("day").eqNullSafe(F.col("__day"))).select(
            "day", F.pmod(F.xxhash64("event_id"), "parts").alias("part"),
            F.concat(F.col("event_id"), F.lit("/"), F.md5(F.col("event_id").cast("string")), F.lit(".json")).alias("member"), value.alias("value"),
        )
    )


@query("s1_day_archives", """h as (select event_id, count(*) as attackers, sum(damage::bigint)::bigint as damage from att group by event_id)
select event_id, killed_at::date as day, md5(event_id::varchar) as event_hash, victim_id, coalesce(attackers, 0) as attackers, damage from ev left join h using (event_id)""")
def archived(v: Views) -> DataFrame:
    rows = archives.members(day_archives(v)).where("fault is null")
    events = rows.select("day", "event_hash", F.from_json("value", nested.SCHEMA).alias("e"))
    damage = F.expr("aggregate(e.attackers, cast(null as bigint), (s, a) -> coalesce(s, 0L) + a.damage_done)")
    return events.select("e.event_id", "day", "event_hash", F.col("e.victim.character_id").alias("victim_id"), F.coalesce(F.size("e.attackers"), F.lit(0)).cast("long").alias("attackers"), damage.alias("damage"))


@query("s5_dimension_lines", """select type_id as id, left(type_name, 100) as name, category, size::bigint as size, base_price::double as base_price, size > 25 as published,
'{"category":"' || category || '","size":' || size || '}' as kind from typ""")
def dimension(v: Views) -> DataFrame:
    kind = F.struct("category", "size").alias("kind")
    name = F.struct(F.col("type_name").alias("en"), F.col("type_group").alias("de")).alias("name")
    published = F.when(F.col("size") > 25, F.lit(True)).alias("published")
    lines = v.types.select(F.to_json(F.struct(F.col("type_id").alias("_key"), name, kind, F.col("base_price").alias("price"), published)).alias("value"))
    return dimensions.rows_of(lines, KINDS).drop("data")
