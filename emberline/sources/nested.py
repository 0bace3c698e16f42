"""Nested JSON events to relational rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """event_id long, killed_at string, system_id long, victim struct<character_id: long, ship_type_id: long, damage_taken: long,
items: array<struct<type_id: long, flag: int, quantity_dropped: long, quantity_destroyed: long>>>,
attackers array<struct<character_id: long, ship_type_id: long, damage_done: long, final_blow: boolean>>"""


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """The events of JSON texts; texts that aren't such an event are left out."""
    return raw.select(F.from_json(column, SCHEMA).alias("e")).where("e.event_id is not null").select("e.*")


def event_rows(events: DataFrame) -> DataFrame:
    """One row per event. Attackers without a character aren't players: is_npc without any, is_solo with exactly one."""
    attackers = F.coalesce("attackers", F.array().cast("array<struct<character_id: long, ship_type_id: long, damage_done: long, final_blow: boolean>>"))
    players = F.size(F.filter(attackers, lambda a: a["character_id"].isNotNull()))
    return events.select(
        "event_id", F.to_timestamp("killed_at").alias("killed_at"), "system_id", F.col("victim.character_id").alias("victim_id"),
        F.size(attackers).alias("attacker_count"), (players == 0).alias("is_npc"), (players == 1).alias("is_solo"),
    )


def attacker_rows(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.posexplode("attackers").alias("slot", "a")).select("event_id", "slot", "a.*")


def item_rows(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.posexplode("victim.items").alias("slot", "i")).select("event_id", "slot", "i.*")
