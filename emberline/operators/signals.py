"""Signals of participants over events: opponents, neighbours, abnormality, cards, valuation and running benefit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp01
from .aggregates import co_occurrence, first_per_group
from .temporal import islands


def _count() -> Column:
    return F.count(F.lit(1))


def asymmetric_pairs(actors: DataFrame, events: DataFrame, least_days: int = 3) -> DataFrame:
    """Per participant the opponent met on most distinct days, and that count over the active days of either side.

    Of equally frequent opponents the smallest id counts; participants without one of `least_days` are left out.
    """
    day = F.to_date("killed_at").alias("day")
    met = actors.select("event_id", "actor_id").join(events, "event_id").where("actor_id <> victim_id").select("actor_id", "victim_id", day).distinct()
    legs = met.select(F.explode(F.array(F.struct(F.col("actor_id").alias("me"), F.col("victim_id").alias("opp"), "day"), F.struct(F.col("victim_id").alias("me"), F.col("actor_id").alias("opp"), "day"))).alias("x")).select("x.*")
    pairs = legs.distinct().groupBy("me", "opp").agg(_count().alias("battles")).where(F.col("battles") >= least_days)
    top = first_per_group(pairs, ["me"], F.col("battles").desc(), F.col("opp"))
    attacked = actors.select("event_id", "actor_id").join(events, "event_id").select(F.col("actor_id").alias("me"), day)
    days = attacked.union(events.select("victim_id", day)).distinct().groupBy("me").agg(_count().alias("days"))
    out = top.join(days, "me").join(days.select(F.col("me").alias("opp"), F.col("days").alias("opp_days")), "opp")
    share = lambda d: F.round(F.col("battles") / F.col(d), 4)
    return out.select("me", "opp", "battles", share("days").alias("outbound"), share("opp_days").alias("inbound"))


def community_hostile_share(actors: DataFrame, affiliations: DataFrame, hostile: Column) -> DataFrame:
    """Per participant the number of distinct neighbours on shared events and the share of them that `hostile` holds for.

    Neighbours without an affiliation count as not hostile.
    """
    met = co_occurrence(actors.select("event_id", "actor_id").distinct(), "event_id", "actor_id").select("a", "b").distinct()
    ways = met.union(met.select("b", "a")).toDF("actor_id", "peer")
    sides = affiliations.select(F.col("actor_id").alias("peer"), hostile.alias("hostile"))
    share = F.avg(F.coalesce("hostile", F.lit(False)).cast("int"))
    return ways.join(sides, "peer", "left").groupBy("actor_id").agg(_count().alias("neighbors"), F.round(share, 4).alias("hostile_pct"))


def battle_only(gangs: DataFrame, events: DataFrame, small: int, cheap: float, least_events: int = 10) -> DataFrame:
    """The mean of three ramps: few solo events, few losses to small gangs, few cheap losses; null below `least_events`."""
    sizes = gangs.groupBy("event_id").agg(F.max("gang_size").alias("n"))
    seen = gangs.groupBy("actor_id").agg(_count().alias("events"), F.avg((F.col("gang_size") == 1).cast("int")).alias("solo"))
    lost = events.join(sizes, "event_id", "left").groupBy(F.col("victim_id").alias("actor_id")).agg(
        (F.count_if(F.col("n") <= small) / _count()).alias("small"), F.avg((F.col("total_value") < cheap).cast("int")).alias("cheap")
    )
    # fixed values: the ratio at which each habit counts as ordinary
    ramps = [clamp01(1 - F.coalesce(F.col(c), F.lit(0.0)) / F.lit(normal)) for c, normal in (("solo", 0.10), ("small", 0.30), ("cheap", 0.20))]
    score = F.when(F.col("events") >= least_events, (ramps[0] + ramps[1] + ramps[2]) / 3)
    return seen.join(lost, "actor_id", "left").select("actor_id", F.round(score, 6).alias("score"))


def system_rollup(events: DataFrame, theater: str, system: str) -> DataFrame:
    """Per theater and system: events, value, first and last; the primary system has most events, then most value."""
    parts = events.groupBy(theater, system).agg(_count().alias("kills"), F.sum("total_value").alias("isk"), F.min("killed_at").alias("first_at"), F.max("killed_at").alias("last_at"))
    best = parts.groupBy(theater).agg(F.max_by(system, F.struct("kills", "isk", -F.col(system))).alias("__best"))
    return parts.join(best, theater).withColumn("is_primary", F.col(system).eqNullSafe(F.col("__best"))).drop("__best")


def cards(actors: DataFrame, events: DataFrame, gangs: DataFrame) -> DataFrame:
    """Per participant: distinct kills and their value without fan-out, blows, damage, losses, biggest of each, efficiency in %."""
    rows = actors.groupBy("actor_id").agg(F.count_if("final_blow").alias("final_blows"), F.sum("damage").alias("damage"))
    won = gangs.select("event_id", "actor_id", "gang_size").join(events, "event_id").groupBy("actor_id").agg(
        _count().alias("kills"), F.sum("total_value").alias("isk_destroyed"), F.max("total_value").alias("biggest_kill"), F.max("gang_size").alias("largest_gang"), F.count_if(F.col("gang_size") == 1).alias("solo")
    )
    lost = events.groupBy(F.col("victim_id").alias("actor_id")).agg(_count().alias("deaths"), F.sum("total_value").alias("isk_lost"), F.max("total_value").alias("biggest_loss"))
    zero = {"final_blows": 0, "kills": 0, "deaths": 0, "solo": 0}
    out = won.join(rows, "actor_id").join(lost, "actor_id", "full_outer").fillna(zero)
    up, down = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("isk_destroyed", "isk_lost"))
    return out.withColumn("efficiency", F.round(100 * up / F.nullif(up + down, F.lit(0.0)), 4))


def valuation(items: DataFrame, keys: list[str], slot: Column, value: Column) -> DataFrame:
    """Sums of item values per key: fitted slots, cargo, drones and all of them."""
    places = {"fitted": ("high", "mid", "low", "rig", "subsystem", "service"), "cargo": ("cargo",), "drones": ("drone_bay", "fighter_bay")}
    rows = items.select(*keys, slot.alias("__slot"), value.alias("__value"))
    sums = [F.coalesce(F.sum(F.when(F.col("__slot").isin(*slots), F.col("__value"))), F.lit(0)).alias(name) for name, slots in places.items()]
    return rows.groupBy(*keys).agg(*sums, F.sum("__value").alias("items"))


def running_benefit(df: DataFrame, key: str, at: Column, seconds: Column, *ties: str) -> DataFrame:
    """When the benefit of each key ends, if every payment adds its seconds to the later of its own time and the end so far.

    That end is the sum of all seconds plus the greatest lead of a payment's time over the seconds paid before it.
    """
    rows = df.select(key, at.alias("__at"), seconds.alias("__s"), *ties).where("__at is not null and __s is not null")
    before = F.coalesce(F.sum("__s").over(W.partitionBy(key).orderBy("__at", *ties).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__lead", F.col("__at") - before).groupBy(key).agg((F.sum("__s") + F.max("__lead")).alias("until"))


def event_clusters(df: DataFrame, place: str, at: str, who: str, gap_seconds: int, least: int) -> DataFrame:
    """Clusters of events of a place whose successive gaps are at most `gap_seconds`, with `least` distinct participants or more."""
    runs = islands(df, [place], at, gap_seconds)
    out = runs.groupBy(place, "island").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), _count().alias("events"), F.countDistinct(who).alias("participants"))
    return out.where(F.col("participants") >= least)
