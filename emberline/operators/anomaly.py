"""Combat anomalies: how an actor's battles of a window compare with those of peers, of a cohort and of its own past.

The peers of an actor in a battle are those of its side and hull category, itself among them; at most `peers` of them, by
id, so that a fight of hundreds weighs no more. All members of such a group share one set of peers, so a group gives one
row of statistics and no pair of actors is ever formed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["battle", "side", "category"]


@dataclass(frozen=True)
class AnomalyParams:
    """Fixed values, the defaults of the metrics."""

    window_days: int = 90
    baseline_days: int = 90
    min_battles: int = 5
    min_cohort: int = 30
    peers: int = 40
    least_peers: int = 3
    peers_dead: float = 0.5
    damage_z: float = 1.0
    survival: tuple[float, float] = (0.25, 0.75)
    feed: tuple[float, float] = (0.30, 0.65)
    deviating_fit: float = 0.5
    #: hulls whose survival and fit are structural
    special_hulls: tuple[int, ...] = (45534,)
    #: median and deviation assumed of a cohort's survival and feeding
    assumed: tuple[float, float] = (0.5, 0.25)
    high_cohort: int = 100
    high_battles: int = 20


def peer_stats(features: DataFrame, deaths: DataFrame, p: AnomalyParams) -> DataFrame:
    """(battle, side, category, peers, middle, spread, dead, last_peer) of every group; last_peer is the largest id taken."""
    place = F.row_number().over(W.partitionBy(*GROUP).orderBy("actor_id"))
    taken = features.select(*GROUP, "actor_id", "damage_share").withColumn("__place", place).where(F.col("__place") <= p.peers)
    fell = deaths.select("battle", "actor_id", F.lit(1).alias("__fell")).distinct()
    return taken.join(fell, ["battle", "actor_id"], "left").groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("peers"), F.median("damage_share").alias("middle"), F.stddev_samp("damage_share").alias("spread"),
        F.count("__fell").alias("dead"), F.max("actor_id").alias("last_peer"),
    )


def in_battle(features: DataFrame, deaths: DataFrame, exchange: DataFrame, p: AnomalyParams) -> DataFrame:
    """Per actor: battles, share_median, damage_z, survival_rate, qualifying, feed_rate and the categories flown.

    exchange: (battle, side, killed, lost), values that the side destroyed and lost.
    """
    fell = deaths.select("battle", "actor_id", F.lit(True).alias("__fell")).distinct()
    rows = features.join(peer_stats(features, deaths, p), GROUP).join(fell, ["battle", "actor_id"], "left")
    rows = rows.join(exchange.select("battle", "side", (F.col("killed") < F.col("lost")).alias("__lost")), ["battle", "side"], "left")
    rows = rows.withColumn("__fell", F.coalesce("__fell", F.lit(False)))
    told = (F.col("peers") >= p.least_peers) & ~F.coalesce(F.col("type_id").isin(*p.special_hulls), F.lit(False))
    z = F.when(told & (F.col("spread") > 0), (F.col("damage_share") - F.col("middle")) / F.col("spread"))
    weight = F.when(z.isNotNull(), F.least(F.lit(1.0), F.col("peers") / p.peers))
    others = F.col("peers") - 1
    others_dead = F.col("dead") - (F.col("__fell") & (F.col("actor_id") <= F.col("last_peer"))).cast("int")
    qualifies = told & (others >= p.least_peers) & (others_dead / others >= p.peers_dead)
    has_side = F.col("side") > 0
    return rows.groupBy("actor_id").agg(
        F.count(F.lit(1)).alias("battles"),
        F.median(F.when(told & (F.col("middle") > 0), F.col("damage_share") / F.col("middle"))).alias("share_median"),
        F.try_divide(F.sum(z * weight), F.sum(weight)).alias("damage_z"),
        F.count_if(qualifies).alias("qualifying"),
        F.when(F.count_if(qualifies) >= p.min_battles, F.count_if(qualifies & ~F.col("__fell")) / F.count_if(qualifies)).alias("survival_rate"),
        F.try_divide(F.count_if(has_side & F.coalesce("__lost", F.lit(False))), F.count_if(has_side)).alias("feed_rate"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )


def fit_deviation(items: DataFrame, doctrine: DataFrame, p: AnomalyParams) -> DataFrame:
    """(actor_id, fit_median, fit_ratio, fit_losses): modules of an actor's losses that aren't those of the hull's doctrine.

    items: (event_id, actor_id, hull, flag, type_id); doctrine: (hull, flag, type_id), one row a slot. Only losses of which
    the doctrine knows two slots count.
    """
    slots = doctrine.groupBy("hull").agg(F.countDistinct("flag").alias("__slots")).where("__slots >= 2")
    known = doctrine.join(slots, "hull").select("hull", "flag", F.col("type_id").alias("__type"))
    own = items.where(~F.col("hull").isin(*p.special_hulls)).join(known, ["hull", "flag"])
    losses = own.groupBy("event_id", "actor_id").agg(F.count(F.lit(1)).alias("__n"), F.count_if(~F.col("type_id").eqNullSafe(F.col("__type"))).alias("__off")).where("__n >= 2")
    return losses.groupBy("actor_id").agg(
        F.floor(F.median("__off")).alias("fit_median"), F.median(F.col("__off") / F.col("__n")).alias("fit_ratio"), F.count(F.lit(1)).alias("fit_losses")
    )


def cohorts(window: DataFrame, all_rows: DataFrame, members: DataFrame, sets: DataFrame, p: AnomalyParams) -> DataFrame:
    """(categories, cohort_size, cohort_middle, cohort_spread) of every set of categories that an actor flew.

    A cohort holds who flew any of them in the window on a side of `members`; its shares are means over all their rows in
    them. Shares are summed by actor and category first, so a row a set and actor is all that is regrouped.
    """
    flown = window.join(members.select("side").distinct(), "side").select("actor_id", "category").distinct()
    sums = all_rows.groupBy("actor_id", "category").agg(F.sum("damage_share").alias("s"), F.count("damage_share").alias("n"))
    each = sets.select("categories").distinct().select("categories", F.explode("categories").alias("category"))
    who = each.join(flown, "category").select("categories", "actor_id").distinct()
    mean = who.join(each, "categories").join(sums, ["actor_id", "category"]).groupBy("categories", "actor_id").agg((F.sum("s") / F.sum("n")).alias("share"))
    out = mean.groupBy("categories").agg(F.count(F.lit(1)).alias("cohort_size"), F.median("share").alias("m"), F.stddev_samp("share").alias("d"))
    enough = F.col("cohort_size") >= p.min_cohort
    return out.select("categories", "cohort_size", F.when(enough, F.col("m")).alias("cohort_middle"), F.when(enough, F.col("d")).alias("cohort_spread"))


def _z(value: Column, middle: Column, spread: Column) -> Column:
    return F.round((value - middle) / F.greatest(F.lit(0.01), spread), 3)


def _signal(low: Column, high: Column) -> Column:
    """1 where it reinforces, -1 where it weakens, else 0."""
    return F.when(F.coalesce(high, F.lit(False)), 1).when(F.coalesce(low, F.lit(False)), -1).otherwise(0)


def anomalies(
    features: DataFrame, deaths: DataFrame, exchange: DataFrame, items: DataFrame, doctrine: DataFrame, members: DataFrame, end: Column,
    p: AnomalyParams = AnomalyParams(),
) -> DataFrame:
    """A row per actor with a battle in the window of days up to `end` (a timestamp), with its band.

    features: (battle, side, category, actor_id, type_id, damage_share, started), one row an actor and battle; rows without
    a category take no part. items: those of losses, with killed_at. members: the sides of the viewer's bloc.
    """
    known = features.where("category is not null")
    start = end - F.expr(f"interval {p.window_days} days")
    before = start - F.expr(f"interval {p.baseline_days} days")
    window = known.where(F.col("started").between(start, end))
    lost = items.where(F.col("killed_at").between(start, end))
    own = in_battle(window, deaths, exchange, p)
    past = known.where(F.col("started").between(before, start)).groupBy("actor_id").agg(F.count(F.lit(1)).alias("__n"), F.median("damage_share").alias("baseline"))
    rows = (
        own.join(cohorts(window, known, members, own, p), "categories", "left")
        .join(past.where("__n >= 5").select("actor_id", "baseline"), "actor_id", "left")
        .join(fit_deviation(lost, doctrine, p), "actor_id", "left")
        .join(lost.groupBy("actor_id").agg(F.countDistinct("event_id").alias("as_victim")), "actor_id", "left")
        .fillna(0, ["cohort_size", "fit_losses", "as_victim"])
    )
    fed, lived, fit = F.col("feed_rate"), F.col("survival_rate"), F.when(F.col("fit_losses") >= 2, F.col("fit_ratio"))
    signals = F.array(
        _signal(F.col("damage_z") >= p.damage_z, F.col("damage_z") <= -p.damage_z),
        _signal(lived <= p.survival[0], lived >= p.survival[1]),
        _signal(fed <= p.feed[0], fed >= p.feed[1]),
        _signal(fit == 0, fit >= p.deviating_fit),
    )
    rows = rows.withColumns({"reinforcing": F.size(F.filter(signals, lambda s: s > 0)), "weakening": F.size(F.filter(signals, lambda s: s < 0))})
    enough = (F.col("cohort_size") >= p.min_cohort) & (F.col("battles") >= p.min_battles)
    more, less = F.col("reinforcing"), F.col("weakening")
    assumed = [F.when(F.col("cohort_middle").isNotNull(), F.lit(x)) for x in p.assumed]
    return rows.select(
        "actor_id", "battles", "as_victim",
        F.round("share_median", 3).alias("damage_share_median"),
        F.round("damage_z", 3).alias("damage_z_battle"),
        _z(F.col("share_median"), F.col("cohort_middle"), F.col("cohort_spread")).alias("damage_z_cohort"),
        F.when(F.col("baseline") > 0, F.round((F.col("share_median") - F.col("baseline")) / F.greatest(F.lit(0.01), F.col("baseline") * 0.30), 3)).alias("damage_z_self"),
        F.round(lived, 3).alias("survival_rate"), _z(lived, *assumed).alias("survival_z_cohort"), "qualifying",
        F.round(fed, 3).alias("feed_rate"), _z(fed, *assumed).alias("feeding_score"),
        "fit_median", "fit_losses", "cohort_size", F.col("baseline").isNotNull().alias("has_baseline"),
        F.when(~enough, "low").when((F.col("cohort_size") >= p.high_cohort) & (F.col("battles") >= p.high_battles), "high").otherwise("medium").alias("confidence"),
        "reinforcing", "weakening",
        F.when(~enough, "insufficient_data").when((more >= 2) & (more > less), "reinforces").when((less >= 2) & (less > more), "weakens").otherwise("neutral").alias("band"),
    )
