"""Battle reports, doctrines and reports of actors: functions over small keyed rows, all of them joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _count() -> Column:
    return F.count(F.lit(1))


def reclassified(sides: DataFrame, kills: DataFrame) -> DataFrame:
    """(battle, who, side) of third parties, those of side C, that can be told apart.

    sides: (battle, who, side) with sides A, B and C; kills: (battle, killer, victim). Who killed one side only joins the
    other; who killed both stays; who killed neither joins the enemies of the one side that killed it, stays if both did
    and is left out if none did.
    """
    of = lambda name: sides.select("battle", F.col("who").alias(name), "side")
    hit = lambda side: F.max((F.col("side") == side).cast("int"))
    killed = kills.join(of("victim"), ["battle", "victim"]).groupBy("battle", F.col("killer").alias("who")).agg(hit("A").alias("on_a"), hit("B").alias("on_b"))
    fell = kills.join(of("killer"), ["battle", "killer"]).groupBy("battle", F.col("victim").alias("who")).agg(hit("A").alias("by_a"), hit("B").alias("by_b"))
    rows = sides.where("side = 'C'").select("battle", "who").join(killed, ["battle", "who"], "left").join(fell, ["battle", "who"], "left")
    rows = rows.fillna(0, ["on_a", "on_b", "by_a", "by_b"])

    def other(a: str, b: str) -> Column:
        a, b = F.col(a) == 1, F.col(b) == 1
        return F.when(a & b, F.lit("C")).when(a, F.lit("B")).when(b, F.lit("A"))

    return rows.select("battle", "who", F.coalesce(other("on_a", "on_b"), other("by_a", "by_b")).alias("side")).where("side is not null")


def hydrated(rows: DataFrame, details: DataFrame, key: str, column: str, at: str) -> DataFrame:
    """rows with a missing (null or 0) column filled from the latest detail row that has it."""
    known = details.where((F.col(column).isNotNull()) & (F.col(column) != 0))
    latest = known.groupBy(key).agg(F.max_by(column, F.struct(at, column)).alias("__latest"))
    return rows.join(latest, key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0)), "__latest")).drop("__latest")


def with_structures(events: DataFrame) -> DataFrame:
    """(actor_id, deaths) of victims; an event without one, but of a known owner, has a structure, with the negative id of the event."""
    who = F.coalesce("victim_id", F.when(F.col("owner_id").isNotNull(), -F.col("event_id")))
    return events.withColumn("actor_id", who).where("actor_id is not null").groupBy("actor_id").agg(_count().alias("deaths"))


def conditional_lift(sides: DataFrame, weights: DataFrame | None = None, least: float = 5.0, least_delta: float = 0.1) -> DataFrame:
    """How much more often two parties stand on one side when a third is there: (a, b, trigger, n, with_it, without, delta).

    sides: distinct (event_id, side, who), bounded per event by the caller; weights: (event_id, w). The rate without the
    trigger comes from the pair's totals, so nothing is joined to what is absent.
    """
    x, y = sides.toDF("event_id", "sx", "a"), sides.toDF("event_id", "sy", "b")
    met = x.join(y, "event_id").where("a < b").groupBy("event_id", "a", "b").agg(F.max((F.col("sx") == F.col("sy")).cast("double")).alias("same"))
    met = met.join(weights, "event_id") if weights is not None else met.withColumn("w", F.lit(1.0))
    met = met.withColumn("ws", F.col("w") * F.col("same"))
    total = met.groupBy("a", "b").agg(F.sum("w").alias("all"), F.sum("ws").alias("all_same"))
    there = sides.select("event_id", F.col("who").alias("trigger")).distinct()
    told = met.join(there, "event_id").where("trigger <> a and trigger <> b")
    told = told.groupBy("a", "b", "trigger").agg(F.sum("w").alias("n"), F.sum("ws").alias("n_same")).join(total, ["a", "b"])
    rest = F.col("all") - F.col("n")
    told = told.where((F.col("n") >= least) & (rest >= least))
    told = told.withColumns({"with_it": F.col("n_same") / F.col("n"), "without": (F.col("all_same") - F.col("n_same")) / rest})
    told = told.withColumn("delta", F.col("with_it") - F.col("without")).where(F.abs("delta") >= least_delta)
    return told.select("a", "b", "trigger", "n", "with_it", "without", "delta")


def doctrine_fold(fits: DataFrame) -> DataFrame:
    """Fits (event_id, actor_id, alliance_id, hull, role, at, module; a row a module) by hull, role and digest of their sorted modules."""
    whole = fits.groupBy("event_id", "actor_id", "hull", "role").agg(
        F.sort_array(F.collect_list("module")).alias("modules"), F.max("alliance_id").alias("alliance_id"), F.min("at").alias("at")
    )
    digest = F.md5(F.array_join(F.transform("modules", lambda m: m.cast("string")), ","))
    return whole.withColumn("fingerprint", digest).groupBy("hull", "role", "fingerprint").agg(
        F.max(F.size("modules")).cast("long").alias("modules"), _count().alias("fits"), F.countDistinct("alliance_id").alias("alliances"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def doctrine_changes(shares: DataFrame, present: float = 0.10, sudden: float = 0.20) -> DataFrame:
    """(who, class, change, delta) of shares (who, class, prior, current): adopted, abandoned or moved at once; a row may give two."""
    delta = F.col("current") - F.col("prior")
    kinds = F.array_compact(
        F.array(
            F.when((F.col("prior") < present) & (F.col("current") >= present), F.lit("adoption")),
            F.when((F.col("prior") >= present) & (F.col("current") < present), F.lit("abandonment")),
            F.when(delta >= sudden, F.lit("sudden_rise")).when(delta <= -sudden, F.lit("sudden_fall")),
        )
    )
    return shares.select("who", "class", F.explode(kinds).alias("change"), delta.alias("delta"))


def joined_together(joins: DataFrame, days: int = 7, top: int = 20) -> DataFrame:
    """(actor_id, other, gap): others who joined the same group within so many days, the nearest of each actor, the smaller
    if as near.

    joins: (actor_id, grp, day), day a whole number. Of a group's day only the first top + 1 actors can be among anyone's
    nearest, and those near a day are the same for all of its actors, so they are found once a day.
    """
    rank = F.row_number().over(W.partitionBy("grp", "day").orderBy("actor_id"))
    first = joins.where("grp is not null and day is not null and actor_id is not null").select("grp", "day", "actor_id").distinct().withColumn("rn", rank).where(F.col("rn") <= top + 1)
    lists = first.groupBy("grp", F.col("day").alias("on")).agg(F.collect_list("actor_id").alias("who"))
    beside = lists.select("grp", "who", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("step"), "on")
    beside = beside.groupBy("grp", (F.col("on") + F.col("step")).alias("day")).agg(F.collect_list(F.struct(F.abs("step").alias("gap"), "who")).alias("beside"))
    wanted = joins.select("grp", "day").distinct()

    def wider(near, gap):
        who = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("beside", lambda x: x["gap"] == gap), lambda x: x["who"]))))
        fresh = F.filter(who, lambda o: ~F.exists(near, lambda y: y["other"] == o))
        return F.when(F.size(near) > top, near).otherwise(F.concat(near, F.transform(fresh, lambda o: F.struct(gap.cast("long").alias("gap"), o.alias("other")))))

    none = F.array().cast(f"array<struct<gap:bigint,other:{joins.schema['actor_id'].dataType.simpleString()}>>")
    near = beside.join(wanted, ["grp", "day"]).select("grp", "day", F.slice(F.aggregate(F.sequence(F.lit(0), F.lit(days)), none, wider), 1, top + 1).alias("near"))
    met = joins.where("actor_id is not null").join(near, ["grp", "day"]).groupBy("actor_id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"), _count().alias("n"))
    others = F.filter("near", lambda x: x["other"] != F.col("actor_id"))
    once = F.filter(others, lambda x, i: ~F.exists(F.slice(others, 1, i), lambda y: y["other"] == x["other"]))  # of several groups
    found = met.select("actor_id", F.explode(F.slice(F.when(F.col("n") == 1, others).otherwise(once), 1, top)).alias("x"))
    return found.select("actor_id", "x.other", "x.gap")


def reporter_reliability(reports: DataFrame) -> DataFrame:
    """Reports (actor_id, at, confirmed) by actor: how many were confirmed, how late on average, and how far that can be trusted."""
    n = F.col("reports")
    band = F.when(n >= 30, "high").when(n >= 10, "medium").when(n >= 3, "low").otherwise("insufficient")
    late = F.avg(F.unix_timestamp("confirmed") - F.unix_timestamp("at"))
    out = reports.groupBy("actor_id").agg(_count().alias("reports"), F.count("confirmed").alias("confirmations"), F.round(late, 4).alias("latency"))
    return out.withColumns({"reliability": F.round(F.col("confirmations") / n, 6), "confidence": band})


def first_resolution(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """events with place, where it is missing that of their first resolution (event_id, id, resolved)."""
    first = resolutions.groupBy("event_id").agg(F.min_by("resolved", "id").alias("resolved"))
    return events.join(first, "event_id", "left").withColumn("place", F.coalesce("place", "resolved")).drop("resolved")


def section_confidence(n: Column, evidence: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * F.least(F.lit(1.0), n / 5) + 0.6 * evidence)


def evidence_breadth(battles: Column, scans: Column, clusters: Column, events: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), (3 * battles + 2 * scans + clusters + events) / 12))
