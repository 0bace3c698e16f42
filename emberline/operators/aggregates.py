"""Grouped operators: activity, shares, histograms, pair accumulation, rollups, percentiles and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_n(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """The n greatest; ties in ascending order of the given columns, so the cut is total."""
    return df.orderBy(by.desc(), *ties).limit(n)


def first_per_group(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def activity(participants: DataFrame, key: str) -> DataFrame:
    """Distinct events and days, mean gang size, solo events and last time per actor.

    participants: distinct (event_id, actor) with at and gang_size.
    """
    return participants.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(F.to_date("at")).alias("active_days"),
        F.round(F.avg("gang_size"), 6).alias("avg_gang"),
        F.sum((F.col("gang_size") == 1).cast("long")).alias("solo"),
        F.unix_timestamp(F.max("at")).alias("last_at"),
    )


def gangs(actors: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (event_id, actor_id) with the event's time and number of distinct actors."""
    pairs = actors.select("event_id", "actor_id").distinct()
    sizes = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("gang_size"))
    return pairs.join(sizes, "event_id").join(events.select("event_id", F.col("killed_at").alias("at")), "event_id")


def dominant(counts: DataFrame, keys: Sequence[str], label: str, n: str, least_share: float) -> DataFrame:
    """Each group's most frequent label (ties to the smaller), null below the least share."""
    total = counts.withColumn("__all", F.sum(n).over(W.partitionBy(*keys)))
    best = first_per_group(total, keys, F.desc(n), F.asc(label))
    share = F.col(n) / F.col("__all")
    return best.select(*keys, F.when(share >= least_share, F.col(label)).alias("dominant"), F.round(share, 6).alias("share"))


def hour_histogram(df: DataFrame, key: str, at: str) -> DataFrame:
    """24 bins per key, as shares of its rows."""
    bins = F.array(*[F.sum((F.hour(at) == h).cast("long")) for h in range(24)])
    out = df.groupBy(key).agg(bins.alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, v: s + v)
    return out.select(key, F.transform("n", lambda v: F.round(v / total, 6)).alias("bins"))


def co_occurrence(pairs: DataFrame, event: str | Sequence[str], actor: str) -> DataFrame:
    """Unordered actor pairs of each event, of one or more columns: (event..., a, b) with a < b. Actors given more than once count once.

    An event's actors come together once, as an array; pairs are made from it one after another.
    """
    by = [event] if isinstance(event, str) else list(event)
    met = pairs.dropna(subset=by).groupBy(*by).agg(F.sort_array(F.collect_set(actor)).alias("__all"))
    met = met.where(F.size("__all") > 1).select(*by, "__all", F.posexplode("__all").alias("__at", "a"))
    return met.select(*by, "a", F.explode(F.expr("slice(__all, __at + 2, size(__all))")).alias("b"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def strict_percentile(df: DataFrame, value: str, by: Sequence[str] = (), into: str = "pct") -> DataFrame:
    """Share of the group's rows strictly below each row's value.

    Counts per distinct value are summed in order, so a group of any size never needs its rows in one place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("__n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn(into, F.round(below / F.sum("__n").over(w), 6)).drop("__n")
    return df.join(placed, [*by, value], "left")


def daily_book(orders: DataFrame) -> DataFrame:
    """Daily rollup of order-book rows per day, location, type and side: best is the highest bid or the lowest offer."""
    notional, volume = F.sum(F.col("price") * F.col("remain")), F.sum("remain")
    vwap = F.coalesce(notional.cast("double") / F.nullif(volume, F.lit(0)).cast("double"), F.avg("price").cast("double"))
    return orders.groupBy(F.to_date("observed_at").alias("day"), "location_id", "type_id", "is_buy").agg(
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.round(F.avg("price").cast("double"), 4).alias("mean"),
        vwap.alias("vwap"),
        F.when(F.col("is_buy"), F.max("price")).otherwise(F.min("price")).alias("best"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("order_id").alias("orders"),
        volume.alias("volume"),
    )


def consumption_ohlc(orders: DataFrame) -> DataFrame:
    """Daily prices from what orders lost in volume: orders whose volume didn't fall are left out."""
    per_order = orders.groupBy(F.to_date("observed_at").alias("day"), "type_id", "order_id").agg(
        (F.max("remain") - F.min("remain")).alias("consumed"), F.avg("price").cast("double").alias("price")
    )
    sold = per_order.where("consumed > 0")
    return sold.groupBy("day", "type_id").agg(
        F.round(F.sum(F.col("price") * F.col("consumed")) / F.sum("consumed"), 4).alias("average"),
        F.round(F.max("price"), 4).alias("high"),
        F.round(F.min("price"), 4).alias("low"),
        F.sum("consumed").alias("volume"),
        F.count(F.lit(1)).alias("orders"),
    )


def conditional_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """How many rows of each group meet each condition; null meets none."""
    aggs = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name) for name, c in conditions.items()]
    return df.groupBy(*keys).agg(*aggs)


def share_of_group(value: str, by: Sequence[str]) -> Column:
    """A row's share of its group's total; 0 where the total is 0."""
    total = F.sum(value).over(W.partitionBy(*by))
    return F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0))


def over_group_max(value: str, by: Sequence[str]) -> Column:
    top = F.max(value).over(W.partitionBy(*by))
    return F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0))
