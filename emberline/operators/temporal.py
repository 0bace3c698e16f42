"""Order-dependent operators that stay declarative: islands, sessions, as-of and interval joins, spines, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seconds(at: Column) -> Column:
    return F.unix_timestamp(at)


def islands(df: DataFrame, keys: Sequence[str], at: str, gap_seconds: int, order: Sequence[str] = (), into: str = "island") -> DataFrame:
    """Numbers, per key from 0, the runs of rows no two successive of which are more than the gap apart.

    Null keys are one key.
    """
    w = W.partitionBy(*keys).orderBy(at, *order)
    step = seconds(F.col(at)) - seconds(F.lag(at).over(w))
    return df.withColumn("__new", (step > gap_seconds).cast("long")).withColumn(
        into, F.coalesce(F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    ).drop("__new")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: str, *aggs: Column) -> DataFrame:
    """Session windows: rows at most `gap` apart share one. Works on batch and streaming input alike."""
    grouped = df.groupBy(*keys, F.session_window(at, gap).alias("__s"))
    out = grouped.agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("n"), *aggs)
    return out.drop("__s")


def longest_gap(df: DataFrame, key: str, at: str, min_days: int) -> DataFrame:
    """Per key the longest gap in days between successive distinct times, and when it ended if it is long enough.

    Of equally long gaps the first counts.
    """
    w = W.partitionBy(key).orderBy(at)
    steps = df.select(key, at).distinct().withColumn("gap", F.datediff(F.col(at), F.lag(at).over(w)))
    best = steps.groupBy(key).agg(F.max_by(F.struct("gap", at), F.struct("gap", -seconds(F.col(at)))).alias("b"))
    return best.select(
        key,
        F.coalesce("b.gap", F.lit(0)).alias("max_gap_days"),
        F.when(F.col("b.gap") >= min_days, F.col(f"b.{at}")).alias("reactivated_at"),
    )


def collapse_equal(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Joins successive rows of equal value: (key, value, started_at, next_at), next_at null for the last run."""
    w = W.partitionBy(key).orderBy(at, value)
    fresh = df.withColumn("__was", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    runs = fresh.where(F.col("__first") | ~F.col("__was").eqNullSafe(F.col(value))).select(key, value, F.col(at).alias("started_at"))
    return runs.withColumn("next_at", F.lead("started_at").over(W.partitionBy(key).orderBy("started_at", value)))


def asof_backward(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, max_days: int, ties: Sequence[str] = ()) -> DataFrame:
    """The latest row of right on or before the day of each row of left, at most max_days back, else nulls.

    Right rows are dealt to their own and the next bucket of max_days + 1 days, so left rows find theirs in one bucket:
    both sides shuffle once on (key, bucket), no row of left fans out, and a busy key spreads over its buckets.
    Of right rows of one day the greatest by (right_at, ties) counts.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    bucket = lambda c: F.floor(day(c) / (max_days + 1))
    l = left.select(F.struct(*left.columns).alias("__l"), F.col(on).alias("__k"), bucket(left_at).alias("__b"), F.to_date(left_at).alias("__d"), F.lit(1).alias("__side"))
    kept = [c for c in right.columns if c != on]
    order = [right_at, *ties]
    r = right.select(
        F.col(on).alias("__k"),
        F.explode(F.array(bucket(right_at), bucket(right_at) + 1)).alias("__b"),
        F.to_date(right_at).alias("__d"),
        F.lit(0).alias("__side"),
        F.struct(*kept).alias("__r"),
        F.struct(*order).alias("__o"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy("__k", "__b").orderBy("__d", "__side", "__o").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    near = F.datediff("__d", F.to_date(f"__r.{right_at}")) <= max_days
    seen = seen.withColumn("__r", F.when(near, F.col("__r")))
    return seen.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in kept])


def next_within(starts: DataFrame, ends: DataFrame, key: str, start_at: str, end_at: str, limit_seconds: int) -> DataFrame:
    """For each start the first end from its time on, if within the limit: one pass over both in time order."""
    both = starts.select(F.col(key), F.col(start_at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("timestamp").alias("__e")).unionByName(
        ends.select(F.col(key), F.col(end_at).alias("__t"), F.lit(2).alias("__side"), F.col(end_at).alias("__e"))
    )
    # backwards in time, so that the frame grows at one end only
    ahead = W.partitionBy(key).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(W.unboundedPreceding, -1)
    out = both.withColumn("next_at", F.last("__e", ignorenulls=True).over(ahead)).where("__side = 1")
    wait = seconds(F.col("next_at")) - seconds(F.col("__t"))
    ok = wait <= limit_seconds
    return out.select(
        key, F.col("__t").alias(start_at), F.when(ok, F.col("next_at")).alias("next_at"), F.when(ok, wait).alias("wait_seconds")
    )


def interval_overlap(a: DataFrame, b: DataFrame, on: str, far: str = "9999-12-31") -> DataFrame:
    """Intersections of the intervals of a and b under one key; both have (started_at, ended_at), ended_at null if open.

    Intervals that touch count as overlapping.
    """
    open_end = F.lit(far).cast("timestamp")
    l = a.withColumnsRenamed({"started_at": "__as", "ended_at": "__ae"}).withColumn("__ae", F.coalesce("__ae", open_end))
    r = b.withColumnsRenamed({"started_at": "__bs", "ended_at": "__be"}).withColumn("__be", F.coalesce("__be", open_end))
    hit = l.join(r, on).where("__bs <= __ae and __be >= __as")
    end = F.least("__ae", "__be")
    return hit.withColumns(
        {"started_at": F.greatest("__as", "__bs"), "ended_at": F.when(end < open_end, end)}
    ).drop("__as", "__ae", "__bs", "__be")


def in_force_at(facts: DataFrame, history: DataFrame, on: str, at: str, fact_key: Sequence[str]) -> DataFrame:
    """The row of history (started_at, ended_at) in force at each fact's time; the latest start wins."""
    ok = (F.col("started_at") <= F.col(at)) & (F.col("ended_at").isNull() | (F.col(at) <= F.col("ended_at")))
    hit = facts.join(history, on).where(ok)
    best = W.partitionBy(*fact_key).orderBy(F.desc("started_at"))
    hit = hit.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")
    return facts.join(hit.select(*fact_key, *[c for c in history.columns if c != on]), list(fact_key), "left")


def greedy_cooldown(df: DataFrame, keys: Sequence[str], at: str, cooldown_seconds: int) -> DataFrame:
    """The times kept when each kept time hides those less than the cooldown after it. Times of one key fold in order."""
    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_set(seconds(F.col(at)))).alias("__t"))
    kept = F.aggregate(
        "__t",
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= cooldown_seconds), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return folded.select(*keys, F.explode(kept).alias("kept_second"))


def with_spine(counts: DataFrame, keys: Sequence[str], day: str, first: Column, last: Column, value: str) -> DataFrame:
    """Daily counts with a row, of zero if need be, for every key and day from first to last."""
    days = counts.select(*keys).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    return days.join(counts, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def snapshot_diff(df: DataFrame, key: str, day: str, value: str, before: str, after: str) -> DataFrame:
    """Keys whose value differs between two days."""
    at = lambda d, name: df.where(F.col(day) == F.lit(d).cast("date")).select(key, F.col(value).alias(name))
    both = at(before, "was").join(at(after, "now"), key, "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))
