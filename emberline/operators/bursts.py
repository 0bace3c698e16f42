"""Burst detection with a window that restarts after each alarm, the same state machine in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BURSTS = "key string, fired_at long, n int, speakers int"


def fold(times: list[int], who: list[object], state: tuple, window: int, least: int, speakers: int, cooldown: int) -> tuple[list, tuple]:
    """Feeds rows in order; state is (recent rows, last alarm). Rows older than the window leave; an alarm empties it."""
    recent, last = list(state[0]), state[1]
    fired = []
    for t, a in zip(times, who):
        recent = [(s, b) for s, b in recent if t - s <= window] + [(t, a)]
        seen = len({b for _, b in recent if b is not None})
        if len(recent) >= least and seen >= speakers and (last is None or t - last >= cooldown):
            fired.append((t, len(recent), seen))
            recent, last = [], t
    return fired, (recent, last)


def bursts(df: DataFrame, key: str, at: str, who: str, window_seconds: int, least: int, speakers: int, cooldown_seconds: int) -> DataFrame:
    """(key, fired_at, n, speakers): alarms of at least `least` rows by `speakers` actors within the window, apart by the cooldown.

    Rows that can't be in a dense enough window are dropped in the JVM first, and a key is split where neither a window nor the
    cooldown can link two runs. A key that never pauses stays one group. Null keys form one key.
    """
    s = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.unix_timestamp(at).alias("t"), F.col(who).cast("string").alias("a"))
    by = W.partitionBy("key").orderBy("t")
    near = s.withColumn("__n", F.count(F.lit(1)).over(by.rangeBetween(-window_seconds, window_seconds)))
    gap = F.col("t") - F.lag("t").over(W.partitionBy("key").orderBy("t", "a"))
    dense = near.where(F.col("__n") >= least).withColumn("__new", F.coalesce((gap > max(window_seconds, cooldown_seconds)).cast("long"), F.lit(0)))
    runs = dense.withColumn("__run", F.sum("__new").over(W.partitionBy("key").orderBy("t", "a").rowsBetween(W.unboundedPreceding, 0)))

    def fire(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "a"])
        got, _ = fold(part["t"].tolist(), part["a"].tolist(), ([], None), window_seconds, least, speakers, cooldown_seconds)
        return pd.DataFrame([(part["key"].iloc[0], *g) for g in got], columns=["key", "fired_at", "n", "speakers"])

    return runs.select("key", "__run", "t", "a").groupBy("key", "__run").applyInPandas(fire, BURSTS)


def stream_bursts(df: DataFrame, key: str, at: str, who: str, window_seconds: int, least: int, speakers: int, cooldown_seconds: int) -> DataFrame:
    """The same over a stream: state per key is the rows of one window and the last alarm."""
    s = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.unix_timestamp(at).alias("t"), F.col(who).cast("string").alias("a"))

    def step(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "a"])
        times, actors, last = state.get if state.exists else ([], [], None)
        got, (recent, last) = fold(rows["t"].tolist(), rows["a"].tolist(), (list(zip(times, actors)), last), window_seconds, least, speakers, cooldown_seconds)
        state.update(([t for t, _ in recent], [a for _, a in recent], last))
        yield pd.DataFrame([(name[0], *g) for g in got], columns=["key", "fired_at", "n", "speakers"])

    return s.groupBy("key").applyInPandasWithState(step, BURSTS, "times array<long>, actors array<string>, last long", "append", "NoTimeout")
