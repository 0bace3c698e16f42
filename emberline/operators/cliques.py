"""Hostile circles: opponents of a target who keep appearing against it on the same days, grown greedily from the closest pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import co_occurrence
from .graph import cut, kept


@dataclass(frozen=True)
class CircleParams:
    #: opponents of a target that count, those met on most days; None: all
    top: int | None = 10
    #: days that any two members share at least, and members at most (inf: all that fit)
    least_days: int = 2
    most_members: float = 5


#: Pairs of a target that a task holds; a target with more is grown by joins.
LOCAL_PAIRS = 20_000


def grow(pairs: dict[tuple[int, int], int], p: CircleParams = CircleParams()) -> tuple[list[int], int, int] | None:
    """(members in order of joining, weight, least shared days) from days shared by pairs (a < b); None below three.

    The pair with most days starts; whoever shares enough days with all members and most days in sum joins next. The
    smaller pair or member goes first if tied.
    """
    if not pairs:
        return None
    seed = min(pairs, key=lambda k: (-pairs[k], k))
    members, weight = list(seed), pairs[seed]
    shared = lambda x, y: pairs.get((min(x, y), max(x, y)), 0)
    # days that others share with all members in sum, if enough with each
    fit = dict.fromkeys({x for pair in pairs for x in pair} - set(members), 0)
    joined = members
    while True:
        fit = {c: fit[c] + sum(days) for c in fit if min(days := [shared(c, m) for m in joined]) >= p.least_days}
        if not fit or len(members) >= p.most_members:
            break
        best = min(fit, key=lambda c: (-fit[c], c))
        weight += fit.pop(best)
        joined = [best]
        members = members + joined
    if len(members) < 3:
        return None
    return members, weight, min(shared(a, b) for i, a in enumerate(members) for b in members[:i])


_CIRCLE = "target long, members array<long>, size int, shared_days int, weight double"


def circles(met: DataFrame, p: CircleParams = CircleParams()) -> DataFrame:
    """(target, members, size, shared_days, weight) from meetings (target, opponent, day); targets without one are left out.

    Days are counted before anything meets; opponents of a target meet one another day by day. Targets are grown in batches,
    so one costs no call of its own; those with more than LOCAL_PAIRS pairs are grown by joins, all at once.
    """
    days = met.where("target <> opponent").select("target", "opponent", "day").distinct()
    if p.top is not None:
        counted = days.groupBy("target", "opponent").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(W.partitionBy("target").orderBy(F.desc("n"), "opponent"))
        days = days.join(counted.withColumn("place", place).where(F.col("place") <= p.top).select("target", "opponent"), ["target", "opponent"])
    pairs = co_occurrence(days, ["target", "day"], "opponent").groupBy("target", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = kept(pairs.where(F.col("n") >= p.least_days))
    large = cut(pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL_PAIRS).select("target"))
    some = not large.isEmpty()

    small = pairs.join(large, "target", "left_anti") if some else pairs
    found = small.groupBy("target").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("n").alias("n"))

    def grown(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for target, a, b, n in zip(part["target"], part["a"], part["b"], part["n"]):
                one = grow(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())), p)
                if one is not None:
                    rows.append((target, one[0], len(one[0]), one[2], float(one[1])))
            yield pd.DataFrame(rows, columns=["target", "members", "size", "shared_days", "weight"]).astype({"members": object})

    out = found.mapInPandas(grown, _CIRCLE)
    return out.unionByName(_by_joins(pairs.join(large, "target", "left_semi"), p)) if some else out


def _by_joins(pairs: DataFrame, p: CircleParams) -> DataFrame:
    """grow() of all targets at once, a member a step: who may still join has a row (target, c, days, least), the sum and the
    least of the days shared with the members so far; it stays while it shares days with each new member."""
    near = cut(pairs.select("target", F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))).alias("e")).select("target", "e.*"))
    seed = pairs.groupBy("target").agg(F.max(F.struct("n", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("s"))
    now = cut(seed.select("target", F.array(-F.col("s.a"), -F.col("s.b")).alias("members"), F.col("s.n").alias("shared"), F.col("s.n").alias("weight")))
    met = lambda of, who: near.join(of.select("target", who.alias("a")), ["target", "a"]).select("target", F.col("b").alias("c"), "n")
    both = met(now, F.col("members")[0]).unionByName(met(now, F.col("members")[1]))
    may = both.groupBy("target", "c").agg(F.sum("n").alias("days"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("k = 2").drop("k")
    done, size = [], 2
    while True:
        may = cut(may)
        best = may.groupBy("target").agg(F.max(F.struct("days", (-F.col("c")).alias("c"), "least")).alias("s"))
        step = now.join(best, "target", "left")
        done.append(step.where("s is null").drop("s"))
        grown = step.where("s is not null").select(
            "target", F.concat("members", F.array(-F.col("s.c"))).alias("members"), F.least("shared", "s.least").alias("shared"), (F.col("weight") + F.col("s.days")).alias("weight")
        )
        now, size = cut(grown), size + 1
        if size >= p.most_members or now.isEmpty():
            done.append(now)
            break
        new = met(now, F.element_at("members", -1)).withColumnRenamed("n", "more")
        may = may.join(new, ["target", "c"]).select("target", "c", (F.col("days") + F.col("more")).alias("days"), F.least("least", "more").alias("least"))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    out = out.where(F.size("members") >= 3)
    return out.select("target", "members", F.size("members").alias("size"), F.col("shared").cast("int").alias("shared_days"), F.col("weight").cast("double").alias("weight"))
