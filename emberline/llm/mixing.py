"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a seeded order, form blocks of `block_rows`. A weight gives a source a whole number of
blocks per cycle. In a fluid schedule all sources advance through the cycle at that rate, and a source that runs out
leaves its share to the others; block k of a source may start when the fluid schedule begins it (its release, rounded
down) and must be done when the fluid schedule ends it (its deadline, rounded up). Earliest deadline first over these
windows places every block inside its window, so at any slot every source is less than one block from its target.

At the end of every cycle the fluid amounts are whole numbers, so cycles are scheduled independently and in parallel: a
cycle's group holds a row per source, whatever the table's size, and cycles alike in rates and numbers of blocks share
one schedule in a task. Documents are placed as keys only; a source that holds a third of all rows is numbered in buckets
and counted out in spans of cycles.

Weights are exact: a cycle is made long enough that each source gets a whole number of blocks in it. A weight must be
positive and is taken as the nearest fraction with a denominator up to `finest`.

Defined cases: null source is a source; sources without a weight get `default_weight`; rows that repeat a doc_id within
their source have a place each; null doc_id is one such id; an empty table gives an empty result; the last
block of a source may be short; columns named like the added ones are replaced, all others pass through.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import unzipped, zipped


@dataclass(frozen=True)
class MixParams:
    weights: Mapping[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    #: blocks per cycle of a source of weight 1, at least; as many as make every source's blocks a whole number
    blocks_per_weight: int = 8
    #: weights are fractions with denominators up to this, and a cycle may have so many blocks
    finest: int = 10_000
    cycle_blocks: int = 1_000_000
    block_rows: int = 16
    seed: int = 7
    #: keys in one bucket of a source, on average
    bucket_rows: int = 20_000


    def rates(self) -> tuple[dict[str, int], int]:
        """Blocks per cycle of each weighted source and of any other, in exact proportion to the weights."""
        told = {s: Fraction(str(w)).limit_denominator(self.finest) for s, w in [*self.weights.items(), (None, self.default_weight)]}
        if min(told.values()) <= 0:
            raise ValueError("weights must be positive; leave the rows of an unwanted source out of the input")
        scale = lcm(self.blocks_per_weight, *(w.denominator for w in told.values()))
        rates = {s: int(w * scale) for s, w in told.items()}
        if sum(rates.values()) > self.cycle_blocks:
            raise ValueError(f"the weights need cycles of more than {self.cycle_blocks} blocks; give them fewer digits")
        return {s: r for s, r in rates.items() if s is not None}, rates[None]


#: cycles of a source counted out by one row
SPAN = 1024

ADDED = ("cycle", "slot", "source_block", "release", "deadline", "offset")


@lru_cache(maxsize=4096)
def windows(rates: tuple[int, ...], counts: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """(release, deadline, source, k) of every block of a cycle; exact, as all amounts are fractions over a rate."""
    # at block k of a source of some rate, the sources with counts / rates up to k / rate are done, the others under way
    by_end = sorted(range(len(rates)), key=lambda s: Fraction(counts[s], rates[s]))
    ends = [Fraction(counts[s], rates[s]) for s in by_end]
    done = [0, *accumulate(counts[s] for s in by_end)]
    under_way = [*list(accumulate(rates[s] for s in reversed(by_end)))[::-1], 0]

    def fluid(k: int, rate: int) -> int:
        i = bisect_right(ends, Fraction(k, rate))
        return done[i] * rate + under_way[i] * k

    return [
        (fluid(k, a) // a, -(-fluid(k + 1, a) // a), s, k)
        for s, (a, c) in enumerate(zip(rates, counts))
        for k in range(c)
    ]


@lru_cache(maxsize=4096)
def earliest_deadline_first(rates: tuple[int, ...], counts: tuple[int, ...]) -> list[tuple[int, int, int, int, int]]:
    """(slot, release, deadline, source, k) of every block of a cycle; ties go to the smaller source, then k."""
    todo = sorted(windows(rates, counts))
    ready: list[tuple[int, int, int, int]] = []
    out, slot, i = [], 0, 0
    while i < len(todo) or ready:
        while i < len(todo) and todo[i][0] <= slot:
            release, deadline, s, k = todo[i]
            heapq.heappush(ready, (deadline, s, k, release))
            i += 1
        deadline, s, k, release = heapq.heappop(ready)  # the fluid schedule never idles, so some block is ready
        out.append((slot, release, deadline, s, k))
        slot += 1
    return out


def _schedule_cycle(sources: pd.DataFrame) -> pd.DataFrame:
    """A row per source of a cycle to a row per block."""
    per = sources.assign(null=sources["source"].isna()).sort_values(["null", "source"], ascending=[False, True], kind="stable")
    plan = earliest_deadline_first(tuple(per["rate"].tolist()), tuple(per["n"].tolist()))
    slot, release, deadline, s, k = (np.array(x) for x in zip(*plan))
    return pd.DataFrame(
        {
            "sid": per["sid"].to_numpy()[s],
            "cycle": per["cycle"].iloc[0],
            "source_block": per["cycle"].iloc[0] * per["rate"].to_numpy()[s] + k,
            "slot": slot,
            "release": release,
            "deadline": deadline,
        }
    )


def positions(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(source, doc_id, copy, cycle, slot, source_block, release, deadline, offset): the place of every row.

    Rows that repeat a key are its copies, numbered from 0. Rows ordered by (cycle, slot, offset) are the mix.
    """
    keys = docs.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    total = docs.count()
    buckets = max(16, total // params.bucket_rows)
    # sources are told apart by an id in which null is a value too
    sid = F.concat(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce("source", F.lit("")))
    keys = keys.withColumn("sid", sid).withColumn("h", F.xxhash64(F.lit(params.seed), "doc_id"))
    keys = keys.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    sizes = keys.groupBy("sid", "bucket").agg(F.sum("copies").alias("n"))
    before = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = W.partitionBy("sid", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = keys.withColumn("in_bucket", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(sizes.select("sid", "bucket", "base"), ["sid", "bucket"])
    placed = placed.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    index = F.col("base") + F.col("in_bucket") + F.col("copy")
    placed = placed.select(
        "sid",
        "source",
        "doc_id",
        "copy",
        F.expr(f"(base + in_bucket + copy) div {params.block_rows}").alias("source_block"),
        F.pmod(index, F.lit(params.block_rows)).alias("offset"),
    )
    rates, other = params.rates()
    rate = F.lit(other)
    for source, blocks in rates.items():
        rate = F.when(F.col("source") == source, F.lit(blocks)).otherwise(rate)
    per_source = keys.groupBy("sid").agg(F.max("source").alias("source"), F.sum("copies").alias("rows"))
    per_source = per_source.withColumn("rate", rate.cast("long")).withColumn(
        "blocks", F.expr(f"(rows + {params.block_rows - 1}) div {params.block_rows}")
    )
    # a source's cycles are counted out span by span, so that no row makes them all
    spans = per_source.withColumn("last", F.expr("(blocks - 1) div rate"))
    spans = spans.withColumn("span", F.explode(F.expr(f"sequence(0L, last div {SPAN})"))).repartition("sid", "span")
    cycle = F.explode(F.expr(f"sequence(span * {SPAN}, least(last, span * {SPAN} + {SPAN - 1}))"))
    cycles = spans.withColumn("cycle", cycle).withColumn("n", F.expr("least(rate, blocks - cycle * rate)"))
    schedule = (
        cycles.select("sid", "source", "rate", "cycle", "n")
        .groupBy("cycle")
        .applyInPandas(
            _schedule_cycle, "sid string, cycle long, source_block long, slot long, release long, deadline long"
        )
    )
    return placed.join(schedule, ["sid", "source_block"]).select("source", "doc_id", "copy", *ADDED)


def _keys(docs: DataFrame) -> list[Column]:
    """Source and doc_id with nulls as values, so that one partitioning serves both the copies and the join."""
    told = lambda c: F.coalesce(F.concat(F.lit("+"), docs[c].cast("string")), F.lit("-"))
    return [told("source").alias("__s"), told("doc_id").alias("__d")]


def mix(docs: DataFrame, params: MixParams = MixParams(), keep_zipped: bool = False) -> DataFrame:
    """The rows of docs in mixed order, with the columns of ADDED.

    With keep_zipped a text column comes back as it crossed the shuffles, zstd-compressed.
    """
    carried = docs.schema
    packed = "text" in docs.columns and carried["text"].dataType.typeName() == "string"
    place = positions(docs, params)
    docs = zipped(docs, "text") if packed else docs  # whole rows cross two shuffles
    place = place.select(*_keys(place), F.col("copy").alias("__copy"), *[F.col(c).alias(f"__{c}") for c in ADDED])
    copy = F.row_number().over(W.partitionBy("__s", "__d").orderBy("__h")) - F.lit(1)
    rows = docs.select("*", *_keys(docs), F.xxhash64(*docs.columns).alias("__h")).withColumn("__copy", copy.cast("long"))
    out = rows.join(place, ["__s", "__d", "__copy"])
    order = ["__cycle", "__slot", "__offset"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out = unzipped(out, "text") if packed and not keep_zipped else out
    return out.withColumns({c: F.col(f"__{c}") for c in ADDED}).drop("__s", "__d", "__h", "__copy", *[f"__{c}" for c in ADDED])
