"""Families of fits: near-alike module sets of a hull and role merged in order, to a fixpoint."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the least Jaccard similarity of two families that merge.
ALIKE = 0.65
#: Partitions of hulls and roles for each that a shuffle has.
PARTS = 4


class Live:
    """The families not yet taken in, as bits of their modules, with lists of the families to compare for each module.

    Two alike families share one of the rarest modules of each, as many as may be missing from the other and one more;
    only those are listed. A list keeps what a family grew out of until half of it is gone.
    """

    def __init__(self, sets: list[set], least: float):
        seen: dict = {}
        for s in sets:
            for m in s:
                seen[m] = seen.get(m, 0) + 1
        at = {m: i for i, m in enumerate(sorted(seen, key=seen.get))}
        self.least, self.alive = least, np.ones(len(sets), bool)
        self.modules = [sorted(at[m] for m in s) for s in sets]
        self.sizes = np.array([len(m) for m in self.modules], np.int64)
        self.bits = np.zeros((len(sets), max(1, -(-len(at) // 64))), np.uint64)
        listed: list[list[int]] = [[] for _ in at]
        for i, ms in enumerate(self.modules):
            for m in ms:
                self.bits[i, m >> 6] |= np.uint64(1 << (m & 63))
            for m in self.rarest(i):
                listed[m].append(i)
        self.lists = [np.array(x, np.int64) for x in listed]
        self.filled = [len(x) for x in listed]

    def rarest(self, i: int) -> list[int]:
        ms = self.modules[i]
        return ms[: len(ms) - min(len(ms), max(1, ceil(self.least * len(ms) - 1e-9))) + 1]

    def listed(self, m: int) -> np.ndarray:
        out = self.lists[m][: self.filled[m]]
        live = out[self.alive[out]]
        if 2 * len(live) < len(out):
            self.lists[m], self.filled[m] = live, len(live)
        return live

    def alike(self, i: int, after: int = -1) -> np.ndarray:
        """The live families behind `after` that are alike to i, i not among them; some may be named twice."""
        if not self.sizes[i]:
            out = np.flatnonzero(self.alive & (self.sizes == 0))
            return out[(out != i) & (out > after)]
        out = np.concatenate([self.listed(m) for m in self.rarest(i)])
        out = out[(out > after) & (out != i)]
        shared = np.bitwise_count(self.bits[out] & self.bits[i]).sum(1, dtype=np.int64)
        return out[shared / (self.sizes[i] + self.sizes[out] - shared) >= self.least]

    def take(self, big: int, small: int) -> None:
        self.alive[small] = False
        before = set(self.rarest(big))
        self.modules[big] = sorted({*self.modules[big], *self.modules[small]})
        self.bits[big] |= self.bits[small]
        self.sizes[big] = len(self.modules[big])
        for m in set(self.rarest(big)) - before:
            if self.filled[m] == len(self.lists[m]):
                self.lists[m] = np.concatenate([self.lists[m], np.empty(self.filled[m] + 8, np.int64)])
            self.lists[m][self.filled[m]] = big
            self.filled[m] += 1


def merge(sets: list[set], counts: list[int], least: float = ALIKE) -> list[int]:
    """The place of the family that each family ends in. The first pair in order that is alike merges, over and over.

    The family seen more often (the earlier one if tied) takes in the other's modules and counts. One pass goes up the
    order: families before the place it has reached are alike to none, so but for the family there only one that has
    just grown is compared again, with those before it first.
    """
    live, counts, into = Live(sets, least), list(counts), list(range(len(sets)))
    for at in range(len(sets)):
        grown, after = at, at
        while live.alive[at] or grown != at:
            found = live.alike(grown, after)
            if grown > at:  # those between wait for their turn
                found = found[found < at]
            if not len(found):
                if grown == at:
                    break
                grown, after = at, at
                continue
            other = int(found.min())
            a, b = min(grown, other), max(grown, other)
            big, small = (a, b) if counts[a] >= counts[b] else (b, a)
            live.take(big, small)
            counts[big] += counts[small]
            into[small] = big
            grown, after = big, -1
    for i in range(len(into)):
        end = i
        while into[end] != end:
            end = into[end]
        into[i] = end
    return into


def merged_families(families: DataFrame, least: float = ALIKE) -> DataFrame:
    """(hull, role, fingerprint, modules, fits, merged, first_at, last_at) from families of the same columns but merged.

    modules is an array of the distinct modules; families of a hull and role are in order of first_at, then fingerprint,
    and come counted already, a row each, so what a task holds is the distinct fingerprints of one hull and role.
    """
    keys = ["hull", "role"]
    names = [*keys, "fingerprint", "modules", "fits", "first_at", "last_at"]

    def one(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [("first_at", "ascending"), ("fingerprint", "ascending")]))
        ends = merge([set(m) for m in part["modules"].to_pylist()], part["fits"].to_pylist(), least)
        return part.append_column("family", part["fingerprint"].combine_chunks().take(pa.array(ends, pa.int64())))

    slim = families.select(*names)
    # The tasks of this step take time by what they compare, not by their bytes, so they are not joined by size.
    parts = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = slim.repartition(PARTS * parts, *keys).groupBy(*keys).applyInArrow(one, T.StructType([*slim.schema.fields, T.StructField("family", T.StringType())]))
    return ends.groupBy(*keys, F.col("family").alias("fingerprint")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("modules")))).alias("modules"), F.sum("fits").alias("fits"),
        F.count(F.lit(1)).alias("merged"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )
