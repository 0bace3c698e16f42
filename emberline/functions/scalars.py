"""Scalar derivations shared by the operators. All are expressions; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slot categories of item flags, as (first flag, last flag, slot), in order of precedence.
SLOT_RANGES = (
    (27, 34, "high"),
    (19, 26, "mid"),
    (11, 18, "low"),
    (92, 99, "rig"),
    (125, 132, "subsystem"),
    (164, 171, "service"),
    (87, 87, "drone_bay"),
    (158, 158, "fighter_bay"),
    (89, 89, "implant"),
    (0, 0, "cargo"),
    (5, 5, "cargo"),
    (62, 62, "cargo"),
    (90, 90, "cargo"),
    (133, 156, "cargo"),
)


def slot_of_flag(flag: Column) -> Column:
    out = F.lit("other")
    for low, high, name in reversed(SLOT_RANGES):
        out = F.when(flag.between(low, high), F.lit(name)).otherwise(out)
    return out


def by_map(key: Column, names: Mapping[str, str], default: str) -> Column:
    """A lookup in a small fixed table; null and unknown keys give the default."""
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def ladder_rank(level: Column, ladder: Sequence[str]) -> Column:
    """Place of a level in an ordered enum, from 0; null for others."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(ladder):
        out = F.when(level == name, F.lit(i)).otherwise(out)
    return out


def ladder_name(rank: Column, ladder: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ladder]), (rank + 1).cast("int"))


def banded(value: Column, bands: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first band, from the top, whose floor the value reaches; null counts as below."""
    out = F.lit(below)
    for floor, name in sorted(bands):
        out = F.when(value >= floor, F.lit(name)).otherwise(out)
    return out


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def slug(name: Column, at: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), r"\.", "")
    return F.concat(plain, F.lit("-"), F.date_format(at, "yyyyMMddHHmm"))


def circular_hour(bins: Column) -> Column:
    """struct<x, y>: the mean direction of a 24-bin histogram; null unless there are 24 bins with a positive sum."""
    total = F.aggregate(bins, F.lit(0.0), lambda s, v: s + v)

    def axis(f) -> Column:
        weighted = F.transform(bins, lambda v, h: v * f(h * F.lit(2) * F.pi() / F.lit(24)))
        return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v) / total, 5)

    return F.when((F.size(bins) == 24) & (total > 0), F.struct(axis(F.cos).alias("x"), axis(F.sin).alias("y")))


def freshness(minutes: Column, ladder: Sequence[tuple[int, str]], last: str = "expired") -> Column:
    """The first state whose age limit, in minutes, isn't passed; null is the last state."""
    out = F.lit(last)
    for limit, name in sorted(ladder, reverse=True):
        out = F.when(minutes <= limit, F.lit(name)).otherwise(out)
    return out


def recency_decay(age_seconds: Column, half_life_seconds: float) -> Column:
    return F.pow(F.lit(0.5), age_seconds / F.lit(float(half_life_seconds)))


def fleet_dampening(participants: Column) -> Column:
    return F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), participants))


def theater_dampening(participants: Column, floor: float = 0.15) -> Column:
    return F.greatest(F.lit(floor), F.sqrt(F.lit(10.0)) / F.sqrt(F.greatest(F.lit(1), participants)))


def faction_taint(victim_faction: Column, faction_ratio: Column) -> Column:
    """0 without a faction, else 1 or one half by the share of faction attackers; and the weight left of it."""
    return F.when(victim_faction.isNull(), F.lit(0.0)).when(faction_ratio >= 0.5, F.lit(1.0)).otherwise(F.lit(0.5))


def untainted(weight: Column, taint: Column) -> Column:
    return weight * F.greatest(F.lit(0.1), F.lit(1.0) - taint)


def not_equal_or_null(column: Column, value) -> Column:
    """A "must not" filter: rows without a value pass."""
    return ~column.eqNullSafe(F.lit(value))


def not_in_or_null(column: Column, values: Sequence) -> Column:
    return column.isNull() | ~column.isin(*values)


def strict_share_below(value: Column, sorted_values: Column) -> Column:
    """Fraction of the values strictly below."""
    return F.size(F.filter(sorted_values, lambda v: v < value)) / F.size(sorted_values)


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """The value at index round(q (n - 1)), halves to even."""
    index = F.bround(F.lit(q) * (F.size(sorted_values) - 1).cast("double"), 0).cast("int")
    return F.get(sorted_values, index)


def floor_rank(sorted_values: Column, q: float) -> Column:
    """The value at index floor(q (n - 1))."""
    return F.get(sorted_values, F.floor(F.lit(q) * (F.size(sorted_values) - 1).cast("double")).cast("int"))
