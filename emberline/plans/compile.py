"""Compiles checked plans to DataFrames over search documents, type names and an edge list."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import not_equal_or_null, not_in_or_null
from ..operators.aggregates import top_n
from ..operators.graph import hops, shortest_path
from ..schema import Views
from .ir import Entity, Plan, PlanError, instant

#: (role, kind) -> column; dimensions of attackers are those of the final blow.
DIMENSIONS = {
    ("attacker", "type"): "fb_type_name",
    ("attacker", "type_group"): "fb_group",
    ("attacker", "actor"): "fb_actor_id",
    ("attacker", "alliance"): "fb_alliance_id",
    ("victim", "actor"): "victim_id",
    ("victim", "alliance"): "victim_alliance_id",
    ("victim", "segment"): "victim_segment",
}
#: Filters by id on attackers hold if any participant has it.
ARRAYS = {("attacker", "actor"): "attacker_ids", ("attacker", "alliance"): "attacker_alliance_ids"}
#: Hop limits of the graph intents.
PATH_HOPS, NEIGHBOR_HOPS = 50, 10


def search_documents(v: Views) -> DataFrame:
    """One wide row per event: victim, final blow and the distinct ids of all participants."""
    who = v.actors.join(v.affiliations, "actor_id", "left")
    parts = who.groupBy("event_id").agg(
        F.min(F.when(F.col("final_blow"), F.struct("actor_id", "type_id", "alliance_id"))).alias("fb"),
        F.sort_array(F.collect_set("actor_id")).alias("attacker_ids"),
        F.sort_array(F.collect_set("alliance_id")).alias("attacker_alliance_ids"),
    )
    named = v.types.select(F.col("type_id").alias("fb_type_id"), F.col("type_name").alias("fb_type_name"), F.col("type_group").alias("fb_group"))
    victim = v.victims.select("victim_id", F.col("alliance_id").alias("victim_alliance_id"), F.col("segment").alias("victim_segment"))
    out = v.events.join(parts, "event_id", "left").join(victim, "victim_id", "left")
    out = out.withColumns({f"fb_{c}": F.col(f"fb.{c}") for c in ("actor_id", "type_id", "alliance_id")}).drop("fb")
    return out.join(named, "fb_type_id", "left")


def column_of(e: Entity) -> str:
    if (e.role, e.kind) not in DIMENSIONS:
        raise PlanError(f"no column for {e.role}/{e.kind}")
    return DIMENSIONS[e.role, e.kind]


def condition(e: Entity) -> Column:
    values = list(e.value) if isinstance(e.value, (list, tuple)) else [e.value]
    if (e.role, e.kind) in ARRAYS:
        hit = F.arrays_overlap(ARRAYS[e.role, e.kind], F.array(*[F.lit(x).cast("long") for x in values]))
        return ~F.coalesce(hit, F.lit(False)) if e.operator == "ne" else hit
    c = F.col(column_of(e))
    if e.operator == "ne":
        return not_equal_or_null(c, values[0]) if len(values) == 1 else not_in_or_null(c, values)
    return c.isin(*values)


def _selected(docs: DataFrame, p: Plan, now: datetime) -> DataFrame:
    if p.since:
        docs = docs.where(F.col("killed_at") >= F.lit(instant(p.since, now)))
    if p.until != "now":
        docs = docs.where(F.col("killed_at") < F.lit(instant(p.until, now)))
    for f in p.filters:
        docs = docs.where(condition(f))
    return docs


def _measure(metric: str) -> Column:
    return {"count": F.count(F.lit(1)), "sum_isk": F.sum("total_value"), "avg_isk": F.round(F.avg(F.col("total_value").cast("double")), 4)}[metric]


def _top(v: Views, p: Plan, now: datetime) -> DataFrame:
    c = column_of(p.group_by)
    grouped = _selected(search_documents(v), p, now).where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(_measure(p.metric).alias("value"))
    return top_n(grouped, F.col("value"), p.limit, "key")


def _count(v: Views, p: Plan, now: datetime) -> DataFrame:
    docs = _selected(search_documents(v), p, now)
    if p.subject is not None and p.subject.value is not None:
        docs = docs.where(condition(p.subject))
    return docs.agg(F.count(F.lit(1)).alias("value"))


def _trend(v: Views, p: Plan, now: datetime) -> DataFrame:
    """Buckets of fixed width in order, with the empty ones between the first and the last."""
    docs = _selected(search_documents(v), p, now)
    found = docs.groupBy(F.window("killed_at", p.interval).start.alias("at")).agg(_measure(p.metric).alias("value"))
    span = found.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    every = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {p.interval}"))).alias("at"))
    return every.join(found, "at", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def _list(v: Views, p: Plan, now: datetime) -> DataFrame:
    docs = _selected(search_documents(v), p, now)
    return docs.orderBy(F.desc("killed_at"), F.desc("event_id")).limit(p.limit).select("event_id", "killed_at", "victim_id", "fb_type_name", "total_value")


def _lookup(v: Views, p: Plan, now: datetime) -> DataFrame:
    names = v.types.select(F.col("type_id").alias("id"), F.col("type_name").alias("name"), "category")
    hit = F.col("id") == p.subject.value if isinstance(p.subject.value, int) else F.lower("name") == str(p.subject.value).lower()
    return names.where(hit).orderBy("id").limit(p.limit)


def _path(v: Views, p: Plan, now: datetime) -> DataFrame:
    a, b = (f.value for f in p.filters)
    return shortest_path(v.links, a, b, PATH_HOPS)


def _neighbors(v: Views, p: Plan, now: datetime) -> DataFrame:
    return hops(v.links, [p.subject.value], min(p.limit, NEIGHBOR_HOPS)).where("hops > 0")


#: intent -> compiler; register further ones here.
COMPILERS: dict[str, Callable[[Views, Plan, datetime], DataFrame]] = {
    "top_n": _top,
    "count": _count,
    "trend": _trend,
    "list": _list,
    "lookup": _lookup,
    "path": _path,
    "neighbors": _neighbors,
}


def answer(v: Views, plan: Plan, now: datetime) -> DataFrame:
    p = plan.checked()
    if p.intent not in COMPILERS:
        raise PlanError(f"nothing answers {p.intent}")
    return COMPILERS[p.intent](v, p, now)


def sentence(plan: Plan, rows: DataFrame) -> DataFrame:
    """Top lists as lines of text, in their order."""
    return rows.select(F.concat_ws(" ", F.lit(f"{plan.metric}:"), F.col("key").cast("string"), F.lit("="), F.col("value").cast("string")).alias("line"))
