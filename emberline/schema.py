"""Canonical views: the event, actor, market and log tables that the operators work on, over the stored tables.

Zone-less timestamps are read as UTC instants once, here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.aggregates import co_occurrence


def utc(column: str):
    return F.col(column).cast("timestamp")


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """One row per event, its victim inlined."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_custkey").alias("victim_id"),
            utc("o_orderdate").alias("killed_at"),
            F.col("o_totalprice").cast("decimal(20,2)").alias("total_value"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("band"),
        )

    @cached_property
    def actors(self) -> DataFrame:
        """Participants of events; (event_id, actor_id) may repeat."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("event_id"),
            F.col("l_suppkey").alias("actor_id"),
            F.col("l_partkey").alias("type_id"),
            F.col("l_quantity").cast("decimal(20,2)").alias("damage"),
            F.col("l_extendedprice").cast("decimal(20,2)").alias("isk"),
            (F.col("l_linenumber") == 1).alias("final_blow"),
            utc("l_shipdate").alias("seen_at"),
            F.col("l_linenumber").alias("slot"),
        )

    @cached_property
    def affiliations(self) -> DataFrame:
        """Actor to alliance and bloc."""
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("actor_id"), F.col("s_nationkey").alias("alliance_id"), F.col("n_regionkey").alias("bloc_id")
        )

    @cached_property
    def victims(self) -> DataFrame:
        """Victim to alliance and bloc."""
        return self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("victim_id"),
            F.col("c_nationkey").alias("alliance_id"),
            F.col("n_regionkey").alias("bloc_id"),
            F.col("c_mktsegment").alias("segment"),
        )

    @cached_property
    def types(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("type_id"),
            F.col("p_name").alias("type_name"),
            F.col("p_brand").alias("type_group"),
            F.col("p_type").alias("category"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").cast("decimal(20,2)").alias("base_price"),
        )

    @cached_property
    def market(self) -> DataFrame:
        """Order-book snapshot rows."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("type_id"),
            F.col("l_suppkey").alias("location_id"),
            (F.col("l_returnflag") == "R").alias("is_buy"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("decimal(20,2)") / 100).cast("decimal(20,2)").alias("price"),
            F.col("l_quantity").cast("long").alias("remain"),
            utc("l_shipdate").alias("observed_at"),
        )

    @cached_property
    def log(self) -> DataFrame:
        """Typed log events; system is the k of the JSON properties."""
        kinds = {"purchase": "combat", "view": "fleet_message", "click": "intel_report", "signup": "notify", "error": "unknown"}
        kind = F.lit(None).cast("string")
        for stored, name in kinds.items():
            kind = F.when(F.col("event_type") == stored, F.lit(name)).otherwise(kind)
        return self.table("events").select(
            "event_id",
            utc("ts").alias("at"),
            F.col("user_id").alias("actor_id"),
            kind.alias("kind"),
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("system_id"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """Undirected edges (a, b, w), a < b: actors and how many events they share; pairs with fewer than two are left out."""
        both = co_occurrence(self.actors.select("event_id", "actor_id"), "event_id", "actor_id")
        return both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")).where("w >= 2")


#: The same views for the SQL twins.
SQL_VIEWS = """
ev as (select o_orderkey as event_id, o_custkey as victim_id, o_orderdate as killed_at, o_totalprice::decimal(20,2) as total_value,
  o_orderstatus as status, o_orderpriority as band from orders),
att as (select l_orderkey as event_id, l_suppkey as actor_id, l_partkey as type_id, l_quantity::decimal(20,2) as damage,
  l_extendedprice::decimal(20,2) as isk, l_linenumber = 1 as final_blow, l_shipdate as seen_at, l_linenumber as slot from lineitem),
aff as (select s_suppkey as actor_id, s_nationkey as alliance_id, n_regionkey as bloc_id from supplier join nation on s_nationkey = n_nationkey),
vic as (select c_custkey as victim_id, c_nationkey as alliance_id, n_regionkey as bloc_id, c_mktsegment as segment
  from customer join nation on c_nationkey = n_nationkey),
typ as (select p_partkey as type_id, p_name as type_name, p_brand as type_group, p_type as category, p_size as size,
  p_retailprice::decimal(20,2) as base_price from part),
mkt as (select l_orderkey as order_id, l_partkey as type_id, l_suppkey as location_id, l_returnflag = 'R' as is_buy,
  (floor(l_extendedprice / l_quantity * 100 + 0.5)::decimal(20,2) / 100)::decimal(20,2) as price, l_quantity::bigint as remain, l_shipdate as observed_at from lineitem),
lg as (select event_id, ts as seen, user_id as actor_id, case event_type when 'purchase' then 'combat' when 'view' then 'fleet_message'
  when 'click' then 'intel_report' when 'signup' then 'notify' when 'error' then 'unknown' end as kind, value,
  (props->>'$.k')::bigint as system_id from events),
gang as (select event_id, actor_id, killed_at as seen, count(*) over (partition by event_id) as gang_size
  from (select distinct event_id, actor_id from att) join ev using (event_id)),
links as (select x.actor_id as a, y.actor_id as b, count(*)::double as w from gang x join gang y using (event_id)
  where x.actor_id < y.actor_id group by all having count(*) >= 2)"""


def sql(body: str) -> str:
    """A SQL twin: `body` may start with further common table expressions, as in "x as (...) select ..."."""
    body = body.strip()
    return f"with recursive {SQL_VIEWS}{' ' if body.lower().startswith('select') else ', '}{body}"
