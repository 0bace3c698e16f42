"""Participants' signals, cards and roll-ups over the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slot_of_flag
from ..operators import aggregates as A
from ..operators import signals as G
from ..schema import Views
from .registry import query


def epochs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_timestamp(c) for c in columns})


@query("m6_asymmetric_pair", """legs as (select actor_id as me, victim_id as opp, killed_at::date as day from att join ev using (event_id) where actor_id <> victim_id
  union select victim_id, actor_id, killed_at::date from att join ev using (event_id) where actor_id <> victim_id),
pr as (select me, opp, count(distinct day) as battles from legs group by all having count(distinct day) >= 3),
mine as (select actor_id as me, killed_at::date as day from att join ev using (event_id) union select victim_id, killed_at::date from ev),
dd as (select me, count(distinct day) as days from mine group by all),
tops as (select *, row_number() over (partition by me order by battles desc, opp) as rn from pr)
select t.me, t.opp, t.battles, round(t.battles / a.days, 4) as outbound, round(t.battles / b.days, 4) as inbound
from tops t join dd a on a.me = t.me join dd b on b.me = t.opp where rn = 1""")
def asymmetric(v: Views) -> DataFrame:
    return G.asymmetric_pairs(v.actors, v.events)


@query("m7_community_hostile", """select x.actor_id, count(distinct y.actor_id) as neighbors,
round(count(distinct y.actor_id) filter (where bloc_id = 1) / count(distinct y.actor_id), 4) as hostile_pct
from gang x join gang y using (event_id) left join aff on aff.actor_id = y.actor_id where x.actor_id <> y.actor_id group by all""")
def community(v: Views) -> DataFrame:
    return G.community_hostile_share(v.actors, v.affiliations, F.col("bloc_id") == 1)


@query("m8_battle_only", """f as (select actor_id, count(*) as n, avg((gang_size = 1)::int) as solo from gang group by all),
gs as (select event_id, max(gang_size) as n from gang group by all),
l as (select victim_id as actor_id, count(*) filter (where n <= 2) / count(*) as small, avg((total_value < 50000)::int) as cheap
  from ev left join gs using (event_id) group by all)
select actor_id, case when n >= 10 then round((greatest(0, 1 - solo / 0.1::double) + greatest(0, 1 - coalesce(small, 0) / 0.3::double)
  + greatest(0, 1 - coalesce(cheap, 0) / 0.2::double)) / 3, 6) end as score from f left join l using (actor_id)""")
def battle_only(v: Views) -> DataFrame:
    return G.battle_only(A.gangs(v.actors, v.events), v.events, small=2, cheap=50000)


@query("a17_system_rollup", """s as (select segment, alliance_id, count(*) as kills, sum(total_value) as isk, epoch(min(killed_at))::bigint as first_at,
  epoch(max(killed_at))::bigint as last_at from ev join vic using (victim_id) group by all)
select *, row_number() over (partition by segment order by kills desc, isk desc, alliance_id) = 1 as is_primary from s""")
def systems(v: Views) -> DataFrame:
    return epochs(G.system_rollup(v.events.join(v.victims, "victim_id"), "segment", "alliance_id"), "first_at", "last_at")


@query("a17_a33_cards", """r as (select actor_id, count(*) filter (where final_blow) as final_blows, sum(damage) as damage from att group by all),
w as (select actor_id, count(*) as kills, sum(total_value) as isk_destroyed, max(total_value) as biggest_kill, max(gang_size) as largest_gang,
  count(*) filter (where gang_size = 1) as solo from gang join ev using (event_id) group by all),
l as (select victim_id as actor_id, count(*) as deaths, sum(total_value) as isk_lost, max(total_value) as biggest_loss from ev group by all)
select actor_id, coalesce(kills, 0) as kills, isk_destroyed, biggest_kill, largest_gang, coalesce(solo, 0) as solo, coalesce(final_blows, 0) as final_blows,
  damage, coalesce(deaths, 0) as deaths, isk_lost, biggest_loss,
  round(100 * coalesce(isk_destroyed::double, 0) / (coalesce(isk_destroyed::double, 0) + coalesce(isk_lost::double, 0)), 4) as efficiency
from (w join r using (actor_id)) full join l using (actor_id)""")
def cards(v: Views) -> DataFrame:
    return G.cards(v.actors, v.events, A.gangs(v.actors, v.events))


@query("a38_valuation", """i as (select event_id, type_id % 180 as f, case when damage = 2 then 0 else isk end as x from att)
select event_id, coalesce(sum(x) filter (where f between 11 and 34 or f between 92 and 99 or f between 125 and 132 or f between 164 and 171), 0) as fitted,
coalesce(sum(x) filter (where f in (0, 5, 62, 90) or f between 133 and 156), 0) as cargo, coalesce(sum(x) filter (where f in (87, 158)), 0) as drones,
sum(x) as items, sum(x) + any_value(total_value) as total from i join ev using (event_id) group by all""")
def valued(v: Views) -> DataFrame:
    value = F.when(F.col("damage") == 2, F.lit(0)).otherwise(F.col("isk"))
    out = G.valuation(v.actors, ["event_id"], slot_of_flag(F.col("type_id") % 180), value)
    return out.join(v.events.select("event_id", "total_value"), "event_id").withColumn("total", F.col("items") + F.col("total_value")).drop("total_value")


@query("a40_running_benefit", """p as (select actor_id, [floor(epoch(seen))::bigint, floor(value * 8640)::bigint] as x, seen, event_id from lg where value is not null and seen is not null)
select actor_id, list_reduce(list_prepend([0, 0]::bigint[], list(x order by seen, event_id)), lambda c, y: [greatest(c[1], y[1]) + y[2], 0::bigint])[1] as until
from p group by all""")
def benefit(v: Views) -> DataFrame:
    return G.running_benefit(v.log, "actor_id", F.unix_timestamp("at"), F.floor(F.col("value") * 8640), "event_id")


@query("g1_event_clusters", """m as (select *, case when floor(epoch(seen))::bigint - lag(floor(epoch(seen))::bigint) over w > 2700 then 1 else 0 end as fresh from lg window w as (partition by system_id order by seen)),
c as (select *, sum(fresh) over (partition by system_id order by seen rows unbounded preceding) as island from m)
select system_id, island::bigint as island, floor(epoch(min(seen)))::bigint as started_at, floor(epoch(max(seen)))::bigint as ended_at, count(*) as events, count(distinct actor_id) as participants
from c group by system_id, island having count(distinct actor_id) >= 2""")
def clusters(v: Views) -> DataFrame:
    return epochs(G.event_clusters(v.log, "system_id", "at", "actor_id", 2700, 2), "started_at", "ended_at")
