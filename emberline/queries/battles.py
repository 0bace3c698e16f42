"""Battle reports, doctrines, reports of actors and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import battles as B
from ..operators import proximity as N
from ..schema import Views
from .intel import SIDES, count, sides
from .registry import query


@query("b1_third_parties", """k as (select date_trunc('month', killed_at)::date as battle, f.alliance_id as killer, f.bloc_id as kb, c.alliance_id as victim, c.bloc_id as vb
  from ev join att using (event_id) join aff f using (actor_id) join vic c using (victim_id) where final_blow),
s as (select distinct battle, killer as who, kb as bloc from k union select distinct battle, victim, vb from k),
t as (select battle, who from s where bloc > 1),
o as (select battle, killer as who, max((vb = 0)::int) as on_a, max((vb = 1)::int) as on_b from k group by all),
b as (select battle, victim as who, max((kb = 0)::int) as by_a, max((kb = 1)::int) as by_b from k group by all),
r as (select battle, who, case when on_a = 1 and on_b = 1 then 'C' when on_a = 1 then 'B' when on_b = 1 then 'A'
  when by_a = 1 and by_b = 1 then 'C' when by_a = 1 then 'B' when by_b = 1 then 'A' end as side from t left join o using (battle, who) left join b using (battle, who))
select * from r where side is not null""")
def third_parties(v: Views) -> DataFrame:
    last = v.actors.where("final_blow").join(v.affiliations, "actor_id").select("event_id", F.col("alliance_id").alias("killer"), F.col("bloc_id").alias("kb"))
    lost = v.events.join(v.victims, "victim_id").select("event_id", F.to_date(F.date_trunc("month", "killed_at")).alias("battle"), F.col("alliance_id").alias("victim"), F.col("bloc_id").alias("vb"))
    kills = last.join(lost, "event_id")
    ends = F.explode(F.array(F.struct(F.col("killer").alias("who"), F.col("kb").alias("bloc")), F.struct(F.col("victim").alias("who"), F.col("vb").alias("bloc"))))
    side = F.when(F.col("e.bloc") == 0, "A").when(F.col("e.bloc") == 1, "B").otherwise("C")
    told = kills.select("battle", ends.alias("e")).select("battle", "e.who", side.alias("side")).distinct()
    return B.reclassified(told, kills.select("battle", "killer", "victim"))


@query("b4_damage_by_hull", """select date_trunc('year', killed_at)::date as battle, bloc_id as side, type_group, sum(damage)::double as damage, count(*) as hits
from att join ev using (event_id) join aff using (actor_id) join typ using (type_id) where damage > 0 group by all""")
def damage_by_hull(v: Views) -> DataFrame:
    battle = v.events.select("event_id", F.to_date(F.date_trunc("year", "killed_at")).alias("battle"))
    rows = v.actors.where("damage > 0").join(battle, "event_id").join(v.affiliations, "actor_id").join(v.types, "type_id")
    return rows.groupBy("battle", F.col("bloc_id").alias("side"), "type_group").agg(F.sum("damage").cast("double").alias("damage"), count().alias("hits"))


@query("b8_alliance_rollup", """r as (select case when alliance_id % 5 = 0 then 0 else alliance_id end as alliance_id, count(distinct actor_id) as pilots, count(*) filter (where final_blow) as final_blows,
  sum(damage)::double as damage, count(distinct event_id) as events from att join aff using (actor_id) group by 1)
select *, row_number() over (order by alliance_id = 0, damage desc, alliance_id) as position from r""")
def alliance_rollup(v: Views) -> DataFrame:
    known = v.affiliations.withColumn("alliance_id", F.when(F.col("alliance_id") % 5 != 0, F.col("alliance_id")))
    rows = v.actors.join(known, "actor_id").groupBy(F.coalesce("alliance_id", F.lit(0)).alias("alliance_id")).agg(
        F.countDistinct("actor_id").alias("pilots"), F.count_if("final_blow").alias("final_blows"), F.sum("damage").cast("double").alias("damage"), F.countDistinct("event_id").alias("events")
    )
    # a row per alliance is left here
    position = F.row_number().over(W.orderBy(F.col("alliance_id") == 0, F.desc("damage"), "alliance_id"))
    return rows.withColumn("position", position.cast("long"))


@query("b11_structures", """select case when status = 'P' then -event_id else victim_id end as actor_id, count(*) as deaths from ev group by all""")
def structures(v: Views) -> DataFrame:
    open_ = F.col("status") == "P"
    rows = v.events.select("event_id", F.when(~open_, F.col("victim_id")).alias("victim_id"), F.col("victim_id").alias("owner_id"))
    return B.with_structures(rows)


@query("b12_hydrated", """d as (select actor_id, arg_max(k, (seen_at, k)) as latest from (select actor_id, seen as seen_at, type_id % 9 as k from (select actor_id, seen_at as seen, type_id from att)) where k <> 0 group by all)
select s.actor_id, case when alliance_id % 4 <> 0 then alliance_id else latest end as corporation from aff s left join d using (actor_id)""")
def hydrated(v: Views) -> DataFrame:
    rows = v.affiliations.select("actor_id", F.when(F.col("alliance_id") % 4 != 0, F.col("alliance_id")).otherwise(F.lit(0)).cast("long").alias("corporation"))
    details = v.actors.select("actor_id", (F.col("type_id") % 9).cast("long").alias("corporation"), "seen_at")
    return B.hydrated(rows, details, "actor_id", "corporation", "seen_at")


@query("b22_confidence", """c as (select actor_id, count(*) filter (where kind = 'combat') as battles, count(*) filter (where kind = 'intel_report') as scans,
  count(distinct system_id) as clusters, count(*) filter (where kind = 'notify') as events, count(*) as n from lg where actor_id is not null group by all)
select actor_id, round(greatest(0.05::double, least(1.0::double, (3 * battles + 2 * scans + clusters + events) / 12)), 8) as breadth,
round(least(1.0::double, 0.4::double * least(1.0::double, n / 5) + 0.6::double * greatest(0.05::double, least(1.0::double, (3 * battles + 2 * scans + clusters + events) / 12))), 8) as confidence from c""")
def confidence(v: Views) -> DataFrame:
    of = lambda kind: F.count_if(F.col("kind") == kind)
    c = v.log.where("actor_id is not null").groupBy("actor_id").agg(
        of("combat").alias("battles"), of("intel_report").alias("scans"), F.countDistinct("system_id").alias("clusters"), of("notify").alias("events"), count().alias("n")
    )
    c = c.withColumn("breadth", B.evidence_breadth(*map(F.col, ("battles", "scans", "clusters", "events"))))
    return c.select("actor_id", F.round("breadth", 8).alias("breadth"), F.round(B.section_confidence(F.col("n"), F.col("breadth")), 8).alias("confidence"))


@query("a8_conditional_lift", SIDES + """, m as (select x.event_id, x.alliance_id as a, y.alliance_id as b, max((x.side = y.side)::int) as same
  from sd x join sd y using (event_id) where x.alliance_id < y.alliance_id group by all),
t as (select a, b, count(*) as n_all, sum(same) as s_all from m group by all),
w as (select a, b, trig, count(*) as n, sum(same) as s from m join (select distinct event_id, alliance_id as trig from sd) using (event_id) where trig <> a and trig <> b group by all),
r as (select a, b, trig as "trigger", n::double as n, s / n as with_it, (s_all - s) / (n_all - n) as without from w join t using (a, b) where n >= 5 and n_all - n >= 5)
select a, b, "trigger", n, round(with_it, 8) as with_it, round(without, 8) as without, round(with_it - without, 8) as delta from r where abs(with_it - without) >= 0.1""")
def lift(v: Views) -> DataFrame:
    out = B.conditional_lift(sides(v, min_pilots=1).withColumnRenamed("alliance_id", "who"))
    return out.withColumns({c: F.round(c, 8) for c in ("with_it", "without", "delta")})


@query("a14_doctrines", """f as (select event_id, actor_id, alliance_id, band as role, killed_at, type_id % 3 as module, size % 4 as hull from att join aff using (actor_id) join ev using (event_id) join typ using (type_id)),
w as (select event_id, actor_id, hull, role, list_sort(list(module)) as mods, max(alliance_id) as alliance_id, min(killed_at) as seen from f group by event_id, actor_id, hull, role)
select hull, role, md5(array_to_string(mods, ',')) as fingerprint, max(len(mods)) as modules, count(*) as fits, count(distinct alliance_id) as alliances, epoch_us(min(seen)) as first_us, epoch_us(max(seen)) as last_us
from w group by 1, 2, 3""")
def doctrines(v: Views) -> DataFrame:
    types = v.types.select("type_id", (F.col("type_id") % 3).alias("module"), (F.col("size") % 4).alias("hull"))
    events = v.events.select("event_id", F.col("band").alias("role"), F.col("killed_at").alias("at"))
    fits = v.actors.select("event_id", "actor_id", "type_id").join(v.affiliations, "actor_id").join(events, "event_id").join(types, "type_id")
    return B.doctrine_fold(fits).select(
        "hull", "role", "fingerprint", "modules", "fits", "alliances", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us")
    )


@query("d18_doctrine_changes", """u as (select alliance_id as who, split_part(category, ' ', 1) as class, count(*) filter (where killed_at < timestamp '1995-01-01') as p, count(*) filter (where killed_at >= timestamp '1995-01-01') as c
  from att join ev using (event_id) join aff using (actor_id) join typ using (type_id) where killed_at >= timestamp '1994-10-01' and killed_at < timestamp '1995-02-01' group by all),
s as (select who, class, p / nullif(sum(p) over (partition by who), 0) as prior, c / nullif(sum(c) over (partition by who), 0) as current from u),
z as (select who, class, coalesce(prior, 0) as prior, coalesce(current, 0) as current from s)
select who, class, 'adoption' as change, round(current - prior, 8) as delta from z where prior < 0.1::double and current >= 0.1::double
union all select who, class, 'abandonment', round(current - prior, 8) from z where prior >= 0.1::double and current < 0.1::double
union all select who, class, case when current > prior then 'sudden_rise' else 'sudden_fall' end, round(current - prior, 8) from z where abs(current - prior) >= 0.2::double""")
def doctrine_changes(v: Views) -> DataFrame:
    at = v.events.where("killed_at >= timestamp '1994-10-01 00:00:00' and killed_at < timestamp '1995-02-01 00:00:00'").select(
        "event_id", (F.col("killed_at") >= F.lit("1995-01-01").cast("timestamp")).alias("late")
    )
    types = v.types.select("type_id", F.split_part("category", F.lit(" "), F.lit(1)).alias("class"))
    rows = v.actors.select("event_id", "actor_id", "type_id").join(at, "event_id").join(v.affiliations, "actor_id").join(types, "type_id")
    n = rows.groupBy(F.col("alliance_id").alias("who"), "class").agg(F.count_if(~F.col("late")).alias("p"), F.count_if("late").alias("c"))
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(W.partitionBy("who")), F.lit(0)), F.lit(0.0))
    out = B.doctrine_changes(n.select("who", "class", share("p").alias("prior"), share("c").alias("current")))
    return out.withColumn("delta", F.round("delta", 8))


@query("b15_coordinated_joins", """j as (select victim_id as actor_id, alliance_id, min(killed_at)::date - date '1990-01-01' as day from ev join vic using (victim_id) group by victim_id, alliance_id)
select actor_id, other, gap from (select x.actor_id, y.actor_id as other, abs(x.day - y.day)::bigint as gap, row_number() over (partition by x.actor_id order by abs(x.day - y.day), y.actor_id) as rn
  from j x join j y using (alliance_id) where x.actor_id <> y.actor_id and abs(x.day - y.day) <= 7) where rn <= 20""")
def coordinated_joins(v: Views) -> DataFrame:
    day = F.date_diff(F.min("killed_at").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    joins = v.events.join(v.victims, "victim_id").groupBy(F.col("victim_id").alias("actor_id"), F.col("alliance_id").alias("grp")).agg(day.alias("day"))
    return B.joined_together(joins)


@query("d4_first_resolution", """select event_id, coalesce(system_id, case when event_id % 3 <> 0 then event_id * 7 % 50 end) as place from lg""")
def resolved(v: Views) -> DataFrame:
    found = v.log.where("event_id % 3 <> 0").select("event_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("k"))
    found = found.select("event_id", (F.col("event_id") * 2 + F.col("k")).alias("id"), ((F.col("event_id") * 7 + F.col("k")) % 50).alias("resolved"))
    return B.first_resolution(v.log.select("event_id", F.col("system_id").alias("place")), found)


@query("d11_reporters", """r as (select r.event_id, r.actor_id, r.seen, min(c.seen) as confirmed from lg r
  left join lg c on c.actor_id = r.actor_id and c.kind = 'combat' and date_trunc('second', c.seen) between date_trunc('second', r.seen) and date_trunc('second', r.seen) + interval 15 minutes
  where r.kind = 'intel_report' and r.actor_id is not null group by all)
select actor_id, count(*) as reports, count(confirmed) as confirmations, round(avg(floor(epoch(confirmed)) - floor(epoch(seen))), 4) as latency, round(count(confirmed) / count(*), 6) as reliability,
case when count(*) >= 30 then 'high' when count(*) >= 10 then 'medium' when count(*) >= 3 then 'low' else 'insufficient' end as confidence from r group by actor_id""")
def reporters(v: Views) -> DataFrame:
    reports = v.log.where("kind = 'intel_report' and actor_id is not null").select("event_id", "actor_id", "at")
    combat = v.log.where("kind = 'combat'").select("actor_id", F.col("at").alias("seen"))
    return B.reporter_reliability(N.first_within(reports, combat, ["actor_id"], "at", "seen", 900, "confirmed"))


@query("m11_opportunities", """select type_id, sum(remain)::bigint as volume from mkt where type_id not in (select type_id from mkt where location_id = 1) group by type_id
having sum(remain) >= 10 order by volume desc, type_id limit 30""")
def opportunities(v: Views, owner: int = 1, least: int = 10, top: int = 30) -> DataFrame:
    owned = v.market.where(F.col("location_id") == owner).select("type_id").distinct()
    volume = v.market.groupBy("type_id").agg(F.sum("remain").alias("volume")).where(F.col("volume") >= least)
    return volume.join(owned, "type_id", "left_anti").orderBy(F.desc("volume"), "type_id").limit(top)
