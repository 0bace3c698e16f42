"""Combat anomalies of a week's battles between blocs; a returned line is its actor's loss, with the event's
lines as fit; the first two lines, if not returned, are kills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators.graph import cut, kept
from ..schema import Views
from .chain import hulls
from .registry import query

END = "2001-03-31"


@query("a36_combat_anomaly", f"""l as (select event_id, actor_id, type_id, damage, isk, slot, l_returnflag = 'R' as lost, date_trunc('week', killed_at)::date as battle, killed_at, band
  from att join lineitem on l_orderkey = event_id and l_linenumber = slot join ev using (event_id)),
hull as (select type_id, case substr(type_group, 7, 1) when '1' then 'logi' when '2' then 'bomber' when '3' then 'command' when '4' then 'tackle' else 'mainline' end as category
  from typ where type_group <> 'Brand#55'),
sd as (select l.*, bloc_id + 1 as side from l join aff using (actor_id)),
total as (select battle, side, sum(damage) as total, sum(isk) filter (where not lost and slot <= 2) as killed, sum(isk) filter (where lost) as lost from sd group by all),
f0 as (select battle, side, actor_id, type_id, sum(sum(damage)) over (partition by battle, side, actor_id)::double as d, row_number() over (partition by battle, side, actor_id order by count(*) desc, type_id) as r from sd group by battle, side, actor_id, type_id),
feat as (select f0.battle, f0.side, actor_id, type_id, category, d / total::double as damage_share from f0 join hull using (type_id) join total using (battle, side) where r = 1),
win as (select * from feat where battle between date '{END}' - 90 and date '{END}'),
dead as (select distinct battle, actor_id, 1 as fell from sd where lost),
st as (select battle, side, category, count(*) as peers, median(damage_share) as middle, stddev_samp(damage_share) as spread, count(fell) as n_dead, max(actor_id) as last_peer
  from (select *, row_number() over (partition by battle, side, category order by actor_id) as place from win) x left join dead using (battle, actor_id) where place <= 40 group by all),
j as (select w.*, peers, middle, spread, peers >= 3 as told, dead.fell is not null as fell, n_dead - (dead.fell is not null and actor_id <= last_peer)::int as others_dead,
  coalesce(coalesce(killed, 0) < coalesce(lost, 0), false) as heavy from win w join st using (battle, side, category) left join dead using (battle, actor_id) left join total using (battle, side)),
q as (select *, case when told and spread > 0 then (damage_share - middle) / spread end as z, case when told and spread > 0 then least(1.0::double, peers / 40) end as wt,
  told and peers >= 4 and others_dead / nullif(peers - 1, 0) >= 0.5 as ok from j),
own as (select actor_id, count(*) as battles, median(case when told and middle > 0 then damage_share / middle end) as share, sum(z * wt) / nullif(sum(wt), 0) as dz,
  count(*) filter (where ok) as qualifying, case when count(*) filter (where ok) >= 5 then count(*) filter (where ok and not fell) / count(*) filter (where ok) end as lived,
  count(*) filter (where heavy) / count(*) as fed, list_sort(list(distinct category)) as cats from q group by actor_id),
it as (select x.event_id, x.actor_id, x.killed_at, x.band as hull, y.slot as flag, substr(type_group, 7, 1) as module from (select distinct event_id, actor_id, killed_at, band from l where lost) x
  join att y using (event_id) join typ using (type_id)),
doc as (select band as hull, slot as flag, substr(type_group, 7, 1) as want from l join typ using (type_id) group by band, slot, substr(type_group, 7, 1) qualify row_number() over (partition by band, slot order by count(*) desc, substr(type_group, 7, 1)) = 1),
inw as (select * from it where killed_at between timestamp '{END}' - interval 90 day and timestamp '{END}'),
lo as (select event_id, actor_id, count(*) as n, count(*) filter (where module <> want) as off from inw join doc using (hull, flag) group by all having count(*) >= 2),
fit as (select actor_id, floor(median(off))::bigint as fit_median, median(off / n) as ratio, count(*) as fit_losses from lo group by all),
vict as (select actor_id, count(distinct event_id) as as_victim from inw group by all),
sets as (select distinct cats from own), ex as (select cats, unnest(cats) as category from sets),
who as (select distinct cats, actor_id from ex join win using (category) where side <= 3),
mean as (select cats, actor_id, avg(damage_share) as share from who join ex using (cats) join feat using (actor_id, category) group by all),
coh as (select cats, count(*) as cohort_size, case when count(*) >= 30 then median(share) end as m, case when count(*) >= 30 then stddev_samp(share) end as d from mean group by all),
past as (select actor_id, median(damage_share) as base from feat where battle between date '{END}' - 180 and date '{END}' - 90 group by all having count(*) >= 5),
r as (select own.*, coalesce(cohort_size, 0) as cohort_size, m, d, base, fit_median, ratio, coalesce(fit_losses, 0) as fit_losses, coalesce(as_victim, 0) as as_victim
  from own left join coh using (cats) left join past using (actor_id) left join fit using (actor_id) left join vict using (actor_id)),
s as (select *, [case when dz <= -1 then 1 when dz >= 1 then -1 end, case when lived >= 0.75 then 1 when lived <= 0.25 then -1 end, case when fed >= 0.65 then 1 when fed <= 0.3 then -1 end,
  case when fit_losses >= 2 and ratio >= 0.5 then 1 when fit_losses >= 2 and ratio = 0 then -1 end] as sig, cohort_size >= 30 and battles >= 5 as enough from r),
c as (select *, len(list_filter(sig, lambda x: x = 1)) as up, len(list_filter(sig, lambda x: x = -1)) as down from s)
select actor_id, battles, as_victim, round(share, 3) as damage_share_median, round(dz, 3) as damage_z_battle, round((share - m) / greatest(0.01, d), 3) as damage_z_cohort,
  case when base > 0 then round((share - base) / greatest(0.01, base * 0.3), 3) end as damage_z_self, round(lived, 3) as survival_rate,
  case when m is not null then round((lived - 0.5) / 0.25, 3) end as survival_z_cohort, qualifying, round(fed, 3) as feed_rate, case when m is not null then round((fed - 0.5) / 0.25, 3) end as feeding_score,
  fit_median, fit_losses, cohort_size, base is not null as has_baseline,
  case when not enough then 'low' when cohort_size >= 100 and battles >= 20 then 'high' else 'medium' end as confidence, up::int as reinforcing, down::int as weakening,
  case when not enough then 'insufficient_data' when up >= 2 and up > down then 'reinforces' when down >= 2 and down > up then 'weakens' else 'neutral' end as band from c""")
def combat_anomaly(v: Views) -> DataFrame:
    """The viewer's bloc holds the first three sides."""
    returned = v.table("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("slot"), (F.col("l_returnflag") == "R").alias("lost"))
    events = v.events.select("event_id", F.to_date(F.date_trunc("week", "killed_at")).alias("battle"), "killed_at", F.col("band").alias("hull"))
    lines = kept(v.actors.join(returned, ["event_id", "slot"]).join(events, "event_id").select("event_id", "slot", "actor_id", "type_id", "damage", "isk", "lost", "battle", "killed_at", "hull"))
    sided = lines.join(v.affiliations.select("actor_id", (F.col("bloc_id") + 1).alias("side")), "actor_id")
    per_type = sided.groupBy("battle", "side", "actor_id", "type_id").agg(F.count(F.lit(1)).alias("n"), F.sum("damage").alias("d"))
    flown = per_type.groupBy("battle", "side", "actor_id").agg(F.min_by("type_id", F.struct(-F.col("n"), "type_id")).alias("type_id"), F.sum("d").cast("double").alias("d"))
    side = sided.groupBy("battle", "side").agg(
        F.sum("damage").cast("double").alias("total"), *[F.coalesce(F.sum(F.when(c, F.col("isk"))), F.lit(0)).alias(n) for n, c in (("killed", ~F.col("lost") & (F.col("slot") <= 2)), ("lost", F.col("lost")))]
    )
    side = cut(side)
    features = flown.join(hulls(v), "type_id").join(side, ["battle", "side"]).select(*A.GROUP, "actor_id", "type_id", (F.col("d") / F.col("total")).alias("damage_share"), F.col("battle").cast("timestamp").alias("started"))
    features = kept(features)
    deaths = sided.where("lost").select("battle", "actor_id")
    module = v.types.select("type_id", F.substring("type_group", 7, 1).cast("int").alias("module"))
    fitted = v.actors.select("event_id", F.col("slot").alias("flag"), "type_id").join(module, "type_id").select("event_id", "flag", F.col("module").alias("type_id"))
    hull = F.substring("hull", 1, 1).cast("int").alias("hull")
    items = lines.where("lost").select("event_id", "actor_id", "killed_at", hull).distinct().join(fitted, "event_id")
    seen = lines.select(hull, F.col("slot").alias("flag"), "type_id").join(module, "type_id").groupBy("hull", "flag", "module").agg(F.count(F.lit(1)).alias("n"))
    doctrine = seen.groupBy("hull", "flag").agg(F.min_by("module", F.struct(-F.col("n"), "module")).alias("type_id"))
    bloc = v.spark.range(1, 4).select(F.col("id").alias("side"))
    return A.anomalies(features, deaths, side, items, doctrine, bloc, F.lit(END).cast("timestamp"))
