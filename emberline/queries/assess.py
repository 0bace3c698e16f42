"""Scores, classes and incidents of systems, actors, routes, lanes and viewers; lines and headers of client logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scoring as P
from ..schema import Views
from ..sources import lines
from .intel import count
from .registry import query


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("a9_colocation", """t as (select distinct event_id, who, w.bloc_id || '-' || killed_at::date as cell, w.alliance_id as place
  from (select event_id, alliance_id as who from att join aff using (actor_id) union select event_id, alliance_id from ev join vic using (victim_id)) join ev using (event_id) join vic w using (victim_id)),
h as (select who, cell, list(distinct place) as ps from t group by all),
g as (select distinct x.who as a, y.who as b, x.cell as cell from t x join t y using (event_id) where x.who < y.who),
m as (select x.who as a, y.who as b, g.a is null as av, g.a is null and not list_has_any(x.ps, y.ps) as ap from h x join h y on x.cell = y.cell and x.who < y.who
  left join g on g.a = x.who and g.b = y.who and g.cell = x.cell)
select a, b, count(*) as shared, count(*) filter (where av) as avoided, count(*) filter (where ap) as parallel, round(count(*) filter (where av) / count(*), 8) as avoidance,
round(count(*) filter (where ap) / count(*), 8) as parallel_share from m group by a, b""")
def colocation(v: Views) -> DataFrame:
    lost = v.events.join(v.victims, "victim_id")
    cell = F.concat_ws("-", "bloc_id", F.to_date("killed_at"))
    where = lost.select("event_id", cell.alias("cell"), F.col("alliance_id").alias("place"))
    there = v.actors.select("event_id", "actor_id").join(v.affiliations, "actor_id").select("event_id", F.col("alliance_id").alias("who"))
    there = there.unionByName(lost.select("event_id", F.col("alliance_id").alias("who"))).distinct()
    return rounded(P.colocation(there.join(where, "event_id")), "avoidance", "parallel_share")


@query("a16_role_priors", """d as (select event_id, sum(damage)::double as all_ from att group by all),
r as (select actor_id as who, size % 5 as hull, final_blow as main, damage::double / all_ as share, status from att join d using (event_id) join typ using (type_id) join ev using (event_id)),
p as (select who, count(*) as n, count(*) filter (where hull = 0) / count(*) as hc, count(*) filter (where hull = 1) / count(*) as hl, count(*) filter (where hull = 2) / count(*) as hm,
  count(*) filter (where hull = 3) / count(*) as hb, count(*) filter (where hull = 4) / count(*) as ht, count(*) filter (where main) / count(*) as main, avg(share) as share,
  count(*) filter (where status = 'F') / count(*) as fc, count(*) filter (where status = 'O') / count(*) as lo, count(*) filter (where status = 'P') / count(*) as ml from r group by who)
select who, n as battles, round(least(1, 0.6e0 * hc + 0.25e0 * fc + case when who % 4 = 0 then 0.15e0 else 0e0 end), 8) as fc, round(least(1, 0.7e0 * hl + 0.2e0 * lo + 0.1e0 * (1 - share)), 8) as logi,
round(least(1, 0.5e0 * hm + 0.2e0 * main + 0.15e0 * share + 0.15e0 * ml), 8) as mainline, round(0.7e0 * hc, 8) as command, round(0.8e0 * hb, 8) as bomber, round(0.7e0 * ht, 8) as tackle
from p where n >= 5""")
def role_priors(v: Views) -> DataFrame:
    whole = v.actors.groupBy("event_id").agg(F.sum("damage").cast("double").alias("all"))
    hull = F.element_at(F.array(*map(F.lit, ("command", "logi", "mainline", "bomber", "tackle"))), (F.col("size") % 5 + 1).cast("int"))
    rows = v.actors.join(whole, "event_id").join(v.types.select("type_id", "size"), "type_id")
    rows = rows.select("event_id", F.col("actor_id").alias("who"), hull.alias("hull"), F.col("final_blow").alias("in_main"), (F.col("damage").cast("double") / F.col("all")).alias("share"))
    role = F.create_map(*map(F.lit, ("F", "fc", "O", "logi", "P", "mainline_dps")))[F.col("status")]
    said = v.actors.select("event_id", F.col("actor_id").alias("who")).join(v.events.select("event_id", "status"), "event_id").groupBy("who", role.alias("role")).agg(count().alias("n"))
    out = P.role_priors(rows, said, v.affiliations.where("actor_id % 4 = 0").select(F.col("actor_id").alias("who")))
    return rounded(out, *P.PRIOR_PARTS)


@query("a23_threat", """c as (select system_id, count(*) filter (where kind = 'combat') as cluster, count(*) filter (where kind = 'fleet_message') as escalation, count(*) filter (where kind = 'notify') as density,
  count(distinct actor_id) as corridor, count(*) filter (where kind = 'unknown') as capital from lg where system_id is not null group by all),
r as (select system_id, cluster + 1.5e0 * escalation + 0.05e0 * density + 0.05e0 * corridor + 1.5e0 * capital as raw from c),
t as (select system_id, raw, raw * 10 / greatest((select max(raw) from r), 1) as threat from r)
select system_id, round(raw, 6) as raw, round(threat, 6) as threat, case when round(threat, 4) >= 7 then 'strategic' when round(threat, 4) >= 4 then 'hot' when round(threat, 4) >= 2 then 'contested'
when round(threat, 4) >= 0.5 then 'watch' else 'safe' end as tier from t""")
def threat(v: Views) -> DataFrame:
    of = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    parts = v.log.where("system_id is not null").groupBy("system_id").agg(
        of("combat", "cluster"), of("fleet_message", "escalation"), of("notify", "density"), F.countDistinct("actor_id").alias("corridor"), of("unknown", "capital")
    )
    return rounded(P.threat(parts), "raw", "threat", digits=6).select("system_id", "raw", "threat", "tier")


@query("a27_composition", """s as (select actor_id as snapshot, ['logistics', 'tackle', 'dps', 'support', 'pod', 'shuttle', 'yacht'][(size % 7 + 1)::int] as role from att join typ using (type_id)),
c as (select snapshot, count(*) filter (where role = 'logistics') as logistics, count(*) filter (where role = 'tackle') as tackle, count(*) filter (where role in ('dps', 'yacht')) as dps,
  count(*) filter (where role = 'support') as support, count(*) filter (where role = 'pod') as pod, count(*) filter (where role = 'shuttle') as shuttle,
  count(*) filter (where role not in ('pod', 'shuttle')) as pilots from s group by snapshot)
select *, round(logistics / greatest(1, pilots - support), 8) as logistics_ratio, round(tackle / greatest(1, pilots - support), 8) as tackle_ratio from c""")
def composition(v: Views) -> DataFrame:
    names = ("logistics", "tackle", "dps", "support", "pod", "shuttle", "yacht")
    role = F.element_at(F.array(*map(F.lit, names)), (F.col("size") % 7 + 1).cast("int"))
    flown = v.actors.join(v.types, "type_id").groupBy(F.col("actor_id").alias("snapshot"), role.alias("role")).agg(count().alias("n"))
    return rounded(P.composition(flown, names[:-1]), "logistics_ratio", "tackle_ratio")


@query("a29_lane_metrics", """r as (select kind as lane, case event_id % 10 when 0 then 'failed' when 1 then 'running' else 'succeeded' end as status, seen, event_id * 37 % 5000 as ms from lg where kind is not null),
k as (select lane, ms, row_number() over (partition by lane order by ms) - 1 as i, 19 * (count(*) over (partition by lane) - 1) as m from r where status = 'succeeded' and seen >= timestamp '2024-01-30'),
p as (select lane, min(ms) filter (where i = m // 20 + (case when m % 20 > 10 or (m % 20 = 10 and (m // 20) % 2 = 1) then 1 else 0 end)) as p95 from k group by lane),
c as (select lane, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'succeeded' and seen >= timestamp '2024-01-30') as succeeded,
  count(*) filter (where status = 'failed' and seen >= timestamp '2024-01-30') as failed, floor(avg(ms) filter (where status = 'succeeded' and seen >= timestamp '2024-01-30'))::bigint as mean,
  epoch(timestamp '2024-01-31')::bigint - floor(epoch(min(seen) filter (where status = 'running')))::bigint as oldest from r group by lane)
select c.*, p95, round(succeeded / 24, 8) as throughput, case when failed > 0 and succeeded = 0 then 'failed' when oldest > 3600 then 'starved' when running >= 4 then 'backlogged'
when failed > 0 and 5 * failed >= succeeded + failed then 'degraded' else 'healthy' end as state from c left join p using (lane)""")
def lane_metrics(v: Views) -> DataFrame:
    status = F.when(F.col("event_id") % 10 == 0, "failed").when(F.col("event_id") % 10 == 1, "running").otherwise("succeeded")
    runs = v.log.where("kind is not null").select(F.col("kind").alias("lane"), status.alias("status"), F.col("at").alias("started_at"), (F.col("event_id") * 37 % 5000).alias("ms"))
    return rounded(P.lane_metrics(runs, F.lit("2024-01-31").cast("timestamp")), "throughput")


@query("d14_incidents", """s as (select system_id as place, event_id, floor(epoch(seen))::bigint as t, actor_id, kind, value, lag(floor(epoch(seen))::bigint) over (partition by system_id order by seen) as was from lg where kind is not null),
m as (select *, sum((was is null or t - was > 900)::int) over (partition by place order by t rows unbounded preceding) as island from s),
c as (select place, island, min(t) as first_second, max(t) as last_second, count(*) as n, bool_or(kind = 'fleet_message') as ff, bool_or(kind = 'intel_report') as hc, bool_or(kind = 'combat') as cs,
  bool_or(kind = 'notify') as di, bool_or(kind = 'unknown') as un, count(distinct kind) as kinds, count(distinct actor_id) filter (where kind = 'intel_report') as reporters,
  count(distinct actor_id) as characters, count(distinct event_id) filter (where kind = 'intel_report') as clusters, bool_or(value > 90 and kind = 'intel_report') as strong from m group by all)
select place, first_second, last_second, n, reporters, characters, clusters,
case when ff and (hc or cs) then 'fleet_op' when hc and (cs or di) then 'engagement' when hc then 'hostile_contact' when cs then 'combat' when di then 'disengagement' when ff then 'fleet_op'
  when un and kinds = 1 then 'telemetry_gap' else 'mixed' end as type,
case when reporters >= 10 and characters >= 10 then 'coalition_level' when hc and cs and di then 'escalation' when kinds >= 3 and coalesce(strong, false) then 'strategic'
  when coalesce(strong, false) or kinds >= 2 then 'tactical' else 'noise' end as severity,
case when reporters >= 5 or clusters >= 3 then 'high' when reporters >= 3 or clusters >= 2 then 'medium' when reporters >= 2 or kinds >= 2 then 'low' else 'insufficient' end as confidence from c""")
def incidents(v: Views) -> DataFrame:
    told = {"fleet_message": "fleet_formup", "intel_report": "hostile_cluster", "combat": "combat_spike", "notify": "disengagement", "unknown": "unknown"}
    kind = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])[F.col("kind")]
    reported = F.col("kind") == "intel_report"
    signals = v.log.where("kind is not null").select(
        F.col("system_id").alias("place"), kind.alias("kind"), F.col("at").alias("started_at"), F.col("at").alias("ended_at"), F.when(reported, F.col("actor_id")).alias("reporter"),
        F.col("actor_id").alias("character"), F.when(reported, F.col("event_id")).alias("cluster_id"), F.when(reported & (F.col("value") > 90), "strong").alias("quality"), F.lit(None).cast("int").alias("ships"),
    )
    out = P.fused_incidents(signals)
    second = lambda c: F.unix_timestamp(c)
    return out.select("place", second("started_at").alias("first_second"), second("ended_at").alias("last_second"), "n", "reporters", "characters", "clusters", "type", "severity", "confidence")


@query("d17_route_classes", """t as (select actor_id, system_id as b, seen, lag(system_id) over w as a, floor(epoch(seen))::bigint - floor(epoch(lag(seen) over w))::bigint as s from lg where system_id is not null and actor_id is not null window w as (partition by actor_id order by seen, event_id)),
r as (select a, b, count(*) as n, count(distinct actor_id) as characters, floor(avg(s))::bigint as seconds, (floor(epoch(max(seen)))::bigint - floor(epoch(min(seen)))::bigint) // 86400 as span,
  a % 3 = 0 as fe, b % 3 = 0 as te, a % 5 + b % 5 as strat from t where a <> b group by a, b),
x as (select a, b, n, case when seconds <= 90 and characters >= 3 and n >= 4 then least(1, n / 50 + characters / 30) else 0 end as staging,
  case when te and not fe then least(1, 0.3e0 + n / 30) when fe and not te then least(1, 0.2e0 + n / 40) else 0 end as reinforcement, case when fe and te then least(1, 0.5e0 + strat / 20) else 0 end as escalation, span, characters from r)
select a, b, n, round(staging, 8) as staging, round(reinforcement, 8) as reinforcement, round(escalation, 8) as escalation, case when escalation >= 0.5 then 'escalation_path' when staging >= 0.5 then 'staging'
when reinforcement >= 0.4 then 'reinforcement' when span >= 14 and n >= 3 and characters >= 2 then 'deployment_migration' when n >= 2 then 'transit' else 'unclassified' end as class from x""")
def route_classes(v: Views) -> DataFrame:
    w = W.partitionBy("actor_id").orderBy("at", "event_id")
    moved = v.log.where("system_id is not null and actor_id is not null").withColumns({"a": F.lag("system_id").over(w), "s": F.unix_timestamp("at") - F.lag(F.unix_timestamp("at")).over(w)})
    seconds = F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))
    routes = moved.where("a <> system_id").groupBy("a", F.col("system_id").alias("b")).agg(
        count().alias("n"), F.countDistinct("actor_id").alias("characters"), F.floor(F.avg("s")).alias("seconds"), F.floor(seconds / 86400).alias("span_days")
    )
    routes = routes.withColumns({"from_escalates": F.col("a") % 3 == 0, "to_escalates": F.col("b") % 3 == 0, "strategic": F.col("a") % 5 + F.col("b") % 5})
    return rounded(P.route_classes(routes), "staging", "reinforcement", "escalation").select("a", "b", "n", "staging", "reinforcement", "escalation", "class")


KINDS = tuple(P.SIGNAL_WEIGHTS)
#: Fixed value: days of sales that a listing should last.
RUNWAY = 14


@query("d25_hypotheses", f"""k as (select unnest({list(KINDS)}) as kind, unnest({list(P.SIGNAL_WEIGHTS.values())})::double as weight, unnest(range(11)) as i),
s as (select actor_id as who, kind, weight, ['battle', 'graph', 'community', 'telemetry'][(i % 4 + 1)::int] as domain, ((actor_id * 7 + i * 13) % 11) / 10 as strength from aff, k),
h as (select who, sum(weight * strength) as score, count(distinct domain) as domains from s where strength > 0.7e0 group by who)
select who, round(score, 8) as score, domains, case when domains >= 3 and score >= 4 then 'high' else 'medium' end as confidence,
case when domains >= 3 and score >= 4 and who % 10 >= 4 then 'critical' when score >= 4 then 'elevated' else 'watch' end as severity from h where domains >= 2 and score >= 3""")
def hypotheses(v: Views) -> DataFrame:
    kinds = F.posexplode(F.array(*map(F.lit, KINDS)))
    domain = F.element_at(F.array(*map(F.lit, ("battle", "graph", "community", "telemetry"))), F.col("i") % 4 + 1)
    signals = v.affiliations.select(F.col("actor_id").alias("who"), kinds.alias("i", "kind")).withColumns({"domain": domain, "strength": ((F.col("who") * 7 + F.col("i") * 13) % 11) / 10})
    prior = v.affiliations.select(F.col("actor_id").alias("who"), ((F.col("actor_id") % 10) / 10).alias("prior"))
    return rounded(P.hypotheses(signals.where("strength > 0.7D"), prior), "score")


@query("m4_review_priority", """f as (select actor_id as who, actor_id * 7 % 101 / 100 as af, actor_id * 11 % 101 / 100 as ho, actor_id * 13 % 101 / 100 as br, actor_id * 17 % 101 / 100 as ch, actor_id * 19 % 101 / 100 as ip,
  actor_id % 5 = 0 as rj, actor_id % 25 as sn, actor_id % 7 = 0 as sd, actor_id % 70 as ring, actor_id % 31 = 0 as lead from aff),
s as (select who, lead, (af >= 0.85e0)::int + (ho >= 0.85e0)::int + (br >= 0.95e0)::int + rj::int + (ch >= 0.95e0)::int + (sn >= 10)::int + (ip >= 0.95e0 and not sd)::int as signals,
  0.28e0 * af + 0.24e0 * ho + 0.12e0 * br + 0.08e0 * ch + 0.08e0 * rj::int + 0.1e0 * least(1, sn / 20) + 0.05e0 * (ip >= 0.95e0)::int + 0.05e0 * (ring between 5 and 50)::int as score from f)
select who, signals, case when lead then 0 else round(score, 4) end as score, case when lead then 'leadership_exempt' when signals >= 3 or score >= 0.75e0 then 'critical' when signals >= 2 or score >= 0.55e0 then 'high'
when signals >= 1 or score >= 0.35e0 then 'elevated' else 'below_threshold' end as band from s""")
def review_priority(v: Views) -> DataFrame:
    id_ = F.col("actor_id")
    pct = lambda k: (id_ * k % 101) / 100
    return P.review_priority(v.affiliations.select(
        id_.alias("who"), pct(7).alias("affiliation"), pct(11).alias("hostile_overlap"), pct(13).alias("bridge"), pct(17).alias("churn"), pct(19).alias("inner_pct"), (id_ % 5 == 0).alias("recent_join"),
        (id_ % 25).alias("seeds"), (id_ % 7 == 0).alias("is_seed"), (id_ % 70).alias("ring"), (id_ % 31 == 0).alias("leader"),
    ))


@query("m9_doctrine_match", """s as (select actor_id as snapshot, type_group as ship, count(*) as n from att join typ using (type_id) group by all),
r as (select *, n / sum(n) over (partition by snapshot) as share, row_number() over (partition by snapshot order by n desc, ship) as rn from s),
m as (select snapshot, d.type_id as id, share, share * (d.size / 50) as score from r join typ d on d.type_group = ship where rn <= 8 and d.type_id % 3 = 0)
select snapshot, id as doctrine, round(share, 8) as share, round(least(1, 1.5e0 * score), 8) as confidence from (select *, row_number() over (partition by snapshot order by score desc, id) as rn from m) where rn = 1""")
def doctrine_match(v: Views) -> DataFrame:
    ships = v.actors.join(v.types, "type_id").groupBy(F.col("actor_id").alias("snapshot"), F.col("type_group").alias("ship")).agg(count().alias("n"))
    doctrines = v.types.where("type_id % 3 = 0").select(F.col("type_id").alias("id"), F.col("type_group").alias("ship"), (F.col("size") / 50).alias("confidence"))
    return rounded(P.doctrine_match(ships, doctrines), "share", "confidence")


@query("m13_viewer_bloc", """w as (select actor_id as viewer, alliance_id as alliance, actor_id % 11 as corporation from aff),
l as (select distinct alliance_id as entity, 'alliance' as kind, alliance_id % 3 as bloc from aff where alliance_id % 4 > 0 union select distinct alliance_id, 'alliance', 7 from aff where alliance_id % 5 = 0
  union select distinct actor_id % 11, 'corporation', actor_id % 11 % 3 from aff where actor_id % 11 < 9 union select distinct actor_id % 11, 'corporation', 8 from aff where actor_id % 11 = 2),
b as (select kind, entity, min(bloc) as one, count(distinct bloc) as n from l group by all),
j as (select viewer, a.one as ab, coalesce(a.n, 0) as an, c.one as cb, coalesce(c.n, 0) as cn from w left join b a on a.kind = 'alliance' and a.entity = alliance left join b c on c.kind = 'corporation' and c.entity = corporation)
select viewer, case when an = 1 then ab when an = 0 and cn = 1 then cb end as bloc, case when an = 1 and cn = 1 and ab <> cb then 'medium' when an = 1 or (an = 0 and cn = 1) then 'high' else 'unresolved' end as confidence,
case when an = 1 and cn = 1 and ab <> cb then 'labels disagree' when an = 1 then 'alliance' when an > 1 then 'alliance ambiguous' when cn = 1 then 'corporation' when cn > 1 then 'corporation ambiguous' else 'no label' end as reason from j""")
def viewer_bloc(v: Views) -> DataFrame:
    a, c = F.col("alliance_id").cast("long"), (F.col("actor_id") % 11).cast("long")
    label = lambda when, kind, who, bloc: v.affiliations.where(when).select(F.lit(kind).alias("kind"), who.alias("entity"), bloc.cast("long").alias("bloc")).distinct()
    labels = label(a % 4 > 0, "alliance", a, a % 3).unionByName(label(a % 5 == 0, "alliance", a, F.lit(7)))
    labels = labels.unionByName(label(c < 9, "corporation", c, c % 3)).unionByName(label(c == 2, "corporation", c, F.lit(8)))
    return P.inferred_bloc(v.affiliations.select(F.col("actor_id").alias("viewer"), a.alias("alliance"), c.alias("corporation")), labels)


@query("g10_similar", """f as (select actor_id as id, count(distinct event_id)::double as f1, avg(damage)::double as f2, count(*) filter (where final_blow) / count(*) as f3, count(distinct type_id)::double as f4 from att group by all),
z as (select id, [(f1 - avg(f1) over ()) / greatest(stddev_pop(f1) over (), 1e-6), (f2 - avg(f2) over ()) / greatest(stddev_pop(f2) over (), 1e-6),
  (f3 - avg(f3) over ()) / greatest(stddev_pop(f3) over (), 1e-6), (f4 - avg(f4) over ()) / greatest(stddev_pop(f4) over (), 1e-6)] as z from f),
p as (select x.id, y.id as peer, round(list_cosine_similarity(x.z, y.z), 9) as score from z x join z y on x.id <> y.id)
select id, peer, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by id order by score desc, peer) as rank from p) where rank <= 10 and score >= 0.6""")
def similar(v: Views) -> DataFrame:
    f = v.actors.groupBy(F.col("actor_id").alias("id")).agg(
        F.countDistinct("event_id").cast("double").alias("f1"), F.avg(F.col("damage").cast("double")).alias("f2"), (F.count_if("final_blow") / count()).alias("f3"), F.countDistinct("type_id").cast("double").alias("f4")
    )
    return rounded(P.similar(f, ("f1", "f2", "f3", "f4"), top=10), "score", digits=6)


@query("g12_seed_neighbours", """f as (select actor_id as who, count(distinct event_id) as met, count(distinct type_id) as history from att group by all),
q as (select met, row_number() over (order by met) - 1 as i, count(*) over () as n from f), least_ as (select greatest(max(met) filter (where i = n * 9 // 10), 1) as m from q),
s as (select who from f, least_ where history >= 700 or met >= m), e as (select a as who, b as peer, w from links union all select b, a, w from links)
select who, count(distinct peer) as n, max(w) as best from e where peer in (select who from s) group by who""")
def seed_neighbours(v: Views) -> DataFrame:
    f = v.actors.groupBy(F.col("actor_id").alias("who")).agg(F.countDistinct("event_id").alias("met"), F.countDistinct("type_id").alias("history"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("who"), F.col("b").alias("peer")), F.struct(F.col("b").alias("who"), F.col("a").alias("peer"))))
    edges = v.links.select(ends.alias("e"), F.col("w").alias("score")).select("e.*", "score")
    return P.seed_neighbours(edges, P.seeds(f, 700))


@query("s17_chunk_lines", """t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as no from t),
o as (select doc_id, no, line, doc_id * 10 + coalesce(sum(strlen(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as line_offset from l)
select doc_id as id, no::int as no, line_offset::bigint as line_offset, md5(regexp_replace(line, '\\r$', '')) as line from o where regexp_matches(line, '[^\\x00\\x09-\\x0B\\x0D\\x20]')""")
def chunk_lines(v: Views) -> DataFrame:
    chunks = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), (F.col("doc_id") * 10).alias("start"))
    return lines.chunk_lines(chunks).withColumn("line", F.md5("line"))


@query("d2_headers", """select event_id as id, 'P ' || actor_id as listener, case when event_id % 2 = 0 then '2024.01.02 03:04:05' end as session_started, null::varchar as channel_id, 'C' || system_id as channel_name from lg""")
def headers(v: Views) -> DataFrame:
    started = F.when(F.col("event_id") % 2 == 0, "Session Started: 2024.01.02 03:04:05").otherwise("-----")
    says = [F.concat(F.lit("  Listener:  P "), "actor_id"), started, F.concat(F.lit("channel name: C"), "system_id"), F.lit("[ 2024.01.02 03:04:06 ] A > hi"), F.lit("Listener: other"), F.lit("Channel ID: late")]
    return lines.headers(v.log.select(F.col("event_id").alias("id"), F.concat_ws("\r\n", *says).alias("body")))


@query("a26_fingerprints", """r as (select actor_id as who, event_id, system_id, kind, value, floor(epoch(seen))::bigint - lag(floor(epoch(seen))::bigint) over (partition by actor_id, system_id order by seen) as gap from lg where actor_id is not null),
c as (select who, count(*) as n, count(distinct event_id) as incidents, count(*) filter (where kind = 'combat') as es, count(*) filter (where kind = 'notify') as di, count(*) filter (where value > 90) as ba,
  count(*) filter (where kind = 'fleet_message') as lo, count(*) filter (where event_id % 3 = 0) as fa, count(*) filter (where system_id is not null and gap <= 259200) as ca from r group by who having count(*) >= 2),
s as (select who, n, incidents, es / incidents as rapid_escalator, lo / n as heavy_logi_anchor, di / incidents as conservative_disengager, ba / incidents as bait_specialist, least(1, ca / (n - 1)) as corridor_camper, fa / n as fast_responder from c),
t as (select *, greatest(rapid_escalator, heavy_logi_anchor, conservative_disengager, bait_specialist, corridor_camper, fast_responder) as top from s)
select who, n, incidents, round(top, 8) as top, case when top >= 0.3e0 then case top when rapid_escalator then 'rapid_escalator' when heavy_logi_anchor then 'heavy_logi_anchor' when conservative_disengager then 'conservative_disengager'
  when bait_specialist then 'bait_specialist' when corridor_camper then 'corridor_camper' else 'fast_responder' end when n >= 5 then 'generalist' else 'undetermined' end as style,
case when n >= 30 then 'high' when n >= 10 then 'medium' when n >= 4 then 'low' else 'insufficient' end as confidence from t""")
def fingerprints(v: Views) -> DataFrame:
    of = lambda kind: F.col("kind") == kind
    rows = v.log.where("actor_id is not null").select(
        F.col("actor_id").alias("who"), F.col("system_id").alias("place"), "at", F.col("event_id").alias("incident"), of("combat").alias("escalated"), of("notify").alias("disengaged"),
        (F.col("value") > 90).alias("bait"), of("fleet_message").alias("big_logi"), (F.col("event_id") % 3 == 0).alias("fast"),
    )
    out = P.fingerprints(rows)
    styles = ("rapid_escalator", "heavy_logi_anchor", "conservative_disengager", "bait_specialist", "corridor_camper", "fast_responder")
    return out.select("who", "n", "incidents", F.round(F.greatest(*styles), 8).alias("top"), "style", "confidence")


@query("g20_sides", """e as (select event_id, killed_at::date as battle, victim_id, alliance_id as vic_all from ev join vic using (victim_id)),
p as (select battle, who, count(distinct id) as n from (select battle, alliance_id as who, actor_id as id from att join aff using (actor_id) join e using (event_id)) group by all),
k as (select battle, alliance_id as killer, vic_all as victim, count(*) as n from att join aff using (actor_id) join e using (event_id) where alliance_id <> vic_all group by all),
a as (select battle, who as a from p qualify row_number() over (partition by battle order by n desc, who) = 1),
m as (select battle, who, other, sum(n) as n from (select battle, killer as who, victim as other, n from k union all select battle, victim, killer, n from k) group by all),
b as (select battle, a, m.who as b from m join a using (battle) where other = a and (battle, m.who) in (select battle, who from p) qualify row_number() over (partition by battle order by n desc, m.who) = 1),
x as (select battle, who from p union select battle, who from m),
f as (select battle, x.who, a, b, coalesce(sum(n) filter (where other = b), 0) as fa, coalesce(sum(n) filter (where other = a), 0) as fb from x join b using (battle) left join m using (battle, who) group by all)
select battle, who, case when who = a then 'A' when who = b then 'B' when fa >= 3 and fa > 2 * fb then 'A' when fb >= 3 and fb > 2 * fa then 'B' else 'C' end as side from f""")
def battle_sides(v: Views) -> DataFrame:
    lost = v.events.join(v.victims, "victim_id").select("event_id", F.to_date("killed_at").alias("battle"), F.col("alliance_id").alias("victim"))
    there = v.actors.select("event_id", "actor_id").join(v.affiliations, "actor_id").join(lost, "event_id")
    pilots = there.groupBy("battle", F.col("alliance_id").alias("who")).agg(F.countDistinct("actor_id").alias("n"))
    kills = there.where("alliance_id <> victim").groupBy("battle", F.col("alliance_id").alias("killer"), "victim").agg(count().alias("n"))
    return P.sides(pilots, kills)


@query("m10_sell_advice", f"""r as (select type_id, type_id % 13 as listings, type_id % 3 as sell_listings, case when type_id % 17 > 0 then type_id % 11 / 10 end as rate, case when type_id % 5 > 0 then type_id % 29 end as days,
  type_id % 307 as sold, type_id % 4 * 3 as fill, type_id % 100 as region, type_id % 40 as open_, type_id % 90 as age from typ),
s as (select *, case when days < 7 then 'fast' when days <= 21 then 'medium' when days is not null then 'slow' end as velocity,
  round(0.4e0 * least(1, listings / 10) + 0.4e0 * least(1, sold / 200) + 0.2e0 * case when age <= 7 then 1 when age <= 30 then 0.7e0 when age <= 60 then 0.4e0 else 0.2e0 end, 9) as sure from r),
b as (select *, case when listings < 1 and sell_listings >= 1 then 'observing' when listings < 1 or rate is null then 'low_data' when rate >= 0.7e0 and listings < 2 then 'test_more' when rate >= 0.7e0 and velocity = 'slow' then 'slow_capital'
  when rate >= 0.7e0 then 'stock_more' when rate <= 0.3e0 and listings >= 2 then 'reduce' else 'hold' end as band,
  ceil((case when fill > 0 then fill when region > 0 then region * 0.05e0 end) * {RUNWAY})::bigint - open_ as wanted from s)
select type_id, velocity, case when sure >= 0.7e0 then 'high' when sure >= 0.4e0 then 'medium' else 'low' end as confidence, band,
case when band in ('stock_more', 'test_more', 'slow_capital') and wanted > 0 then wanted end as quantity from b""")
def sell_advice(v: Views) -> DataFrame:
    t = F.col("type_id")
    rows = v.types.select(
        "type_id", (t % 13).alias("listings"), (t % 3).alias("sell_listings"), F.when(t % 17 > 0, (t % 11) / 10).alias("rate"), F.when(t % 5 > 0, t % 29).alias("listing_days"), (t % 307).alias("units_sold"),
        (t % 4 * 3).alias("daily_fill"), (t % 100).alias("regional_volume"), (t % 40).alias("open_units"), (t % 90).alias("age_days"),
    )
    return P.sell_advice(rows, RUNWAY).select("type_id", "velocity", "confidence", "band", "quantity")
