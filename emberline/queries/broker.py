"""Questions answered through the plan IR."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import betweenness, catchments, degrees, hops, pagerank, triangles
from ..plans.compile import answer, search_documents
from ..plans.ir import Entity, Plan, parse
from ..schema import Views
from .registry import query

#: "Now" of the stored events.
NOW = datetime(2001, 12, 31, tzinfo=timezone.utc)

DOCS_SQL = """
fb as (select event_id, min({'a': actor_id, 't': type_id, 'l': alliance_id}) filter (where final_blow) as fb
  from att left join aff using (actor_id) group by event_id),
docs as (select ev.*, fb.fb.a as fb_actor_id, fb.fb.l as fb_alliance_id, type_name as fb_type_name, type_group as fb_group,
  vic.alliance_id as victim_alliance_id, segment as victim_segment
  from ev left join fb using (event_id) left join vic using (victim_id) left join typ on typ.type_id = fb.fb.t)
"""


@query("p3_top_n", DOCS_SQL + """select fb_type_name as key, sum(total_value) as value from docs
where victim_segment = 'BUILDING' and fb_type_name is not null group by all order by value desc, key limit 10""")
def top_ships(v: Views) -> DataFrame:
    p = Plan("top_n", "sum_isk", Entity("attacker", "type"), (Entity("victim", "segment", "eq", "BUILDING"),), limit=10)
    return answer(v, p, NOW)


@query("p3_top_n_average", DOCS_SQL + """select fb_alliance_id as key, round(avg(total_value::double), 4) as value from docs
where fb_alliance_id is not null and (victim_segment <> 'MACHINERY' or victim_segment is null)
  and killed_at >= timestamp '1998-01-01' group by all order by value desc, key limit 5""")
def top_alliances(v: Views) -> DataFrame:
    p = Plan("top_n", "avg_isk", Entity("attacker", "alliance"), (Entity("victim", "segment", "ne", "MACHINERY"),), since="1998-01-01", limit=5)
    return answer(v, p, NOW)


@query("p3_count", """select count(*) as value from ev where event_id in (select event_id from att join aff using (actor_id) where alliance_id in (3, 7))
and killed_at >= timestamp '2001-12-31' - interval 900 day""")
def count_events(v: Views) -> DataFrame:
    return answer(v, Plan("count", filters=(Entity("attacker", "alliance", "in", [3, 7]),), since="now-900d"), NOW)


@query("p3_trend", """f as (select time_bucket(interval 7 day, killed_at, timestamp '1970-01-01') as b, count(*) as n from ev
  where victim_id in (3, 8, 21, 34) group by 1)
select epoch(t.b)::bigint as bucket, coalesce(f.n, 0) as value
from (select unnest(generate_series(min(b), max(b), interval 7 day)) as b from f) t left join f using (b)""")
def trend(v: Views) -> DataFrame:
    p = Plan("trend", filters=(Entity("victim", "actor", "in", [3, 8, 21, 34]),), interval="7 days")
    return answer(v, p, NOW).select(F.unix_timestamp("at").alias("bucket"), "value")


@query("p3_list", DOCS_SQL + """select event_id, victim_id, fb_type_name, total_value from docs
where victim_alliance_id = 4 order by killed_at desc, event_id desc limit 25""")
def listing(v: Views) -> DataFrame:
    return answer(v, Plan("list", filters=(Entity("victim", "alliance", "eq", 4),), limit=25), NOW).drop("killed_at")


@query("p4_lookup", "select type_id as id, type_name as name, category from typ where lower(type_name) = 'small ring' order by id limit 50")
def lookup(v: Views) -> DataFrame:
    return answer(v, Plan("lookup", subject=Entity("any", "type", "eq", "Small Ring"), limit=50), NOW)


@query("p5_path", """arcs as (select a, b from links union select b, a from links),
walk as (select 1::bigint as id, 0 as hops union select arcs.b, hops + 1 from walk join arcs on arcs.a = walk.id where hops < 6)
select min(hops) as hops from walk where id = 50 having min(hops) is not null""")
def path(v: Views) -> DataFrame:
    return answer(v, parse("path from 1 to 50"), NOW).select("hops")


@query("p5_neighbors", """arcs as (select a, b from links union select b, a from links),
walk as (select 1::bigint as id, 0 as hops union select arcs.b, hops + 1 from walk join arcs on arcs.a = walk.id where hops < 6)
select id, min(hops) as hops from walk group by id having min(hops) > 0""")
def neighbors(v: Views) -> DataFrame:
    return answer(v, parse("neighbours of 1"), NOW)


@query("p7_question", DOCS_SQL + """select fb_type_name as key, count(*) as value from docs
where victim_segment = 'BUILDING' and killed_at >= timestamp '2001-12-31' - interval 900 day and fb_type_name is not null
group by all order by value desc, key limit 5""")
def question(v: Views) -> DataFrame:
    return answer(v, parse("Top 5 ships against building in the last 900 days?"), NOW)


@query("s11_search_documents", """select ev.event_id, count(distinct actor_id) as attackers, count(distinct alliance_id) as alliances,
min(actor_id) as first_attacker from ev left join att using (event_id) left join aff using (actor_id) group by ev.event_id""")
def documents(v: Views) -> DataFrame:
    out = search_documents(v)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(size(c)).cast("long")
    return out.select("event_id", n("attacker_ids").alias("attackers"), n("attacker_alliance_ids").alias("alliances"), F.get("attacker_ids", F.lit(0)).alias("first_attacker"))


@query("g3_degree", """arcs as (select a, w from links union all select b, w from links)
select a as id, count(*) as degree, sum(w) as strength from arcs group by a""")
def weighted_degree(v: Views) -> DataFrame:
    return degrees(v.links)


@query("g4_pagerank", """arcs as (select a, b, w from links union all select b, a, w from links),
p as (select a, b, w / sum(w) over (partition by a) as p from arcs),
r as (select distinct a as id, 0.15::double as rank, 0 as i from p
  union all select * from (select p.b as id, 0.15 + 0.85 * sum(p.p * r.rank) as rank, max(r.i) + 1 as i from r join p on p.a = r.id
    where r.i < 20 group by p.b))
select id, round(rank, 6) as rank from r where i = 20""")
def ranks(v: Views) -> DataFrame:
    return pagerank(v.links).select("id", F.round("rank", 6).alias("rank"))


@query("g6_triangles", """arcs as (select a, b from links)
select id, count(*) as triangles from (select unnest([x.a, x.b, y.b]) as id
  from arcs x join arcs y on x.b = y.a join arcs z on z.a = x.a and z.b = y.b) group by id""")
def triangle_counts(v: Views) -> DataFrame:
    return triangles(v.links)


@query("g15_catchments", """arcs as (select a, b from links union select b, a from links),
walk as (select h as id, h as hub, 0 as jumps from (values (5::bigint), (17), (60)) t(h)
  union select arcs.b, hub, jumps + 1 from walk join arcs on arcs.a = walk.id where jumps < 8)
select id, hub, jumps from (select *, row_number() over (partition by id order by jumps, hub) as rn from walk) where rn = 1""")
def nearest_hubs(v: Views) -> DataFrame:
    hubs = v.spark.createDataFrame([(5,), (17,), (60,)], "id long")
    return catchments(v.links, hubs)


@query("g17_depths", """arcs as (select a, b from links union select b, a from links),
walk as (select h as id, 0 as hops from (values (5::bigint), (17)) t(h) union select arcs.b, hops + 1 from walk join arcs on arcs.a = walk.id where hops < 8)
select id, min(hops) as hops from walk group by id""")
def depths(v: Views) -> DataFrame:
    return hops(v.links, [5, 17], 8)


@query("g5_betweenness", """arc as (select a, b from links union select b, a from links), nd as (select distinct a as id from arc),
reach(source, id, d, paths) using key (source, id) as (select id, id, 0, 1.0::double from nd
  union all select r.source, arc.b, r.d + 1, sum(r.paths) from reach r join arc on arc.a = r.id
    where not exists (select 1 from recurring.reach o where o.source = r.source and o.id = arc.b) group by r.source, arc.b, r.d),
st as (select r.source as s, r.id as t, r.d, r.paths from reach r),
via as (select v.id, sum(x.paths * v.paths / st.paths) / 2 as score from st join reach x on x.source = st.s join reach v on v.source = st.t and v.id = x.id
  where x.d + v.d = st.d and x.d > 0 and v.d > 0 group by v.id)
select id, round(coalesce(score, 0), 6) as betweenness from nd left join via using (id)""")
def between(v: Views) -> DataFrame:
    return betweenness(v.links.select("a", "b")).select("id", F.round("betweenness", 6).alias("betweenness"))
