"""Joins, grouping and ranking over events, participants and affiliations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..schema import Views
from .registry import query

def count():
    return F.count(F.lit(1))



@query("f1_slot_category", """select case when f between 27 and 34 then 'high' when f between 19 and 26 then 'mid' when f between 11 and 18 then 'low'
  when f between 92 and 99 then 'rig' when f between 125 and 132 then 'subsystem' when f between 164 and 171 then 'service'
  when f = 87 then 'drone_bay' when f = 158 then 'fighter_bay' when f = 89 then 'implant'
  when f in (0, 5, 62, 90) or f between 133 and 156 then 'cargo' else 'other' end as slot, count(*) as n
from (select type_id % 180 as f from att) group by all""")
def slots(v: Views) -> DataFrame:
    return v.actors.groupBy(S.slot_of_flag(F.col("type_id") % 180).alias("slot")).agg(count().alias("n"))


@query("f9_slug_f13_digest", """select type_id, replace(replace(lower(type_name), ' ', '-'), '.', '') || '-199901020304' as slug,
md5(type_name) as md5, sha256(type_name || '|' || type_group) as sha from typ""")
def slugs(v: Views) -> DataFrame:
    at = F.lit("1999-01-02 03:04:00").cast("timestamp")
    return v.types.select("type_id", S.slug(F.col("type_name"), at).alias("slug"), F.md5("type_name").alias("md5"), F.sha2(F.concat_ws("|", "type_name", "type_group"), 256).alias("sha"))


@query("f16_f17_weights", """g as (select event_id, max(gang_size) as n, max(seen) as seen from gang group by event_id)
select event_id, round(power(0.5, (epoch(timestamp '2002-01-01') - epoch(seen)) / 31536000.0), 8) as decay, round(1 / sqrt(greatest(1, n)), 8) as damp,
round(greatest(0.15, sqrt(10) / sqrt(greatest(1, n))), 8) as theater_damp from g""")
def weights(v: Views) -> DataFrame:
    g = A.gangs(v.actors, v.events).groupBy("event_id").agg(F.max("gang_size").alias("n"), F.max("at").alias("at"))
    age = F.unix_timestamp(F.lit("2002-01-01").cast("timestamp")) - F.unix_timestamp("at")
    r = lambda c: F.round(c, 8)
    return g.select("event_id", r(S.recency_decay(age, 31536000)).alias("decay"), r(S.fleet_dampening(F.col("n"))).alias("damp"), r(S.theater_dampening(F.col("n"))).alias("theater_damp"))


@query("j1_j3_enriched", """select category, type_group, count(*) as n, sum(isk) as isk from att left join typ using (type_id) group by all""")
def enriched(v: Views) -> DataFrame:
    return v.actors.join(v.types, "type_id", "left").groupBy("category", "type_group").agg(count().alias("n"), F.sum("isk").alias("isk"))


@query("j4_peers", """select x.actor_id, count(distinct y.actor_id) as peers, count(*) as meetings from gang x join gang y using (event_id)
where x.actor_id <> y.actor_id group by all""")
def peers(v: Views) -> DataFrame:
    pairs = v.actors.select("event_id", "actor_id").distinct()
    met = A.co_occurrence(pairs, "event_id", "actor_id")
    both = met.select(F.explode(F.array(F.struct(F.col("a").alias("actor_id"), F.col("b").alias("p")), F.struct(F.col("b").alias("actor_id"), F.col("a").alias("p")))).alias("x")).select("x.*")
    return both.groupBy("actor_id", "p").agg(count().alias("n")).groupBy("actor_id").agg(count().alias("peers"), F.sum("n").alias("meetings"))


@query("j5_opposing_pairs", """select least(g.actor_id, victim_id) as a, greatest(g.actor_id, victim_id) as b, count(*) as n
from gang g join ev using (event_id) where g.actor_id <> victim_id group by all having count(*) >= 3""")
def opposing(v: Views) -> DataFrame:
    met = v.actors.select("event_id", "actor_id").distinct().join(v.events, "event_id").where("actor_id <> victim_id")
    a, b = S.unordered(F.col("actor_id"), F.col("victim_id"))
    return met.groupBy(a.alias("a"), b.alias("b")).agg(count().alias("n")).where("n >= 3")


@query("j6_j7_semi_anti", """select 'with' as kind, count(*) as n from ev where event_id in (select event_id from att where damage >= 49)
union all select 'without', count(*) from ev where event_id not in (select event_id from att where damage >= 49)""")
def semi_anti(v: Views) -> DataFrame:
    heavy = v.actors.where("damage >= 49").select("event_id")
    one = lambda how, name: v.events.join(heavy, "event_id", how).agg(count().alias("n")).select(F.lit(name).alias("kind"), "n")
    return one("left_semi", "with").unionByName(one("left_anti", "without"))


@query("j8_either_direction", """select ev.event_id from ev join vic using (victim_id) where
  (vic.bloc_id = 0 and exists (select 1 from att join aff using (actor_id) where att.event_id = ev.event_id and aff.bloc_id = 1))
  or (vic.bloc_id = 1 and exists (select 1 from att join aff using (actor_id) where att.event_id = ev.event_id and aff.bloc_id = 0))""")
def either(v: Views) -> DataFrame:
    sides = v.actors.join(v.affiliations, "actor_id").groupBy("event_id").agg(F.bool_or(F.col("bloc_id") == 0).alias("has0"), F.bool_or(F.col("bloc_id") == 1).alias("has1"))
    e = v.events.join(v.victims, "victim_id").join(sides, "event_id")
    return e.where("(bloc_id = 0 and has1) or (bloc_id = 1 and has0)").select("event_id")


@query("j9_not_in_nulls", """select count(*) as n from lg where system_id is null or system_id not in (1, 2, 3)""")
def not_in(v: Views) -> DataFrame:
    return v.log.where(S.not_in_or_null(F.col("system_id"), [1, 2, 3])).agg(count().alias("n"))


@query("j21_both_roles", """m as (select event_id, actor_id from att union select event_id, victim_id from ev)
select actor_id, count(*) as events from m group by all""")
def both_roles(v: Views) -> DataFrame:
    m = v.actors.select("event_id", "actor_id").union(v.events.select("event_id", "victim_id")).distinct()
    return m.groupBy("actor_id").agg(count().alias("events"))


@query("a1_activity", """select actor_id, count(*) as events, count(distinct seen::date) as active_days, round(avg(gang_size), 6) as avg_gang,
count(*) filter (where gang_size = 1) as solo, epoch(max(seen))::bigint as last_at from gang group by all""")
def activity(v: Views) -> DataFrame:
    return A.activity(A.gangs(v.actors, v.events), "actor_id")


@query("a2_dominant_category", """c as (select actor_id, category, count(*) as n from att join typ using (type_id) group by all),
s as (select *, n / sum(n) over (partition by actor_id) as share, row_number() over (partition by actor_id order by n desc, category) as rn from c)
select actor_id, case when share >= 0.15 then category end as dominant, round(share, 6) as share from s where rn = 1""")
def dominant_category(v: Views) -> DataFrame:
    c = v.actors.join(v.types, "type_id").groupBy("actor_id", "category").agg(count().alias("n"))
    return A.dominant(c, ["actor_id"], "category", "n", 0.15)


@query("a3_f10_hours", """h as (select actor_id, hour(seen) as h, count(*) as n from lg group by all), t as (select actor_id, sum(n) as t from h group by all)
select actor_id, round(sum(n / t * cos(2 * pi() * h / 24)), 3) as x, round(sum(n / t * sin(2 * pi() * h / 24)), 3) as y
from h join t using (actor_id) group by all""")
def hours(v: Views) -> DataFrame:
    bins = A.hour_histogram(v.log, "actor_id", "at")
    xy = bins.select("actor_id", S.circular_hour(F.col("bins")).alias("m"))
    return xy.select("actor_id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query("a5_churn", """select actor_id, count(distinct victim_alliance) as alliances, round(least(1, count(distinct victim_alliance) / greatest(1, max(days) / 30)), 6) as churn
from (select g.actor_id, vic.alliance_id as victim_alliance, date_diff('day', min(g.seen) over (partition by g.actor_id), max(g.seen) over (partition by g.actor_id))::double as days
  from gang g join ev using (event_id) join vic using (victim_id)) group by all""")
def churn(v: Views) -> DataFrame:
    met = A.gangs(v.actors, v.events).join(v.events.select("event_id", "victim_id"), "event_id").join(v.victims, "victim_id")
    out = met.groupBy("actor_id").agg(F.countDistinct("alliance_id").alias("alliances"), F.datediff(F.max("at"), F.min("at")).alias("days"))
    rate = F.col("alliances") / F.greatest(F.lit(1.0), F.col("days") / 30)
    return out.select("actor_id", "alliances", F.round(F.least(F.lit(1.0), rate), 6).alias("churn"))


@query("a18_loss_profile", """g as (select event_id, max(gang_size) as n from gang group by all)
select victim_id, count(*) as losses, count(*) filter (where n <= 5) as small_gang, count(*) filter (where n = 1) as solo,
count(*) filter (where total_value < 100000) as cheap, round(count(*) filter (where total_value < 100000) / count(*), 6) as cheap_rate
from ev left join g using (event_id) group by all""")
def loss_profile(v: Views) -> DataFrame:
    g = A.gangs(v.actors, v.events).groupBy("event_id").agg(F.max("gang_size").alias("size"))
    e = v.events.join(g, "event_id", "left")
    out = A.conditional_counts(e, ["victim_id"], {"losses": F.lit(True), "small_gang": F.col("size") <= 5, "solo": F.col("size") == 1, "cheap": F.col("total_value") < 100000})
    return out.withColumn("cheap_rate", F.round(F.col("cheap") / F.col("losses"), 6))


@query("a20_a21_weighted", """select type_id, round(sum(isk::double * damage::double) / sum(damage::double), 4) as mean_isk from att group by all""")
def weighted(v: Views) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return v.actors.groupBy("type_id").agg(F.round(A.weighted_mean(d("isk"), d("damage")), 4).alias("mean_isk"))


@query("w1_cheapest_five", """r as (select type_id, price, row_number() over (partition by type_id order by price) as rn from mkt where not is_buy)
select type_id, round(median(price::double), 4) as price, count(*) as n from r where rn <= 5 group by all""")
def cheapest(v: Views) -> DataFrame:
    five = A.first_per_group(v.market.where("not is_buy"), ["type_id"], F.col("price"), F.col("order_id"), n=5)
    return five.groupBy("type_id").agg(F.round(F.percentile(F.col("price").cast("double"), 0.5), 4).alias("price"), count().alias("n"))


@query("w2_latest_per_key", """select victim_id, max_by(event_id, (killed_at, event_id)) as event_id from ev group by all""")
def latest(v: Views) -> DataFrame:
    return A.first_per_group(v.events, ["victim_id"], F.desc("killed_at"), F.desc("event_id")).select("victim_id", "event_id")


@query("w8_cohort_percentile", """t as (select victim_id, bloc_id, sum(total_value) as value from ev join vic using (victim_id) group by all)
select x.victim_id, round((rank() over (partition by bloc_id order by value) - 1) / count(*) over (partition by bloc_id), 6) as pct from t x""")
def cohort_percentile(v: Views) -> DataFrame:
    t = v.events.join(v.victims, "victim_id").groupBy("victim_id", "bloc_id").agg(F.sum("total_value").alias("value"))
    return A.strict_percentile(t, "value", ["bloc_id"]).select("victim_id", "pct")


@query("w9_tiers", """t as (select actor_id, count(*) as n from gang group by all),
p as (select actor_id, 100 * (rank() over (order by n desc) - 1) / count(*) over () as top from t)
select actor_id, case when top < 1 then 'elite' when top < 5 then 'high' when top < 25 then 'good' else 'base' end as tier from p""")
def tiers(v: Views) -> DataFrame:
    t = A.gangs(v.actors, v.events).groupBy("actor_id").agg((-count()).alias("neg"))
    top = A.strict_percentile(t, "neg")
    tier = F.when(F.col("pct") < 0.01, "elite").when(F.col("pct") < 0.05, "high").when(F.col("pct") < 0.25, "good").otherwise("base")
    return top.select("actor_id", tier.alias("tier"))


@query("w10_w11_shares", """t as (select alliance_id, actor_id, sum(damage) as damage from att join aff using (actor_id) group by all)
select actor_id, round(damage::double / sum(damage::double) over w, 6) as share, round(damage::double / max(damage::double) over w, 6) as of_max
from t window w as (partition by alliance_id)""")
def shares(v: Views) -> DataFrame:
    t = v.actors.join(v.affiliations, "actor_id").groupBy("alliance_id", "actor_id").agg(F.sum("damage").cast("double").alias("damage"))
    return t.select("actor_id", F.round(A.share_of_group("damage", ["alliance_id"]), 6).alias("share"), F.round(A.over_group_max("damage", ["alliance_id"]), 6).alias("of_max"))


@query("w14_winner_gap", """t as (select victim_id, alliance_id, count(*) as n from gang join ev using (event_id) join aff using (actor_id) group by all),
r as (select *, row_number() over w as rn, lead(n) over w as next from t window w as (partition by victim_id order by n desc, alliance_id))
select victim_id, case when n - coalesce(next, 0) >= 2 then alliance_id end as winner, n - coalesce(next, 0) as gap from r where rn = 1""")
def winner(v: Views) -> DataFrame:
    t = A.gangs(v.actors, v.events).join(v.events.select("event_id", "victim_id"), "event_id").join(v.affiliations, "actor_id")
    t = t.groupBy("victim_id", "alliance_id").agg(count().alias("n"))
    w = W.partitionBy("victim_id").orderBy(F.desc("n"), "alliance_id")
    r = t.withColumns({"rn": F.row_number().over(w), "gap": F.col("n") - F.coalesce(F.lead("n").over(w), F.lit(0))}).where("rn = 1")
    return r.select("victim_id", F.when(F.col("gap") >= 2, F.col("alliance_id")).alias("winner"), "gap")


@query("w19_prior_window", """w as (select alliance_id, count(*) filter (where killed_at >= timestamp '2000-06-01') as now_n,
  count(*) filter (where killed_at < timestamp '2000-06-01') as was from ev join vic using (victim_id)
  where killed_at >= timestamp '2000-04-02' and killed_at < timestamp '2000-07-31' group by all)
select *, case when now_n < 5 then 'none' when now_n / greatest(was, 1) >= 4 then 'critical' when now_n / greatest(was, 1) >= 2.5 then 'high'
  when now_n / greatest(was, 1) >= 1.5 then 'medium' else 'none' end as severity from w""")
def prior_window(v: Views) -> DataFrame:
    e = v.events.where("killed_at >= timestamp'2000-04-02' and killed_at < timestamp'2000-07-31'").join(v.victims, "victim_id")
    mid = F.lit("2000-06-01").cast("timestamp")
    w = A.conditional_counts(e, ["alliance_id"], {"now_n": F.col("killed_at") >= mid, "was": F.col("killed_at") < mid})
    ratio = F.col("now_n") / F.greatest("was", F.lit(1))
    bands = S.banded(ratio, [(1.5, "medium"), (2.5, "high"), (4.0, "critical")], "none")
    return w.withColumn("severity", F.when(F.col("now_n") < 5, "none").otherwise(bands))


@query("g24_kill_matrix", """select aff.alliance_id as attacker, vic.alliance_id as victim, count(*) as n from gang join aff using (actor_id)
join ev using (event_id) join vic using (victim_id) group by all""")
def kill_matrix(v: Views) -> DataFrame:
    g = v.actors.select("event_id", "actor_id").distinct().join(v.affiliations.select("actor_id", F.col("alliance_id").alias("attacker")), "actor_id")
    e = v.events.join(v.victims, "victim_id").select("event_id", F.col("alliance_id").alias("victim"))
    return g.join(e, "event_id").groupBy("attacker", "victim").agg(count().alias("n"))


@query("a31_leaderboard", """k as (select 'kills' as board, actor_id as id, count(*)::decimal(20,2) as value from gang group by all),
l as (select 'losses' as board, victim_id as id, count(*)::decimal(20,2) as value from ev group by all),
i as (select 'isk_lost' as board, victim_id as id, sum(total_value)::decimal(20,2) as value from ev group by all)
select board, id, value, row_number() over (partition by board order by value desc, id)::int as rank
from (select * from k union all select * from l union all select * from i)
qualify row_number() over (partition by board order by value desc, id) <= 10""")
def leaderboard(v: Views) -> DataFrame:
    n = count().cast("decimal(20,2)").alias("value")
    kills = A.gangs(v.actors, v.events).groupBy(F.lit("kills").alias("board"), F.col("actor_id").alias("id")).agg(n)
    lost = v.events.groupBy(F.lit("losses").alias("board"), F.col("victim_id").alias("id")).agg(n)
    isk = v.events.groupBy(F.lit("isk_lost").alias("board"), F.col("victim_id").alias("id")).agg(F.sum("total_value").cast("decimal(20,2)").alias("value"))
    return A.first_per_group(kills.unionByName(lost).unionByName(isk), ["board"], F.desc("value"), F.asc("id"), n=10, rank="rank")


@query("a32_scoreboard", """select bloc_id, segment, count(*) as losses, sum(total_value) as isk, count(distinct victim_id) as victims from ev join vic using (victim_id) group by all""")
def scoreboard(v: Views) -> DataFrame:
    e = v.events.join(v.victims, "victim_id")
    return e.groupBy("bloc_id", "segment").agg(count().alias("losses"), F.sum("total_value").alias("isk"), F.countDistinct("victim_id").alias("victims"))


@query("b13_two_real_sides", """p as (select extract(year from seen) * 100 + extract(month from seen) as battle, alliance_id, count(distinct actor_id) as pilots
  from gang join aff using (actor_id) group by all)
select battle, count(*) as sides from p where pilots >= 3 group by battle having count(*) >= 2""")
def two_sides(v: Views) -> DataFrame:
    g = A.gangs(v.actors, v.events).join(v.affiliations, "actor_id").withColumn("battle", (F.year("at") * 100 + F.month("at")).cast("long"))
    sides = g.groupBy("battle", "alliance_id").agg(F.countDistinct("actor_id").alias("pilots")).where("pilots >= 3")
    return sides.groupBy("battle").agg(count().alias("sides")).where("sides >= 2")
