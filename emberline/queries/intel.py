"""Pair signals, proximity joins, battle rollups, sources and stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import proximity as N
from ..schema import Views
from ..sources import nested, prices
from ..streaming import state
from .registry import query


def count():
    return F.count(F.lit(1))


def clusters(v: Views) -> DataFrame:
    """Activity of a system in an hour."""
    hour = F.expr("unix_timestamp(at) div 3600")
    return v.log.where("system_id is not null").groupBy(F.col("system_id").alias("place"), hour.alias("h")).agg(
        F.min("at").alias("started_at"), F.max("at").alias("ended_at")
    ).withColumn("id", F.concat_ws("-", "place", "h"))


CLUSTERS = """cl as (select system_id || '-' || (epoch(seen)::bigint // 3600) as id, system_id as place, min(seen) as started_at, max(seen) as ended_at
  from (select *, floor(epoch(seen))::bigint // 3600 as h from lg where system_id is not null) group by system_id, h, id)""".replace(
    "(epoch(seen)::bigint // 3600)", "(floor(epoch(seen))::bigint // 3600)"
)


@query("j14_confirmed_reports", """select r.event_id, r.actor_id, epoch_us(min(c.seen)) as confirmed_us from lg r
left join lg c on c.actor_id = r.actor_id and c.kind = 'combat' and date_trunc('second', c.seen) between date_trunc('second', r.seen) and date_trunc('second', r.seen) + interval 15 minutes
where r.kind = 'intel_report' group by all""")
def confirmed_reports(v: Views) -> DataFrame:
    reports = v.log.where("kind = 'intel_report'").select("event_id", "actor_id", "at")
    combat = v.log.where("kind = 'combat'").select("actor_id", "at")
    out = N.first_within(reports, combat.withColumnRenamed("at", "seen"), ["actor_id"], "at", "seen", 900, "confirmed")
    return out.select("event_id", "actor_id", F.unix_micros("confirmed").alias("confirmed_us"))


@query("j15_corridors", CLUSTERS + """, m as (select distinct system_id || '-' || (floor(epoch(seen))::bigint // 3600) as id, actor_id as member from lg where system_id is not null and actor_id is not null)
select distinct x.id as first, y.id as second from cl x join m a on a.id = x.id join m b on a.member = b.member join cl y on y.id = b.id
where x.place <> y.place and floor(epoch(y.started_at)) - floor(epoch(x.ended_at)) between 0 and 1800""")
def corridors(v: Views) -> DataFrame:
    members = v.log.where("system_id is not null and actor_id is not null").select(
        F.concat_ws("-", "system_id", F.expr("unix_timestamp(at) div 3600")).alias("id"), F.col("actor_id").alias("member")
    )
    return N.look_ahead(clusters(v), members.distinct(), 1800)


@query("j16_incident_cluster", CLUSTERS + """, met as (select event_id, id, abs(floor(epoch(seen)) - floor(epoch(started_at)))::bigint as gap from lg join cl on place = system_id
  where kind = 'notify' and floor(epoch(seen)) between floor(epoch(started_at)) - 900 and floor(epoch(ended_at)) + 900)
select event_id, id, gap from (select l.event_id, met.id, met.gap, row_number() over (partition by l.event_id order by met.gap, met.id) as rn
  from lg l left join met using (event_id) where l.kind = 'notify') where rn = 1""")
def incident_cluster(v: Views) -> DataFrame:
    points = v.log.where("kind = 'notify'").select(F.col("event_id").alias("point"), F.col("system_id").alias("place"), "at")
    out = N.nearest_overlap(points, clusters(v), 900, 3600)
    return out.select(F.col("point").alias("event_id"), "id", "gap")


@query("j17_links_of_alliance", """select alliance_id, count(distinct (a, b)) as n from links join aff on actor_id = a or actor_id = b group by all""")
def links_of_alliance(v: Views) -> DataFrame:
    ends = v.links.select("a", "b", F.explode(F.array("a", "b")).alias("actor_id"))
    hit = ends.join(v.affiliations, "actor_id").select("alliance_id", "a", "b").distinct()
    return hit.groupBy("alliance_id").agg(count().alias("n"))


@query("j18_within_distance", """p as (select type_id as id, (type_id % 97)::double as x, (type_id * 7 % 89)::double as y, size::double as z from typ)
select a.id as a, b.id as b, round(sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2), 9) as distance from p a join p b on a.id < b.id
where sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2) <= 6""")
def within_distance(v: Views) -> DataFrame:
    axis = lambda c: c.cast("double")
    points = v.types.select(F.col("type_id").alias("id"), axis(F.col("type_id") % 97).alias("x"), axis(F.col("type_id") * 7 % 89).alias("y"), axis(F.col("size")).alias("z"))
    return N.within_distance(points, 6.0, 9)


@query("w16_rate_drops", """b as (select system_id, floor(epoch(seen))::bigint // 3600 as bin, count(*) as n from lg where system_id is not null group by all),
s as (select system_id, unnest(range(min(bin), max(bin) + 1)) as bin from b group by system_id),
f as (select s.system_id, s.bin, coalesce(n, 0) as n from s left join b using (system_id, bin)),
r as (select system_id, bin, sum(n) over (partition by system_id order by bin rows between 5 preceding and 1 preceding)::bigint as before,
  sum(n) over (partition by system_id order by bin rows between current row and 4 following)::bigint as after from f)
select * from r where before >= 5 and after <= 0.3 * before""")
def rate_drops(v: Views) -> DataFrame:
    return N.rate_drops(v.log.where("system_id is not null"), "system_id", "at", 3600, 5, 1.0, 0.7).withColumns({"before": F.col("before").cast("long"), "after": F.col("after").cast("long")})


@query("w17_crash_symptoms", """t as (select actor_id, floor(epoch(seen))::bigint as last_second from lg where actor_id is not null),
g as (select *, lead(last_second) over (partition by actor_id order by last_second) - last_second as gap,
  count(*) over (partition by actor_id order by last_second range between 3600 preceding and current row) as n from t)
select * from g where gap >= 1800 and n >= 3""")
def crash_symptoms(v: Views) -> DataFrame:
    return N.crash_symptoms(v.log.where("actor_id is not null"), "actor_id", "at", 1800, 3)


def sides(v: Views, min_pilots: int = 5, top: int = 30) -> DataFrame:
    """(event_id, side, alliance_id): alliances with enough pilots on a side, the largest of each side."""
    pilots = v.actors.join(v.affiliations, "actor_id").groupBy("event_id", (F.col("slot") % 2).alias("side"), "alliance_id").agg(F.countDistinct("actor_id").alias("n"))
    rank = F.row_number().over(W.partitionBy("event_id", "side").orderBy(F.desc("n"), "alliance_id"))
    return pilots.where(F.col("n") >= min_pilots).withColumn("rn", rank).where(F.col("rn") <= top).select("event_id", "side", "alliance_id")


SIDES = """sd as (select distinct event_id, slot % 2 as side, alliance_id from att join aff using (actor_id))"""


def affinity(v: Views, half_life_days: float = 90.0, least: int = 5, min_pilots: int = 5) -> DataFrame:
    """Pairs of alliances: shares of their decayed meetings on one side and on opposite ones."""
    s = sides(v, min_pilots)
    x, y = s.toDF("event_id", "sx", "a"), s.toDF("event_id", "sy", "b")
    met = x.join(y, "event_id").where("a < b").select("event_id", "a", "b", (F.col("sx") == F.col("sy")).alias("same"))
    at = v.events.select("event_id", ((F.unix_timestamp(F.lit("1998-12-31").cast("timestamp")) - F.unix_timestamp("killed_at")) / 86400).alias("age"))
    w = F.pow(F.lit(0.5), F.col("age") / half_life_days)
    out = met.join(at, "event_id").withColumn("w", w).groupBy("a", "b").agg(
        count().alias("n"), F.sum("w").alias("all"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("w_same")
    )
    r = lambda c: F.round(c, 6)
    return out.where(F.col("n") >= least).select(
        "a", "b", "n", r(F.col("w_same") / F.col("all")).alias("affinity"), r(1 - F.col("w_same") / F.col("all")).alias("hostility"),
        r(F.least(F.lit(1.0), F.log10("n") / 2)).alias("confidence"),
    )


@query("a7_affinity", SIDES + """, m as (select x.event_id, x.alliance_id as a, y.alliance_id as b, x.side = y.side as same,
  power(0.5, (epoch(timestamp '1998-12-31') - epoch(killed_at)) / 86400 / 3650) as w
  from sd x join sd y using (event_id) join ev using (event_id) where x.alliance_id < y.alliance_id)
select a, b, count(*) as n, round(coalesce(sum(w) filter (where same), 0) / sum(w), 6) as affinity,
round(1 - coalesce(sum(w) filter (where same), 0) / sum(w), 6) as hostility, round(least(1.0, log10(count(*)) / 2), 6) as confidence
from m group by all having count(*) >= 5""")
def affinities(v: Views) -> DataFrame:
    return affinity(v, half_life_days=3650.0, min_pilots=1)


@query("a11_side_rollup", """select type_id, is_buy, round(case when is_buy then max(price) else min(price) end, 2)::double as best,
case when sum(remain) = 0 then (case when is_buy then max(price) else min(price) end)::double else sum((price * remain)::decimal(38,2))::double / sum(remain)::double end as vwap,
sum(remain)::bigint as volume, count(*) as orders from mkt group by type_id, is_buy""")
def side_rollup(v: Views) -> DataFrame:
    best = F.when(F.col("is_buy"), F.max("price")).otherwise(F.min("price"))
    worth = F.sum((F.col("price") * F.col("remain")).cast("decimal(38,2)")).cast("double")
    vwap = F.when(F.sum("remain") == 0, best.cast("double")).otherwise(worth / F.sum("remain"))
    return v.market.groupBy("type_id", "is_buy").agg(best.cast("double").alias("best"), vwap.alias("vwap"), F.sum("remain").alias("volume"), count().alias("orders"))


@query("a15_core_modules", """o as (select actor_id, count(distinct event_id) as obs from att group by all),
m as (select actor_id, type_id, count(distinct event_id) as seen, sum(damage) / count(*) as q from att group by all)
select actor_id, type_id, round(seen / obs, 8) as freq, floor(q + 0.5)::bigint as qty, round(1 - exp(-obs / 5.0), 8) as confidence
from m join o using (actor_id) where seen / obs >= 0.02""")
def frequent_modules(v: Views) -> DataFrame:
    return core_modules(v, 0.02)


def core_modules(v: Views, cutoff: float = 0.80) -> DataFrame:
    """Modules in at least the cutoff of an actor's observations, with the usual quantity."""
    obs = v.actors.select("actor_id", "event_id").distinct().groupBy("actor_id").agg(count().alias("obs"))
    per = v.actors.groupBy("actor_id", "type_id").agg(F.countDistinct("event_id").alias("seen"), (F.sum("damage").cast("double") / count()).alias("q"))
    freq = F.col("seen") / F.col("obs")
    return per.join(obs, "actor_id").where(freq >= cutoff).select(
        "actor_id", "type_id", F.round(freq, 8).alias("freq"), F.floor(F.col("q") + 0.5).alias("qty"), F.round(1 - F.exp(-F.col("obs") / 5.0), 8).alias("confidence")
    )


@query("a19_baseline", """e as (select actor_id, event_id, sum(isk)::decimal(30,2) as x from att group by all),
r as (select *, row_number() over (partition by actor_id order by x) - 1 as i, count(*) over (partition by actor_id) as n from e),
s as (select *, 9 * (n - 1) // 10 + (case when 9 * (n - 1) % 10 > 5 or (9 * (n - 1) % 10 = 5 and 9 * (n - 1) // 10 % 2 = 1) then 1 else 0 end) as at90 from r)
select actor_id, any_value(n) as n, round(median(x::double), 4) as med, max(x::double) filter (where i = at90) as p90, sum(x)::double / count(*) as mean, round(stddev_pop(x::double), 3) as dev
from s group by actor_id having any_value(n) >= 10""")
def baseline(v: Views, least: int = 10) -> DataFrame:
    per = v.actors.groupBy("actor_id", "event_id").agg(F.sum("isk").cast("decimal(30,2)").alias("x"))
    x = F.col("x").cast("double")
    ranked = S.nearest_rank(F.sort_array(F.collect_list(x)), 0.9)
    mean = F.sum("x").cast("double") / count()
    out = per.groupBy("actor_id").agg(count().alias("n"), F.round(F.median(x), 4).alias("med"), ranked.alias("p90"), mean.alias("mean"), F.round(F.stddev_pop(x), 3).alias("dev"))
    return out.where(F.col("n") >= least)


@query("a21_mode", """select actor_id, type_group as mode, n as votes from (select *, row_number() over (partition by actor_id order by n desc, type_group) as rn
from (select actor_id, type_group, count(*) as n from att join typ using (type_id) group by all)) where rn = 1""")
def mode(v: Views) -> DataFrame:
    votes = v.actors.join(v.types, "type_id").groupBy("actor_id", "type_group").agg(count().alias("n"))
    best = votes.groupBy("actor_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "type_group")).alias("x"))
    return best.select("actor_id", F.col("x.type_group").alias("mode"), (-F.col("x.m")).alias("votes"))


@query("a22_system_day", """select system_id, seen::date as day, count(*) filter (where kind = 'combat') as combat, count(*) filter (where kind = 'fleet_message') as fleet_message,
count(*) filter (where kind = 'intel_report') as intel_report, count(*) filter (where kind = 'notify') as notify, count(distinct actor_id) filter (where kind = 'intel_report') as reporters,
count(distinct actor_id) as actors from lg where system_id is not null group by all""")
def system_day(v: Views) -> DataFrame:
    kinds = ("combat", "fleet_message", "intel_report", "notify")
    return v.log.where("system_id is not null").groupBy("system_id", F.to_date("at").alias("day")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        F.countDistinct(F.when(F.col("kind") == "intel_report", F.col("actor_id"))).alias("reporters"),
        F.countDistinct("actor_id").alias("actors"),
    )


@query("a37_calibration", """p as (select status as truth, case when killed_at < timestamp '1995-06-17' then 'F' else 'O' end as guess from ev),
k as (select distinct truth as role from p union select guess from p),
c as (select role, count(*) filter (where truth = role and guess = role) as tp, count(*) filter (where truth <> role and guess = role) as fp,
  count(*) filter (where truth = role and guess <> role) as fn from k join p on truth = role or guess = role group by role)
select role, tp, fp, fn, round(tp / nullif(tp + fp, 0), 8) as prec, round(tp / nullif(tp + fn, 0), 8) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) as f1 from c""")
def calibration(v: Views) -> DataFrame:
    cut = F.lit("1995-06-17").cast("timestamp")
    told = v.events.select(F.col("status").alias("truth"), F.when(F.col("killed_at") < cut, "F").otherwise("O").alias("guess"))
    each = told.groupBy("truth", "guess").agg(count().alias("n")).select("truth", "guess", "n", F.explode(F.array_distinct(F.array("truth", "guess"))).alias("role"))
    hit, said = F.col("truth") == F.col("role"), F.col("guess") == F.col("role")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = each.groupBy("role").agg(n(hit & said).alias("tp"), n(~hit & said).alias("fp"), n(hit & ~said).alias("fn"))
    share = lambda a, b: F.round(F.try_divide(a, b), 8)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"prec": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


@query("w7_death_rank", """d as (select date_trunc('month', killed_at)::date as battle, victim_id, row_number() over (partition by date_trunc('month', killed_at) order by killed_at, event_id) - 1 as i from ev),
m as (select battle, victim_id, min(i) as i from d group by all)
select battle, victim_id, round(least(1, greatest(0, i / greatest(1, count(*) over (partition by battle) - 1))), 8) as rank from m""")
def death_rank(v: Views) -> DataFrame:
    battle = F.to_date(F.date_trunc("month", "killed_at"))
    i = F.row_number().over(W.partitionBy("battle").orderBy("killed_at", "event_id")) - 1
    first = v.events.withColumn("battle", battle).withColumn("i", i).groupBy("battle", "victim_id").agg(F.min("i").alias("i"))
    deaths = first.groupBy("battle").agg(count().alias("n"))
    out = first.join(deaths, "battle")
    return out.select("battle", "victim_id", F.round(S.clamp01(F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)), 8).alias("rank"))


@query("w13_transitions", """m as (select victim_id, date_trunc('year', killed_at)::date as y, max(band) as band from ev group by all),
t as (select *, lag(band) over (partition by victim_id order by y) as was from m)
select was, band, case when was = band then 'same' when band > was then 'down' else 'up' end as kind, count(*) as n from t where was is not null group by all""")
def transitions(v: Views) -> DataFrame:
    per = v.events.groupBy("victim_id", F.date_trunc("year", "killed_at").alias("y")).agg(F.max("band").alias("band"))
    out = per.withColumn("was", F.lag("band").over(W.partitionBy("victim_id").orderBy("y"))).where("was is not null")
    kind = F.when(F.col("was") == F.col("band"), "same").when(F.col("band") > F.col("was"), "down").otherwise("up")
    return out.groupBy("was", "band", kind.alias("kind")).agg(count().alias("n"))


@query("w15_tightest_scope", """s as (select type_id, 1 as scope, actor_id as owner, count(*) as n from att group by all having count(*) >= 10
union all select type_id, 2, alliance_id, count(*) from att join aff using (actor_id) group by all having count(*) >= 12 union all
select type_id, 3, bloc_id, count(*) from att join aff using (actor_id) group by all)
select type_id, scope, owner, n from (select *, dense_rank() over (partition by type_id order by scope) as tight,
  row_number() over (partition by type_id, scope order by n desc, owner) as rn from s) where tight = 1 and rn <= 2""")
def tightest_scope(v: Views) -> DataFrame:
    rows = v.actors.join(v.affiliations, "actor_id")
    per = lambda scope, owner, least: rows.groupBy("type_id", F.col(owner).alias("owner")).agg(count().alias("n")).where(F.col("n") >= least).withColumn("scope", F.lit(scope))
    both = per(1, "actor_id", 10).unionByName(per(2, "alliance_id", 12)).unionByName(per(3, "bloc_id", 1))
    w = W.partitionBy("type_id")
    out = both.withColumns({"tight": F.min("scope").over(w), "rn": F.row_number().over(W.partitionBy("type_id", "scope").orderBy(F.desc("n"), "owner"))})
    return out.where("scope = tight and rn <= 2").select("type_id", "scope", "owner", "n")


@query("o2_o3_ordered_bands", """select band, status, n, row_number() over (order by case when band = '5-LOW' then 0 else 1 end,
  case status when 'P' then 1 when 'F' then 2 when 'O' then 3 else 0 end, n desc, band) as place from (select band, status, count(*) as n from ev group by all)""")
def ordered_bands(v: Views) -> DataFrame:
    """A band pinned to the top, then statuses in their own order. One row per pair of the two enums."""
    n = v.events.groupBy("band", "status").agg(count().alias("n"))
    own = S.ladder_rank(F.col("status"), ("P", "F", "O"))
    pinned = F.when(F.col("band") == "5-LOW", 0).otherwise(1)
    return n.withColumn("place", F.row_number().over(W.orderBy(pinned, F.coalesce(own + 1, F.lit(0)), F.desc("n"), "band")))


@query("o6_set_algebra", """a as (select distinct type_id from att where slot = 1), b as (select distinct type_id from att where slot = 7)
select 'only first' as part, count(*) as n from a where type_id not in (select type_id from b) union all
select 'only last', count(*) from b where type_id not in (select type_id from a) union all select 'both', count(*) from a join b using (type_id)""")
def set_algebra(v: Views) -> DataFrame:
    slot = F.col("slot")
    held = v.actors.where(slot.isin(1, 7)).groupBy("type_id").agg(F.bool_or(slot == 1).alias("a"), F.bool_or(slot == 7).alias("b"))
    part = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only first").otherwise("only last")
    every = v.spark.createDataFrame([("both",), ("only first",), ("only last",)], "part string")
    return every.join(held.groupBy(part.alias("part")).agg(count().alias("n")), "part", "left").fillna(0, "n")


@query("g8_size_tiers", """n as (select date_trunc('month', killed_at)::date as battle, count(distinct actor_id) as n from att join ev using (event_id) group by all)
select battle, n, case when n <= 10 then 'small' when n <= 500 then 'medium' when n <= 2000 then 'large' else 'huge' end as tier from n""")
def size_tiers(v: Views) -> DataFrame:
    at = v.events.select("event_id", F.to_date(F.date_trunc("month", "killed_at")).alias("battle"))
    n = v.actors.select("event_id", "actor_id").join(at, "event_id").groupBy("battle").agg(F.countDistinct("actor_id").alias("n"))
    return n.withColumn("tier", F.when(F.col("n") <= 10, "small").when(F.col("n") <= 500, "medium").when(F.col("n") <= 2000, "large").otherwise("huge"))


@query("g16_bloc_edges", """select least(x.bloc_id, y.bloc_id) as r1, greatest(x.bloc_id, y.bloc_id) as r2, count(*) as n from links
join aff x on x.actor_id = a join aff y on y.actor_id = b where x.bloc_id <> y.bloc_id group by all""")
def bloc_edges(v: Views) -> DataFrame:
    side = lambda end, name: v.affiliations.select(F.col("actor_id").alias(end), F.col("bloc_id").alias(name))
    met = v.links.join(side("a", "x"), "a").join(side("b", "y"), "b").where("x <> y")
    return met.groupBy(F.least("x", "y").alias("r1"), F.greatest("x", "y").alias("r2")).agg(count().alias("n"))


@query("g18_top_peers", """e as (select a as actor_id, b as peer, w from links union all select b, a, w from links)
select actor_id, peer, w, rn::int as rank from (select *, row_number() over (partition by actor_id order by w desc, peer) as rn from e) where rn <= 5""")
def top_peers(v: Views) -> DataFrame:
    ends = v.links.select(F.explode(F.array(F.struct(F.col("a").alias("actor_id"), F.col("b").alias("peer"), "w"), F.struct(F.col("b").alias("actor_id"), F.col("a").alias("peer"), "w"))).alias("x")).select("x.*")
    return ends.withColumn("rank", F.row_number().over(W.partitionBy("actor_id").orderBy(F.desc("w"), "peer"))).where("rank <= 5")


@query("b2_hull_usage", """select role, who, type_id, count(*) as n from (select 'attacker' as role, actor_id as who, type_id from att
union all select 'victim', victim_id, type_id from ev join att using (event_id) where final_blow) group by all""")
def hull_usage(v: Views) -> DataFrame:
    lost = v.actors.where("final_blow").select("event_id", "type_id").join(v.events, "event_id")
    rows = v.actors.select(F.lit("attacker").alias("role"), F.col("actor_id").alias("who"), "type_id").unionByName(lost.select(F.lit("victim").alias("role"), F.col("victim_id").alias("who"), "type_id"))
    return rows.groupBy("role", "who", "type_id").agg(count().alias("n"))


@query("b3_losses", """d as (select event_id, sum(damage) as taken from att group by all)
select victim_id, sum(taken) as damage_taken, sum(total_value) as isk_lost, count(*) filter (where band <> '1-URGENT') as ships, count(*) filter (where band = '1-URGENT') as pods
from ev join d using (event_id) group by all""")
def losses(v: Views) -> DataFrame:
    taken = v.actors.groupBy("event_id").agg(F.sum("damage").alias("taken"))
    pod = F.col("band") == "1-URGENT"
    return v.events.join(taken, "event_id").groupBy("victim_id").agg(F.sum("taken").alias("damage_taken"), F.sum("total_value").alias("isk_lost"), F.count_if(~pod).alias("ships"), F.count_if(pod).alias("pods"))


@query("b6_side_totals", """select bloc_id as side, count(*) as kills, sum(total_value) as isk from ev join att using (event_id) join aff using (actor_id) where final_blow group by all""")
def side_totals(v: Views) -> DataFrame:
    """Kills and value of the side that struck the final blow."""
    blow = v.actors.where("final_blow").select("event_id", "actor_id").join(v.affiliations, "actor_id")
    return v.events.join(blow, "event_id").groupBy(F.col("bloc_id").alias("side")).agg(count().alias("kills"), F.sum("total_value").alias("isk"))


@query("b7_involvement", """select a.alliance_id, count(distinct event_id) as events from att join aff a using (actor_id) join ev using (event_id) join vic w using (victim_id)
where a.bloc_id <> w.bloc_id group by all""")
def involvement(v: Views) -> DataFrame:
    side = v.events.select("event_id", "victim_id").join(v.victims.select("victim_id", F.col("bloc_id").alias("lost")), "victim_id")
    there = v.actors.select("event_id", "actor_id").join(v.affiliations, "actor_id").select("event_id", "alliance_id", "bloc_id").distinct()
    return there.join(side, "event_id").where("bloc_id <> lost").groupBy("alliance_id").agg(count().alias("events"))


@query("b9_composition", """select bloc_id, type_group, count(*) as pilots from (select distinct actor_id, type_id from att) join aff using (actor_id) join typ using (type_id) group by all""")
def composition(v: Views) -> DataFrame:
    flown = v.actors.select("actor_id", "type_id").distinct()
    return flown.join(v.affiliations, "actor_id").join(v.types, "type_id").groupBy("bloc_id", "type_group").agg(count().alias("pilots"))


@query("b10_most_valuable", """select bloc_id, event_id, total_value, rn::int as rank from (select *, row_number() over (partition by bloc_id order by total_value desc, event_id) as rn
from ev join vic using (victim_id)) where rn <= 3""")
def most_valuable(v: Views) -> DataFrame:
    rows = v.events.select("event_id", "victim_id", "total_value").join(v.victims, "victim_id")
    rank = F.row_number().over(W.partitionBy("bloc_id").orderBy(F.desc("total_value"), "event_id"))
    return rows.withColumn("rank", rank).where("rank <= 3").select("bloc_id", "event_id", "total_value", "rank")


@query("b14_sessions", """t as (select distinct actor_id, floor(epoch(seen))::bigint as s from lg where actor_id is not null),
g as (select actor_id, s - lag(s) over (partition by actor_id order by s) as gap from t)
select actor_id, count(*) filter (where gap is null or gap > 3600) as sessions from g group by all""")
def sessions(v: Views) -> DataFrame:
    t = v.log.where("actor_id is not null").select("actor_id", F.unix_timestamp("at").alias("s")).distinct()
    gap = F.col("s") - F.lag("s").over(W.partitionBy("actor_id").orderBy("s"))
    return t.withColumn("gap", gap).groupBy("actor_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > 3600)).alias("sessions"))


@query("b20_fit_similarity", """c as (select actor_id, type_id, count(*) as n from att group by all), s as (select actor_id, sum(n) as n from c group by all),
m as (select x.actor_id as a, y.actor_id as b, sum(least(x.n, y.n)) as shared from c x join c y using (type_id) where x.actor_id < y.actor_id group by all)
select a, b, round(shared / (p.n + q.n - shared), 8) as similarity from m join s p on p.actor_id = a join s q on q.actor_id = b""")
def fit_similarity(v: Views) -> DataFrame:
    """Multiset Jaccard: the sum of minima over the sum of maxima, which is both sizes less the minima."""
    c = v.actors.where("actor_id is not null").repartition("actor_id").groupBy("actor_id", "type_id").agg(count().alias("n"))
    sized = c.withColumn("size", F.sum("n").over(W.partitionBy("actor_id"))).where("type_id is not null")
    # types near one another by number are often used by the same actors: their pairs are summed before they are sent, with the
    # sum of both sizes, so that no pair is sent again
    who = sized.groupBy("type_id").agg(F.sort_array(F.collect_list(F.struct("actor_id", "n", "size"))).alias("who")).repartitionByRange("type_id")
    x = who.select("who", F.posexplode("who").alias("at", "x")).select("x", F.explode(F.expr("slice(who, at + 2, size(who))")).alias("y"))
    out = x.groupBy(F.col("x.actor_id").alias("a"), F.col("y.actor_id").alias("b")).agg(F.sum(F.least("x.n", "y.n")).alias("both"), F.max(F.col("x.size") + F.col("y.size")).alias("all"))
    return out.select("a", "b", F.round(F.col("both") / (F.col("all") - F.col("both")), 8).alias("similarity"))


def _nested_json(v: Views) -> DataFrame:
    who = F.when(F.col("actor_id") % 3 > 0, F.col("actor_id"))
    a = F.struct(who.alias("character_id"), F.col("type_id").alias("ship_type_id"), F.col("damage").cast("long").alias("damage_done"), "final_blow")
    item = F.struct("type_id", F.col("slot").alias("flag"), F.col("damage").cast("long").alias("quantity_dropped"))
    per = v.actors.groupBy("event_id").agg(F.collect_list(a).alias("attackers"), F.collect_list(item).alias("items"))
    rows = v.events.join(per, "event_id")
    victim = F.struct(F.col("victim_id").alias("character_id"), "items")
    return rows.select(F.to_json(F.struct("event_id", F.date_format("killed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("killed_at"), victim.alias("victim"), "attackers")).alias("value"))


@query("s3_nested_events", """select event_id, count(*) as attackers, count(*) filter (where actor_id % 3 > 0) = 0 as is_npc, count(*) filter (where actor_id % 3 > 0) = 1 as is_solo,
any_value(victim_id) as victim_id, any_value(killed_at)::date as day, sum(damage::bigint)::bigint as damage, count(*) as items from ev join att using (event_id) group by event_id""")
def nested_events(v: Views) -> DataFrame:
    e = nested.parsed(_nested_json(v))
    hit = nested.attacker_rows(e).groupBy("event_id").agg(F.sum("damage_done").alias("damage"))
    items = nested.item_rows(e).groupBy("event_id").agg(count().alias("items"))
    rows = nested.event_rows(e).join(hit, "event_id").join(items, "event_id")
    return rows.select("event_id", F.col("attacker_count").cast("long").alias("attackers"), "is_npc", "is_solo", "victim_id", F.to_date("killed_at").alias("day"), "damage", "items")


@query("s6_days_to_load", """m as (select seen::date as day, count(*) as n from lg group by all), h as (select seen::date as day, count(*) as n from lg where kind <> 'combat' and dayofmonth(seen) <> 5 group by all)
select day, case when h.n is null then 'missing' when h.n < m.n then 'short' else 'recheck' end as reason from m left join h using (day)
where h.n is null or h.n < m.n or day >= date '2024-01-28'""")
def days_to_load(v: Views) -> DataFrame:
    per = lambda rows: rows.groupBy(F.to_date("at").alias("day")).agg(count().alias("n"))
    return prices.days_to_load(per(v.log), per(v.log.where("kind <> 'combat' and dayofmonth(at) <> 5")), "2024-01-28")


@query("s10_reconcile", """o as (select type_id as id, type_name as slug, type_id % 5 = 0 as locked, 1 as version from typ where type_id % 3 > 0),
n as (select 1000000 + type_id as id, type_name as slug, 2 as version from typ where type_id % 2 = 0)
select * from o where locked union all select coalesce(o.id, n.id), n.slug, false, n.version from n left join o using (slug) where not coalesce(locked, false)""")
def reconciled(v: Views) -> DataFrame:
    named = v.types.select("type_id", F.col("type_name").alias("slug"))
    old = named.where("type_id % 3 > 0").select(F.col("type_id").alias("id"), "slug", (F.col("type_id") % 5 == 0).alias("locked"), F.lit(1).alias("version"))
    new = named.where("type_id % 2 = 0").select((F.col("type_id") + 1000000).alias("id"), "slug", F.lit(2).alias("version"))
    return state.reconcile(old, new, "slug")


@query("s15_retention", """select count(*) filter (where kind = 'combat' and seen < timestamp '2024-01-31' - interval 7 days) as rule_0,
count(*) filter (where seen < timestamp '2024-01-31' - interval 14 days) as rule_1, count(*) filter (where value is null or value < 1) as rule_2 from lg""")
def retention(v: Views) -> DataFrame:
    rules = [state.Retention("at", 7, "kind = 'combat'"), state.Retention("at", 14), state.Retention("at", 0, "value is null or value < 1")]
    return state.dry_run(v.log, rules, F.lit("2024-01-31").cast("timestamp"))


@query("f5_f11_f15_states", """select event_id, case when killed_at is null then 'expired' when m <= 60 then 'fresh' when m <= 1440 then 'aging' when m <= 10080 then 'stale' else 'expired' end as state,
case band when '5-LOW' then 0 when '3-MEDIUM' then 1 when '2-HIGH' then 2 when '1-URGENT' then 3 end::int as severity,
round(case when status = 'P' then 1.0 else greatest(0.1, 1 - case when victim_id % 4 >= 2 then 1.0 else 0.5 end) end, 4)::double as weight
from (select *, (epoch(timestamp '1998-08-02') - epoch(killed_at)) / 60 as m from ev)""")
def states(v: Views) -> DataFrame:
    minutes = (F.unix_timestamp(F.lit("1998-08-02").cast("timestamp")) - F.unix_timestamp("killed_at")) / 60
    taint = S.faction_taint(F.when(F.col("status") != "P", F.col("victim_id")), (F.col("victim_id") % 4) / 4)
    return v.events.select(
        "event_id", S.freshness(minutes, ((60, "fresh"), (1440, "aging"), (10080, "stale"))).alias("state"),
        S.ladder_rank(F.col("band"), ("5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT")).alias("severity"), F.round(S.untainted(F.lit(1.0), taint), 4).alias("weight"),
    )
