"""Order-book rollups, consumption prices, sell-through, burn and hub comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import banded
from ..operators import aggregates as A
from ..schema import Views
from .registry import query


@query("a10_daily_book", """select epoch(observed_at::date::timestamp)::bigint as day, location_id, type_id, is_buy, min(price) as low, max(price) as high,
case when is_buy then max(price) else min(price) end as best, count(*) as n, count(distinct order_id) as orders, sum(remain)::bigint as volume,
floor(sum(price * remain)::double / sum(remain)::double * 1000 + 0.5)::bigint as vwap_mills from mkt group by observed_at::date, location_id, type_id, is_buy""")
def daily_book(v: Views) -> DataFrame:
    out = A.daily_book(v.market)
    return out.select(F.unix_timestamp(F.col("day").cast("timestamp")).alias("day"), "location_id", "type_id", "is_buy", "low", "high", "best", "n", "orders", "volume", F.floor(F.col("vwap") * 1000 + 0.5).alias("vwap_mills"))


@query("a12_consumption", """o as (select date_trunc('month', observed_at)::date as day, type_id, order_id % 50 as order_id, max(remain) - min(remain) as consumed, avg(price::double) as price from mkt group by all)
select epoch(day::timestamp)::bigint as day, type_id, round(sum(price * consumed) / sum(consumed), 3) as average, sum(consumed)::bigint as volume, count(*) as orders
from o where consumed > 0 group by all""")
def consumption(v: Views) -> DataFrame:
    out = A.consumption_ohlc(v.market.withColumn("observed_at", F.date_trunc("month", "observed_at")).withColumn("order_id", F.col("order_id") % 50))
    return out.select(F.unix_timestamp(F.col("day").cast("timestamp")).alias("day"), "type_id", F.round("average", 3).alias("average"), "volume", "orders")


@query("a13_sell_through", """select location_id, count(*) as listings, round(avg((remain < 10)::int), 6) as sell_through, round(quantile_cont(price::double, 0.25), 4) as p25,
round(quantile_cont(price::double, 0.5), 4) as p50, round(quantile_cont(price::double, 0.75), 4) as p75 from mkt where not is_buy group by all""")
def sell_through(v: Views) -> DataFrame:
    p = lambda q: F.round(F.percentile(F.col("price").cast("double"), q), 4).alias(f"p{int(q * 100)}")
    sold = F.round(F.avg((F.col("remain") < 10).cast("int")), 6)
    return v.market.where("not is_buy").groupBy("location_id").agg(F.count(F.lit(1)).alias("listings"), sold.alias("sell_through"), p(0.25), p(0.5), p(0.75))


@query("a35_burn", """b as (select type_id, count(*) * 7 / 90.0 as weekly from att where seen_at >= timestamp '2000-10-01' and seen_at < timestamp '2000-12-30' group by all),
s as (select type_id, sum(remain)::bigint as stock from mkt where not is_buy and observed_at >= timestamp '2000-12-01' group by all)
select type_id, round(weekly::double, 6) as weekly, coalesce(stock, 0) as stock, ceil(weekly::double / 7 * 30)::bigint as target,
greatest(ceil(weekly::double / 7 * 30)::bigint - coalesce(stock, 0), 0) as deficit from b left join s using (type_id)""")
def burn(v: Views) -> DataFrame:
    lost = v.actors.where("seen_at >= timestamp'2000-10-01' and seen_at < timestamp'2000-12-30'").groupBy("type_id").agg((F.count(F.lit(1)) * 7 / F.lit(90.0)).alias("weekly"))
    stock = v.market.where("not is_buy and observed_at >= timestamp'2000-12-01'").groupBy("type_id").agg(F.sum("remain").alias("stock"))
    out = lost.join(stock, "type_id", "left").na.fill({"stock": 0}).withColumn("target", F.ceil(F.col("weekly") / 7 * 30))
    return out.select("type_id", F.round("weekly", 6).alias("weekly"), "stock", "target", F.greatest(F.col("target") - F.col("stock"), F.lit(0)).alias("deficit"))


@query("f14_price_signal", """m as (select type_id, avg(price::double) as mean from mkt where not is_buy group by all)
select case when mean / base_price::double >= 1.2 then 'premium' when mean / base_price::double >= 0.9 then 'aligned' else 'underpriced' end as signal, count(*) as n
from m join typ using (type_id) group by all""")
def price_signal(v: Views) -> DataFrame:
    m = v.market.where("not is_buy").groupBy("type_id").agg(F.avg(F.col("price").cast("double")).alias("mean")).join(v.types, "type_id")
    signal = banded(F.col("mean") / F.col("base_price").cast("double"), [(1.2, "premium"), (0.9, "aligned")], "underpriced")
    return m.groupBy(signal.alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query("m14_hub_comparison", """l as (select type_id, location_id, max_by(price, (observed_at, order_id, price)) as price from mkt where not is_buy and location_id in (1, 2) group by all)
select coalesce(a.type_id, b.type_id) as type_id, a.price as here, b.price as there, round(a.price::double / b.price::double - 1, 6) as markup,
case when a.type_id is null then 'missing' when b.type_id is null then 'only' else 'both' end as state
from (select * from l where location_id = 1) a full join (select * from l where location_id = 2) b on a.type_id = b.type_id""")
def hubs(v: Views) -> DataFrame:
    m = v.market.where("not is_buy and location_id in (1, 2)").groupBy("type_id", "location_id").agg(F.max_by("price", F.struct("observed_at", "order_id", "price")).alias("price"))
    side = lambda k, name: m.where(F.col("location_id") == k).select("type_id", F.col("price").alias(name))
    out = side(1, "here").join(side(2, "there"), "type_id", "full")
    state = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "only").otherwise("both")
    return out.select("type_id", "here", "there", F.round(F.col("here").cast("double") / F.col("there").cast("double") - 1, 6).alias("markup"), state.alias("state"))
