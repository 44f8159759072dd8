"""Registered queries on anchor windows over orders: entity is the customer, the anchor exogenous."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import event_windows as ew
from ..sources.tables import table


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"))


def order_anchors(spark: SparkSession, sf: str) -> DataFrame:
    e = order_events(spark, sf)
    seen = e.groupBy("entity").agg(F.min("day").alias("first_seen"))
    last = e.agg(F.max("day").alias("last_seen"))
    return seen.crossJoin(F.broadcast(last)).withColumn("anchor", F.expr("date_add(DATE'1997-01-01', cast((entity * 37) % 1200 as int))"))


def counted(spark: SparkSession, sf: str, widths: list[int]) -> DataFrame:
    return ew.counts(ew.bounds(order_anchors(spark, sf), widths), order_events(spark, sf))


def rated(spark: SparkSession, sf: str, widths: list[int]) -> DataFrame:
    return ew.rates(counted(spark, sf, widths))


WIDTHS = [30, 60, 90, 180]


def _sql(widths: list[int], tail: str) -> str:
    return f"""
with ev as (select o_custkey as entity, o_orderdate::date as day from orders),
a as (select entity, min(day) as first_seen, date '1997-01-01' + ((entity * 37) % 1200)::int as anchor from ev group by entity),
b as (select entity, first_seen, l.last_seen, anchor, w.width, anchor - w.width as near_from, least(anchor + w.width, l.last_seen) as near_to,
  greatest(anchor - w.width - 365, first_seen) as base_from, anchor - w.width as base_to
  from a, (select max(day) as last_seen from ev) l, (select unnest({widths}) as width) w),
d as (select *, greatest(near_to - near_from, 0) as near_days, greatest(base_to - base_from, 0) as base_days from b),
c as (select d.*, count(*) filter (ev.day between near_from and near_to) as near,
  count(*) filter (ev.day between near_from and near_to and ev.day <= anchor) as near_pre,
  count(*) filter (ev.day between near_from and near_to and ev.day > anchor) as near_post,
  count(*) filter (ev.day between base_from and base_to) as base
  from d left join ev using (entity) group by all),
r as (select *, near / (near_days / 30.44::double) as near_rate, base / (base_days / 30.44::double) as base_rate from c where near_days >= 30 and base_days >= 90),
q as (select *, (near_rate + 0.01) / (base_rate + 0.01) as ratio from r where near_rate > 0 or base_rate > 0),
t as (select width, count(*) as n, count(*) filter (near_rate > base_rate) as up, count(*) filter (near_rate < base_rate) as down, exp(avg(ln(ratio))) as geo_ratio from q group by width),
p as (select t.*, case when up + down = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))) from unnest(range(0, least(up, down) + 1)) u(i))) end as sign_p from t)
{tail}"""


TEST = "n, up, down, round(geo_ratio, 6) as geo_ratio, round(sign_p, 6) as sign_p"


def _tested(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", "up", "down", F.round("geo_ratio", 6).alias("geo_ratio"), F.round("sign_p", 6).alias("sign_p"))


def ew_anchor_rate_test(spark, sf):
    return _tested(ew.rate_test(rated(spark, sf, [90])))


QUERIES = {"ew_anchor_rate_test": ew_anchor_rate_test}
ORACLES = {"ew_anchor_rate_test": _sql([90], f"select {TEST} from p")}
