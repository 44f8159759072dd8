"""Windows round an anchor date: bounds, members, exposure, rates, and what changed between them.

Entities come with an exogenous anchor; events are dated. The near window runs from half days before the
anchor to half days after it, the base window the year before; both ends count, so the day where they
meet is in both, unless exclusive. Several widths are one pass: widths are a column of the anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sign_p

MONTH = 30.44


def bounds(anchors: DataFrame, widths: list[int], base_days: int = 365) -> DataFrame:
    """anchors (entity, anchor, first_seen, last_seen) with width and the days of both windows."""
    a = anchors.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    near = F.date_sub("anchor", F.col("width"))
    a = a.withColumn("near_from", near).withColumn("near_to", F.least(F.expr("date_add(anchor, width)"), F.col("last_seen")))
    a = a.withColumn("base_from", F.greatest(F.date_sub(near, base_days), F.col("first_seen"))).withColumn("base_to", near)
    return a.withColumn("near_days", F.greatest(F.datediff("near_to", "near_from"), F.lit(0))).withColumn("base_days", F.greatest(F.datediff("base_to", "base_from"), F.lit(0)))


def counts(bounded: DataFrame, events: DataFrame, exclusive: bool = False) -> DataFrame:
    """bounded with the numbers of events in each window, before, and after the anchor; entities without any count 0.

    events are (entity, day). They are first summed by entity and day, so a busy entity is few rows, and the
    range conditions are evaluated inside the aggregation rather than as a theta join.
    """
    by_day = events.groupBy("entity", "day").agg(F.count("*").alias("k"))
    j = bounded.join(by_day, "entity", "left")
    base = (F.col("day") >= F.col("base_from")) & ((F.col("day") < F.col("base_to")) if exclusive else (F.col("day") <= F.col("base_to")))
    near = F.col("day").between(F.col("near_from"), F.col("near_to"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("k"))), F.lit(0))
    keys = bounded.columns
    return j.groupBy(*keys).agg(n(near).alias("near"), n(near & (F.col("day") <= F.col("anchor"))).alias("near_pre"), n(near & (F.col("day") > F.col("anchor"))).alias("near_post"), n(base).alias("base"))


def rates(counted: DataFrame, least_near: int = 30, least_base: int = 90) -> DataFrame:
    """Events by 30.44 days of exposure in both windows, of entities with enough of it and any event."""
    r = counted.where((F.col("near_days") >= least_near) & (F.col("base_days") >= least_base))
    r = r.withColumn("near_rate", F.col("near") / (F.col("near_days") / MONTH)).withColumn("base_rate", F.col("base") / (F.col("base_days") / MONTH))
    return r.where("near_rate > 0 or base_rate > 0").withColumn("ratio", ratio(F.col("near_rate"), F.col("base_rate")))


def ratio(near: Column, base: Column, pad: float = 0.01) -> Column:
    return (near + pad) / (base + pad)


def rate_test(rated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, up, down, the exact sign test and the geometric mean ratio."""
    by = by or []
    up, down = F.count_if(F.col("near_rate") > F.col("base_rate")), F.count_if(F.col("near_rate") < F.col("base_rate"))
    out = rated.groupBy(*by).agg(F.count("*").alias("n"), up.alias("up"), down.alias("down"), F.exp(F.avg(F.log("ratio"))).alias("geo_ratio"))
    return out.withColumn("sign_p", sign_p("up", "down", 1.0))
