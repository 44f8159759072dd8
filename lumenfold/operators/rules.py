"""First-match rule cascades with reasons, funnels, best rows, quantile family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def verdict(rules: list[tuple[str, str, Column]], otherwise: tuple[str, str]) -> Column:
    """(verdict, reason) of the first rule that holds."""
    pair = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))
    out = pair(*otherwise)
    for v, r, test in reversed(rules):
        out = F.when(test, pair(v, r)).otherwise(out)
    return out


def echoes(text: Column, caption: Column, chars: int = 40) -> Column:
    """Whether a comment repeats the caption: all of it, or its own first characters stand in it."""
    return (text == caption) | F.contains(caption, F.left(text, F.lit(chars)))


def exclusions(sources: list[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """(key, reason): every key that a source names, with the first source's name; one shuffle on the key."""
    every = None
    for place, (reason, df) in enumerate(sources):
        rows = df.select(key, F.struct(F.lit(place).alias("place"), F.lit(reason).alias("reason")).alias("r"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(key).agg(F.min("r").alias("r")).select(key, "r.reason")


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, place, n, of_previous, of_total): rows that pass each stage and all before it."""
    passed, sums = F.lit(True), []
    for i, (_, test) in enumerate(stages):
        passed = passed & F.coalesce(test, F.lit(False))
        sums.append(F.count_if(passed).alias(f"s{i}"))
    one = df.agg(*sums)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.lit(i).alias("place"), F.col(f"s{i}").alias("n")) for i, (name, _) in enumerate(stages)])).alias("r")).select("r.*")
    w = Window.partitionBy(F.lit(0)).orderBy("place")
    share = lambda d: F.round(100 * F.col("n") / F.nullif(d, F.lit(0)), 6)
    return rows.withColumn("of_previous", share(F.lag("n").over(w))).withColumn("of_total", share(F.first("n").over(w)))


def best_row(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_share(df: DataFrame, entity: str, k: int = 4) -> DataFrame:
    """The share of rows that the k largest entities have."""
    n = df.groupBy(entity).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), entity).limit(k).agg(F.sum("n").alias("top_n"))
    return n.agg(F.sum("n").alias("all_n")).crossJoin(F.broadcast(top)).select("top_n", "all_n", F.round(F.col("top_n") / F.col("all_n"), 6).alias("share"))
