"""Blind annotation kits and what two raters make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col


def keyed(seed: str, key: str) -> Column:
    """A hash order of a key, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def blind_key(df: DataFrame, by: str, key: str, cap: int, seed: str = "9") -> DataFrame:
    """(by, code, key): at most cap rows of each group, coded in a shuffled order that hides the key."""
    w = Window.partitionBy(by)
    kept = df.select(by, key).withColumn("__k", F.row_number().over(w.orderBy(keyed(seed, key), key))).where(F.col("__k") <= cap)
    return kept.select(by, F.row_number().over(w.orderBy(keyed("s", key), key)).alias("code"), key)


def consensus(a, b) -> Column:
    """The raters' common value, else null."""
    return F.when(col(a) == col(b), col(a))


def disagreements(df: DataFrame, categories: list[str], a: str = "a_", b: str = "b_") -> DataFrame:
    """Rows on which the raters differ, with the names of the categories."""
    names = F.concat_ws(",", *[F.when(F.col(a + c) != F.col(b + c), c) for c in categories])
    return df.withColumn("categories", names).where("categories <> ''")


def validity_sample(df: DataFrame, key: str, share: float = 0.2, seed: str = "v") -> DataFrame:
    """A share of the rows in hash order, one at least."""
    n = df.count()
    take = max(1, int(share * n + 0.5)) if n else 0
    return df.orderBy(keyed(seed, key), key).limit(take)


def parse_reply(reply, flags: list[str], enums: dict[str, list[str]]) -> Column:
    """The JSON object inside a wrapped reply: yes-like flags as 1 or 0, enums outside their list as null."""
    body = F.regexp_extract(col(reply), r"(?s)\{.*\}", 0)
    fields = [F.lower(F.get_json_object(body, f"$.{f}")).isin("1", "true", "yes", "si", "sí").cast("int").alias(f) for f in flags]
    for name, allowed in enums.items():
        v = F.lower(F.get_json_object(body, f"$.{name}"))
        fields.append(F.when(v.isin(allowed), v).alias(name))
    return F.struct(*fields)
