"""Pseudonyms by thread, rewriting of mentions, and the check for handles that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pseudonyms(df: DataFrame, by: str, author: str, order: str, label: str = "Anonymous ") -> DataFrame:
    """(by, author, alias): authors numbered as first seen in each group."""
    seen = df.where(F.col(author).isNotNull()).groupBy(by, author).agg(F.min(order).alias("__seen"))
    number = F.row_number().over(Window.partitionBy(by).orderBy("__seen", author))
    return seen.select(by, author, F.concat(F.lit(label), number.cast("string")).alias("alias"))


def rewrite_mentions(df: DataFrame, names: DataFrame, by: str, text: str, author: str, alias: str) -> DataFrame:
    """df with each @name of the group's authors replaced by its alias, unknown ones by 'someone'.

    A text is cut at its mentions, each looked up in its group's map; what stands between stays as it is.
    """
    maps = names.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.lower(author), alias))).alias("__names"))
    mention = r"@[\p{L}\p{N}_]+"
    parts = F.split(text, mention)
    found = F.regexp_extract_all(text, F.lit(mention), F.lit(0))
    put = F.transform(found, lambda m: F.coalesce(F.element_at("__names", F.lower(F.substring(m, 2, 1 << 30))), F.lit("someone")))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(put, i), F.lit("")))), "")
    return df.join(maps, by, "left").withColumn(text, joined).drop("__names")


def leaks(df: DataFrame, key: str, text: str, handles: DataFrame) -> DataFrame:
    """(handle, hits, rows_n) of the handles that still stand in the texts: an equi-join on words."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0))).alias("handle"))
    hit = words.groupBy(key, "handle").agg(F.count("*").alias("n")).join(handles.distinct(), "handle", "left_semi")
    return hit.groupBy("handle").agg(F.sum("n").alias("hits"), F.count("*").alias("rows_n"))
