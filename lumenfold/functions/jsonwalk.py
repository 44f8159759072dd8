"""Objects anywhere in nested JSON: a recursive walk, by Arrow batches, and what is read off the objects it finds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import ArrayType, StringType

from .numbers import col


def _objects(value) -> Iterator[dict]:
    todo = [value]
    while todo:  # no recursion, so depth is no limit
        v = todo.pop()
        if isinstance(v, dict):
            yield v
        todo.extend(reversed(list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []))


def _walk(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return [json.dumps(o, ensure_ascii=False) for o in _objects(json.loads(t))] if t else []
        except ValueError:
            return []

    return texts.map(one)


def objects(c) -> Column:
    """Every object of a JSON text, outer ones first, as JSON; none for null or what is no JSON."""
    return F.pandas_udf(_walk, ArrayType(StringType()), PandasUDFType.SCALAR)(col(c))


def _field(o: str, path: str) -> Column:
    return F.get_json_object(o, f"$.{path}")


def comments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pk, author, said, created, likes) of the objects that are comments, each pk once a row; said is '[image]' if empty."""
    o = df.select(key, F.posexplode(objects(text)).alias("n", "o"))
    c = o.select(key, "n", _field("o", "pk").alias("pk"), _field("o", "user.username").alias("author"), _field("o", "text").alias("said"), _field("o", "created_at").cast("long").alias("created"), _field("o", "comment_like_count").cast("long").alias("likes"))
    c = c.where("pk is not null and author is not null and said is not null and created is not null and likes is not null")
    first = c.groupBy(key, "pk").agg(F.min_by(F.struct("author", "said", "created", "likes"), "n").alias("x"))
    return first.select(key, "pk", "x.author", F.when(F.trim("x.said") == "", "[image]").otherwise(F.col("x.said")).alias("said"), "x.created", "x.likes")


def usertags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tagged): names in usertags.in[].user.username, each once a row."""
    o = df.select(key, F.explode(objects(text)).alias("o"))
    names = F.from_json(_field("o", "usertags.in"), "array<struct<user: struct<username: string>>>")
    return o.select(key, F.explode(names).alias("x")).select(key, F.col("x.user.username").alias("tagged")).where("tagged is not null").distinct()


def post_date(df: DataFrame, key: str, text: str, code: str) -> DataFrame:
    """(key, taken): the time of the object whose code is the row's, else the first time in the text."""
    o = df.select(key, code, F.posexplode(objects(text)).alias("n", "o")).select(key, code, "n", _field("o", "taken_at").try_cast("long").alias("t"), _field("o", "code").alias("c")).where("t is not null")
    own = F.min_by(F.when(F.col("c") == F.col(code), F.col("t")), F.when(F.col("c") == F.col(code), F.col("n")))
    return o.groupBy(key).agg(F.timestamp_seconds(F.coalesce(own, F.min_by("t", "n"))).alias("taken"))
