"""Inputs of many shapes for operators on text: each row of a table gets one of a list of texts, null among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shaped(t, shapes: list[str | None], table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """(key, s): the text at place key mod their number."""
    texts = F.array(*[F.lit(s).cast("string") for s in shapes])
    return t(table).select(key, F.element_at(texts, (F.col(key) % len(shapes) + 1).cast("int")).alias("s"))


def shaped_sql(shapes: list[str | None], table: str = "customer", key: str = "c_custkey") -> str:
    texts = ", ".join("null" if s is None else quoted(s) for s in shapes)
    return f"(select {key}, ([{texts}])[({key} % {len(shapes)})::int + 1] as s from {table})"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
