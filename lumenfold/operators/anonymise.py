"""Every string field of a profile's rows, at any depth of the schema, without the handles of its people.

The schema says which fields are cleaned, so a field that is new is cleaned too. Handles come from three places: an @mention,
the owner in a post's address, the author that stands before a caption's date; a bare word counts as a handle if it is known.
The profile's own handle becomes its id, any other a number by profile, the same in all its rows.

Scale: words are looked up by an equi-join with the known handles, and a row carries the labels of its own words alone, so
no list of handles is broadcast and no row grows with its profile. Numbering a profile's people is one task's work.

Defined results: null strings stay null; U+E000 is used as a mark and dropped from texts; a row without handles is
unchanged; a null own handle matches nothing; rows of one key share their labels, null keys are keys; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .privacy import pseudonyms

MARK = "\ue000"
NAME = "A-Za-z0-9._"
TOKEN = f"[{MARK}@]?[{NAME}]+"


def marked(text: Column, ids: str) -> Column:
    """The text with a mark before each handle that an address or a caption's head names."""
    t = F.translate(text, MARK, "")
    t = F.regexp_replace(t, r"(https?://[^/\s]+/)([A-Za-z0-9_.]+)(/(?:p|reel)/)", f"$1{MARK}$2$3")
    return F.regexp_replace(t, rf"(^|-\s+)(?!(?:{ids})\s)([{NAME}]{{2,30}})(\s+(?:on|el)\s+)", f"$1{MARK}$2$3")


def rewritten(c: Column, kind: DataType, name: str, put: Callable[[Column, str], Column], keep: Iterable[str], drop: Iterable[str]) -> Column:
    """c with put(string, field name) for every string below it, but for kept and dropped fields."""
    if name in keep:
        return c
    if isinstance(kind, StringType):
        return put(c, name)
    if isinstance(kind, StructType):
        inner = [rewritten(c.getField(f.name), f.dataType, f.name, put, keep, drop).alias(f.name) for f in kind if f.name not in drop]
        return F.when(c.isNotNull(), F.struct(*inner)) if inner else F.lit(None)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: rewritten(x, kind.elementType, name, put, keep, drop))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: rewritten(x, kind.valueType, name, put, keep, drop))
    return c


def strings(c: Column, kind: DataType, name: str, put: Callable[[Column, str], Column], keep: Iterable[str], drop: Iterable[str]) -> Column | None:
    """All strings that rewritten would reach, as one array; None if the type holds none."""
    if name in keep or name in drop:
        return None
    if isinstance(kind, StringType):
        return F.array(put(c, name))
    if isinstance(kind, StructType):
        inner = [s for f in kind if (s := strings(c.getField(f.name), f.dataType, f.name, put, keep, drop)) is not None]
        return F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in inner]) if inner else None
    if isinstance(kind, (ArrayType, MapType)):
        held, of = (c, kind.elementType) if isinstance(kind, ArrayType) else (F.map_values(c), kind.valueType)
        if strings(F.lit(None), of, name, put, keep, drop) is None:
            return None
        return F.flatten(F.transform(held, lambda x: F.coalesce(strings(x, of, name, put, keep, drop), F.array().cast("array<string>"))))
    return None


def project_anonymous(
    df: DataFrame, by: str, key: list[str], order: str, own: str, me: str, known: DataFrame, people: Iterable[str] = (), drop: Iterable[str] = (), keep: Iterable[str] = (),
    label: str = "Anonymous ", ids: str = r"Anonymous_\d+",
) -> DataFrame:
    """df without the columns of drop and the own handle, its strings cleaned but for the fields of keep.

    by is the profile, key (with by) a row, order the rows' order within a profile; own and me are columns with the
    profile's handle and id; known has a column handle; people are fields whose whole value is a handle. ids matches
    what stands for a person already.
    """
    keep, drop, people = {*keep, by, me, *key}, {*drop, own}, set(people)

    def ready(c: Column, name: str) -> Column:
        return F.concat(F.lit(MARK), F.regexp_replace(F.trim(c), "^@", "")) if name in people else marked(c, ids)

    fields = [f for f in df.schema if f.name not in drop]
    held = [s for f in fields if (s := strings(F.col(f"`{f.name}`"), f.dataType, f.name, ready, keep, drop)) is not None]
    texts = F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in held]) if held else F.array().cast("array<string>")
    found = F.flatten(F.transform(F.array_compact(texts), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))))
    # structs are equal where their nulls are, so rows without a profile or key are cleaned as well
    row, profile = F.struct(by, *key).alias("__row"), F.struct(by).alias("__by")
    words = df.select(row, profile, F.col(order).alias("__order"), F.lower(F.col(own)).alias("__own"), F.explode(F.array_distinct(found)).alias("__w"))
    bare = F.lower(F.regexp_replace("__w", f"^[{MARK}@]", ""))
    words = words.withColumn("handle", bare).where(~F.col("handle").eqNullSafe(F.col("__own")))
    asked = F.col("__w").rlike(f"^[{MARK}@]") & F.length("handle").between(2, 30)
    words = words.groupBy("__row", "__by", "handle").agg(F.max(asked).alias("__asked"), F.min("__order").alias("__order"))
    run = known.select(F.lower(F.trim("handle")).alias("handle")).where(F.length("handle") >= 4).distinct().withColumn("__known", F.lit(True))
    need = words.join(run, "handle", "left").where(F.col("__asked") | F.col("__known"))
    names = pseudonyms(need, "__by", "handle", "__order", label)
    entry = F.struct("handle", F.struct("alias", F.coalesce("__known", F.lit(False)).alias("known")))
    maps = need.join(names, ["__by", "handle"]).groupBy("__row").agg(F.map_from_entries(F.collect_list(entry)).alias("__names"))

    def put(c: Column, name: str) -> Column:
        t = ready(c, name)

        # each step binds what the next one uses, so a word is looked up once: what a lambda only refers to is made anew for every element
        word = lambda m: F.struct(m.alias("m"), F.lower(F.ltrim(m, F.lit(f"{MARK}@"))).alias("handle"), (~F.left(m, F.lit(1)).isin("@", MARK)).alias("loose"))
        look = lambda x: F.struct(x["m"], x["handle"], x["loose"], F.element_at(F.col("__names"), x["handle"]).alias("held"))

        def one(x: Column) -> Column:
            m, held, at = x["m"], x["held"], x["m"].startswith("@")
            mine = F.coalesce(x["handle"] == F.lower(F.col(f"`{own}`")), F.lit(False))
            id_ = F.col(f"`{me}`").cast("string")
            stays = held.isNull() | (x["loose"] & ~held["known"])
            return F.when(mine & at, F.concat(F.lit("@"), id_)).when(mine, id_).when(stays, F.translate(m, MARK, "")).when(at, F.concat(F.lit("@["), held["alias"], F.lit("]"))).otherwise(F.translate(held["alias"], " ", "_"))

        found = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
        new = F.transform(F.transform(F.transform(found, word), look), one)
        joined = F.array_join(F.zip_with(F.split(t, TOKEN, -1), new, lambda p, x: F.concat(F.translate(p, MARK, ""), F.coalesce(x, F.lit("")))), "")
        return F.when(c.isNotNull(), joined)

    both = df.withColumn("__row", row).join(maps, "__row", "left")
    return both.select(*[rewritten(F.col(f"`{f.name}`"), f.dataType, f.name, put, keep, drop).alias(f.name) for f in fields])
