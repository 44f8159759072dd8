"""Readers of the files that a study starts from, and writers of what it hands on. All are distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import col


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, with or without a byte-order mark; empty fields are null, fields may hold line breaks."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in their order, nulls as empty fields."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are none are left out."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def nested(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The elements of an array field of whole-file JSON, as rows."""
    whole = spark.read.json(path, schema=f"`{field}` array<struct<{schema}>>", multiLine=True)
    return whole.select(F.explode(field).alias("e")).select("e.*")


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(word): lower-case entries, without blanks and lines that start with #."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where("word <> '' and word not like '#%'").distinct()


def scored_lexicon(spark: SparkSession, path: str, least: float = 0.5) -> DataFrame:
    """(word, category): lines 'word; category; score' by tabs or semicolons, of a score of least or more.

    The last field that is a number is the score; lines without one are left out.
    """
    parts = F.transform(F.split("value", "[;\t]"), F.trim)
    numbers = F.filter(F.transform("p", lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    rows = spark.read.text(path).select(parts.alias("p")).withColumn("score", F.element_at(F.when(F.size(numbers) > 0, numbers), -1))
    return rows.where(F.col("score") >= least).select(F.lower(F.get("p", F.lit(0))).alias("word"), F.lower(F.get("p", F.lit(1))).alias("category"))


def comment_list(spark: SparkSession, path: str) -> DataFrame:
    """(handle, reason) of lines 'handle # reason'; the reason may be missing."""
    parts = F.split("value", "#", 2)
    return spark.read.text(path).select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("handle"), F.trim(F.get(parts, F.lit(1))).alias("reason")).where("handle <> ''")


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(key, html) of a folder of saved pages: the key is the file name without '_<time>.html'; the first of a key stays."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_\d+)?\.html$", 1)
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.html").select(name.alias("key"), F.input_file_name().alias("file"), F.col("value").alias("html"))
    return rows.groupBy("key").agg(F.min_by("html", "file").alias("html"))


def media_kind(content) -> Column:
    """Kind of a media file by bytes 5 to 8: complete, fragment, odd, or absent."""
    data = F.coalesce(col(content), F.lit(b""))
    tag = F.substring(data, 5, 4)
    return F.when(F.octet_length(data) == 0, "absent").when(tag == F.lit(b"ftyp"), "complete").when(tag == F.lit(b"moof"), "fragment").otherwise("odd")


def media_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind) of media files; empty files are not listed."""
    return spark.read.format("binaryFile").load(path).select("path", "length", media_kind("content").alias("kind"))


def newest(files: DataFrame, id_: str, prefix: str, stamp: str, file: str) -> DataFrame:
    """(file): the latest one most of whose ids begin with prefix."""
    by = files.groupBy(file).agg(F.avg(F.col(id_).startswith(prefix).cast("int")).alias("share"), F.max(stamp).alias("at"))
    return by.where("share > 0.5").orderBy(F.desc("at"), F.desc(file)).limit(1).select(file)


def seed_list(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(handle, class, note) of lines 'handle,class[,note]' whose class is known; blank and # lines are left out."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(F.transform(F.split("value", ",", 3), F.trim).alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    handle = F.nullif(F.regexp_replace(F.lower(at(0)), "^@", ""), F.lit(""))
    return rows.select(handle.alias("handle"), F.lower(at(1)).alias("class"), at(2).alias("note")).where(F.col("handle").isNotNull() & F.col("class").isin(classes))


def intake_list(spark: SparkSession, path: str, formats: list[str]) -> DataFrame:
    """(id, handle, start, stop) of a CSV of users: handles bare, dates by the first format that fits, the last day whole; rows whose dates do not parse are left out."""
    from ..functions.text import date_any, handle

    rows = csv(spark, path, "id string, user string, start string, stop string")
    d = rows.select("id", handle("user").alias("handle"), date_any("start", formats).alias("start"), date_any("stop", formats).alias("stop"))
    return d.where("start is not null and stop is not null").withColumn("stop", F.col("stop") + F.expr("interval '23:59:59' hour to second"))


def exported(spark: SparkSession, path: str, schema: str, field: str, status: str | None = None, column: str = "status") -> DataFrame:
    """The rows of an export, an object with an array field or a bare list, those of one status if it is named."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{schema}>>")
    inside = F.from_json("v", f"struct<`{field}`: array<struct<{schema}>>>")[field]
    rows = whole.select(F.explode(F.when(F.ltrim("v").startswith("["), listed).otherwise(inside)).alias("e")).select("e.*")
    return rows.where(F.col(column) == status) if status is not None else rows


def resolve_path(options: dict[str, str], name: str, folders: list[str], exists) -> str | None:
    """A study file's path: the option that names it, else the first folder that has it, else None."""
    candidates = ([options[name]] if options.get(name) else []) + [f"{f.rstrip('/')}/{name}" for f in folders]
    return next((c for c in candidates if exists(c)), None)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one nested object each, committed as a whole: readers see all of it or nothing."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result table as Markdown; a report is for reading, so longer tables are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows are no table of a report")
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"
