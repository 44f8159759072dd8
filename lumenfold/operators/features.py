"""Features by account: activity from dated events, style from texts; imputing and standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import months


def account_features(events: DataFrame) -> DataFrame:
    """Activity by user_id of events (user_id, ts, event_type, value).

    The gap window and the aggregation share the partitioning by user, so there is one shuffle.
    Burstiness needs three gaps.
    """
    at = F.col("ts").cast("timestamp")
    gap = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(Window.partitionBy("user_id").orderBy(at)))) / 86400e6
    e = events.select("user_id", "ts", "event_type", "value", gap.alias("gap"))
    share = lambda test: F.avg(test.cast("int"))
    mean, sd = F.avg("gap"), F.stddev_pop("gap")
    f = e.groupBy("user_id").agg(
        F.count("*").alias("n"), months(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).alias("months"),
        share(F.hour("ts") < 6).alias("night"), share(F.weekday("ts") >= 5).alias("weekend"),
        F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("event_type").alias("kinds"),
        share(F.col("event_type") == "view").alias("view_share"), F.avg("value").alias("mean_value"), F.max("value").alias("top_value"),
        F.median("gap").alias("gap"), F.when(F.count("gap") >= 3, (sd - mean) / F.nullif(sd + mean, F.lit(0.0))).alias("bursty"),
    )
    return f.withColumn("rate", F.col("n") / F.col("months"))


def style_features(posts: DataFrame, account: str, text: str, lexicons: dict[str, list[str]]) -> DataFrame:
    """Style by account: lexical rates over words (null without words), marks over words and posts.

    Counters are taken within each text and combined before the shuffle; distinct words are counted in a
    second aggregation, on (account, word).
    """
    w = F.col("__w")
    p = posts.select(account, F.coalesce(text, F.lit("")).alias("__t")).withColumn("__w", X.tokens("__t"))
    hits = {n: X.lexicon_hits(w, ws, []).alias(n) for n, ws in lexicons.items()}
    c = p.select(account, F.size(w).alias("words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), X.found("__t", "[!¡]").alias("bangs"), F.size(X.mentions("__t")).alias("ats"), *hits.values())
    s = c.groupBy(account).agg(F.count("*").alias("n_posts"), *[F.sum(x).alias(x) for x in ("words", "chars", "bangs", "ats", *hits)])
    types = p.select(account, F.explode("__w").alias("u")).groupBy(account, "u").agg(F.lit(1).alias("one")).groupBy(account).agg(F.count("*").alias("types"))
    words, marks = F.nullif("words", F.lit(0)), F.col("words") + F.col("n_posts")
    rates = [(100 * F.col(n) / words).alias(f"{n}_rate") for n in hits]
    return s.join(types, account, "left").select(account, "n_posts", F.col("words").alias("n_words"), *rates, (F.col("chars") / words).alias("word_length"), (100 * F.col("bangs") / marks).alias("bang_rate"), (100 * F.col("ats") / marks).alias("mention_rate"), (F.col("types") / words).alias("type_ratio"))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls as the column's median (0 if all are null), with the number of nulls as <column>_missing."""
    m = df.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"__{c}") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])
    out = df.crossJoin(F.broadcast(m))  # one row
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores by population deviation, 1 where that is 0."""
    m = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(m))  # one row
    z = {c: (F.col(c) - F.col(f"__{c}.m")) / F.when(F.col(f"__{c}.s") == 0, 1.0).otherwise(F.col(f"__{c}.s")) for c in columns}
    return out.withColumns(z).drop(*[f"__{c}" for c in columns])


META14 = ["log_followers", "log_following", "ratio", "log_posts", "log_rate", "years", "video_pct", "carousel_pct", "hour_mean", "hour_sd", "hashtag_pct", "place_pct", "caption_length", "has_bio"]


def meta14(profiles: DataFrame, posts: DataFrame, account: str, ts: str, marks: dict[str, Column], length: Column, as_of: str) -> DataFrame:
    """The 14 metadata features of each profile (followers, following, bio): shares are 0 without posts, months 3 at least."""
    day, zero = F.to_date(ts), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    a = posts.groupBy(account).agg(
        F.count("*").alias("n"), F.min(day).alias("__first"), F.max(day).alias("__last"), F.avg(F.hour(ts)).alias("hour_mean"), F.when(F.count("*") > 1, F.stddev_pop(F.hour(ts))).otherwise(0.0).alias("hour_sd"),
        *[(100 * F.avg(c.cast("int"))).alias(n) for n, c in marks.items()], F.avg(length).alias("caption_length"),
    )
    d = profiles.join(a, account, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    months = F.coalesce(F.greatest(F.lit(3.0), F.datediff("__last", "__first") / 30.44), F.lit(3.0))
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    return d.select(
        account, log(F.col("followers")).alias("log_followers"), log(F.col("following")).alias("log_following"), F.when(F.col("following") != 0, F.col("followers") / F.col("following")).otherwise(0.0).alias("ratio"), log(F.col("n")).alias("log_posts"),
        log(F.col("n") / months).alias("log_rate"), F.coalesce(F.datediff(F.lit(as_of).cast("date"), "__first") / 365.25, F.lit(0.0)).alias("years"),
        *[zero(c).alias(c) for c in ("video_pct", "carousel_pct", "hour_mean", "hour_sd", "hashtag_pct", "place_pct", "caption_length")], (F.trim(F.coalesce("bio", F.lit(""))) != "").cast("int").cast("double").alias("has_bio"),
    )
