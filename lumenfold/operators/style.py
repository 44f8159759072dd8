"""Style of posts and accounts: counters of each post, then rates and shares of what belongs together.

A post's counters are column expressions over its own text. An account's rates come from sums of counters,
never from means of rates, so partial aggregation does the work; distinct tokens are counted from exploded
tokens, so no account's text is gathered in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import style as Y
from ..functions import text as X


@dataclass(frozen=True)
class Banks:
    """The word lists that the counters use."""

    lexicons: dict[str, Y.Lexicon]
    emoji_neg: list[str]
    emoji_pos: list[str]
    english: list[str]
    spanish: list[str]


RATES = ["p1s", "p1p", "p23", "absol", "neg", "hedge", "emo_neg", "emo_pos", "grief"]


def post_counts(df: DataFrame, banks: Banks, caption: str = "caption", ts: str = "ts", video: Column | None = None) -> DataFrame:
    """df with the tokens, 22 counters and the time marks of each post."""
    cap = X.normalise(caption)
    d = df.withColumn("__cap", cap).withColumn("__text", X.strip_tags_mentions(F.col("__cap"))).withColumn("__low", F.lower("__text"))
    d = d.withColumn("tokens", Y.style_tokens("__text")).withColumn("__emoji", Y.emoji("__cap"))
    n, words = F.size("tokens"), lambda of: F.size(F.filter("tokens", lambda w: w.isin(of)))
    blank = ~F.col("__cap").rlike(r"\S")
    en, es = words(banks.english), words(banks.spanish)
    out = {
        "words": n,
        **{name: banks.lexicons[name].hits(F.col("tokens"), F.col("__low")) for name in RATES},
        "emoji": F.size("__emoji"),
        "emoji_neg": Y.valence(F.col("__emoji"), banks.emoji_neg),
        "emoji_pos": Y.valence(F.col("__emoji"), banks.emoji_pos),
        "hashtags": F.size(X.hashtags("__cap")),
        "mentions": F.size(X.mentions("__cap")),
        "exclaims": X.found("__cap", "[!¡]"),
        "dots": X.found("__cap", r"\.{3,}|…"),
        "capitals": Y.capitals("__text"),
        "no_caption": blank.cast("int"),
        "symbols_only": (~blank & (n == 0)).cast("int"),
        "video": (video if video is not None else F.lit(False)).cast("int"),
        "english": ((n >= 2) & (en >= 2) & (en > es)).cast("int"),
        "has_text": (n >= 1).cast("int"),
        "hour": F.hour(ts) + F.minute(ts) / 60,
        "night": (F.hour(ts) < 6).cast("int"),
        "weekend": (F.weekday(ts) >= 5).cast("int"),
    }
    return d.withColumns(out).drop("__cap", "__text", "__low", "__emoji")


def style25(counted: DataFrame, keys: list[str], ts: str = "ts", order: str = "doc_id", least_tokens: int = 20) -> DataFrame:
    """The 25 style features of each group of posts, null where they cannot be told, with n_posts and n_words."""
    total, words, posts = F.sum, F.sum("words"), F.count("*")
    per = lambda c: total(c) / (words + posts)
    angle = 2 * F.pi() * F.col("hour") / 24
    signed = total("emoji_pos") + total("emoji_neg")
    f = counted.groupBy(*keys).agg(
        posts.alias("n_posts"),
        words.alias("n_words"),
        *[(100 * total(c) / F.nullif(words, F.lit(0))).alias(f"{c}_100") for c in RATES],
        ((total("emoji_pos") - total("emoji_neg")) / F.nullif(signed, F.lit(0))).alias("emoji_val"),
        F.avg(F.log1p("words")).alias("words_log"),
        per("emoji").alias("emoji_pp"),
        per("hashtags").alias("hashtag_pp"),
        per("mentions").alias("mention_pp"),
        ((total("exclaims") + total("dots") + total("capitals")) / (words + posts)).alias("punctuation"),
        F.avg("night").alias("night_share"),
        F.pmod(F.atan2(total(F.sin(angle)), total(F.cos(angle))) * 24 / (2 * F.pi()), F.lit(24.0)).alias("hour_circ"),
        F.avg("weekend").alias("weekend_share"),
        F.avg("video").alias("video_share"),
        F.avg("no_caption").alias("no_caption_share"),
        F.avg("symbols_only").alias("symbols_only_share"),
        (total(F.col("english") * F.col("has_text")) / F.nullif(total("has_text"), F.lit(0))).alias("english_share"),
    )
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(Window.partitionBy(*keys).orderBy(ts, order))) / 86400e6
    g = counted.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.median("gap").alias("gap_median"), F.when((F.count("gap") >= 3) & (F.avg("gap") > 0), F.stddev_pop("gap") / F.avg("gap")).alias("burstiness"))
    kinds = counted.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys).agg(F.countDistinct("token").alias("__kinds"))
    out = f.join(g, keys).join(kinds, keys, "left")
    return out.withColumn("diversity", F.when(F.col("n_words") >= least_tokens, F.col("__kinds") / F.col("n_words"))).drop("__kinds")


FEATURES = [f"{c}_100" for c in RATES] + ["emoji_val", "words_log", "emoji_pp", "hashtag_pp", "mention_pp", "punctuation", "night_share", "hour_circ", "weekend_share", "gap_median", "burstiness", "video_share", "no_caption_share", "symbols_only_share", "english_share", "diversity"]


def assigned(posts: DataFrame, anchors: DataFrame, entity: str, day: Column, width: int, base: int, exclusive_boundary: bool = False) -> DataFrame:
    """posts with window 'peri' or 'base' around their entity's anchor, of entities that have both.

    The day on which the base ends and the other window begins belongs to both, unless the boundary is exclusive.
    """
    d = posts.join(anchors, entity).withColumn("__day", day)
    lo = F.date_sub("anchor", width)
    peri = (F.col("__day") >= lo) & (F.col("__day") <= F.date_add("anchor", width))
    before = (F.col("__day") < lo) if exclusive_boundary else (F.col("__day") <= lo)
    in_base = (F.col("__day") >= F.date_sub("anchor", width + base)) & before
    d = d.withColumn("window", F.explode(F.array_compact(F.array(F.when(peri, "peri"), F.when(in_base, "base"))))).drop("__day")
    both = d.groupBy(entity).agg(F.countDistinct("window").alias("n")).where("n = 2").select(entity)
    return d.join(both, entity, "left_semi")
