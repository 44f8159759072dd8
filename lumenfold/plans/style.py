"""Registered queries on writing style: posts are documents dated by events, accounts are the events' users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import style as Y
from ..operators import style as S
from .registry import registrar

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: Small lists of this library's own; a study brings its lexicon files.
BANKS = S.Banks(
    {
        "p1s": Y.Lexicon.of(["i", "me", "my", "mine", "yo", "mi", "je", "ich"]),
        "p1p": Y.Lexicon.of(["we", "us", "our", "nosotros", "nous", "wir"]),
        "p23": Y.Lexicon.of(["you", "your*", "he", "she", "they", "el", "il", "sie"]),
        "absol": Y.Lexicon.of(["never", "always", "nothing", "all", "every*", "nunca", "siempre", "all the time"]),
        "neg": Y.Lexicon.of(["no", "not", "nor", "without", "sin", "pas", "nicht", "does not"]),
        "hedge": Y.Lexicon.of(["maybe", "perhaps", "quizas", "seem*", "i think", "of the"]),
        "emo_neg": Y.Lexicon.of(["sad*", "bad", "hate*", "fear*", "wrong", "hard"]),
        "emo_pos": Y.Lexicon.of(["happy", "good", "love*", "great", "light", "new"]),
        "grief": Y.Lexicon.of(["die*", "dead", "pain*", "loss", "long time", "in the"]),
    },
    ["😢", "😭", "☹"],
    ["😀", "❤", "🎉"],
    ["the", "and", "of", "to", "is", "in", "that"],
    ["el", "la", "de", "que", "y", "en", "los"],
)
R6 = [c for c in S.FEATURES]


def posts(t) -> DataFrame:
    """(doc_id, user_id, ts, caption, media): each document stands at the event whose id is its own times events per document."""
    step = t("events").agg(F.count("*").alias("e")).crossJoin(t("documents").agg(F.count("*").alias("d"))).select(F.floor(F.col("e") / F.greatest("d", F.lit(1))).alias("step"))  # one row
    d = t("documents").crossJoin(F.broadcast(step)).select("doc_id", F.col("text").alias("caption"), (F.col("doc_id") * F.col("step")).alias("event_id"))
    return d.join(t("events").select("event_id", "user_id", "ts", F.col("event_type").alias("media")), "event_id").drop("event_id")


POSTS = "posts as (select doc_id, user_id, ts, text as caption, event_type as media from documents join events on event_id = doc_id * ((select count(*) from events) // greatest((select count(*) from documents), 1)))"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def counts_sql(banks: S.Banks = BANKS) -> str:
    """posts -> counted, as DuckDB SQL."""
    hits = ",\n  ".join(f"{lex.sql('tokens', 'doubled')} as {name}" for name, lex in banks.lexicons.items())
    valence = lambda of: f"len(list_filter(found, lambda x: x in ({_in(of)}) or replace(x, chr(65039), '') in ({_in(of)})))"
    en, es = (f"len(list_filter(tokens, lambda x: x in ({_in(w)})))" for w in (banks.english, banks.spanish))
    return rf"""{POSTS},
a as (select *, translate(coalesce(caption, ''), '‘’“”', '''''""') as cap from posts),
b as (select *, regexp_replace(regexp_replace(cap, '#[\p{{L}}\p{{N}}_]+', ' ', 'g'), '@[\p{{L}}\p{{N}}_.]+', ' ', 'g') as body from a),
c as (select *, list_transform(regexp_extract_all(body, '(?i){Y.TOKEN.replace("'", "''")}'), lambda x: lower(x)) as tokens, regexp_extract_all(cap, '{Y.EMOJI}') as found,
  ' ' || regexp_replace(lower(body), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ' as doubled from b),
counted as (select doc_id, user_id, ts, tokens, len(tokens) as words,
  {hits},
  len(found) as emoji, {valence(banks.emoji_neg)} as emoji_neg, {valence(banks.emoji_pos)} as emoji_pos,
  len(regexp_extract_all(cap, '#[\p{{L}}\p{{N}}_]+')) as hashtags, len(regexp_extract_all(cap, '@[\p{{L}}\p{{N}}_.]+')) as mentions,
  len(regexp_extract_all(cap, '[!¡]')) as exclaims, len(regexp_extract_all(cap, '\.\.\.+|…')) as dots,
  len(list_filter(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '{Y.CAPITALS}'))) as capitals,
  (not regexp_matches(cap, '\S'))::int as no_caption, (regexp_matches(cap, '\S') and len(tokens) = 0)::int as symbols_only, (media = 'view')::int as video,
  (len(tokens) >= 2 and {en} >= 2 and {en} > {es})::int as english, (len(tokens) >= 1)::int as has_text,
  hour(ts) + minute(ts) / 60.0::double as hour, (hour(ts) < 6)::int as night, (isodow(ts) >= 6)::int as weekend from c)"""


def style_sql(keys: str, source: str = "counted") -> str:
    """The 25 features of source by keys, as DuckDB SQL that ends in a table f25."""
    rates = ", ".join(f"100 * sum({c}) / nullif(sum(words), 0)::double as {c}_100" for c in S.RATES)
    per = ", ".join(f"sum({e}) / (sum(words) + count(*))::double as {n}" for e, n in (("emoji", "emoji_pp"), ("hashtags", "hashtag_pp"), ("mentions", "mention_pp"), ("exclaims + dots + capitals", "punctuation")))
    return f"""g as (select {keys}, (epoch_us(ts) - epoch_us(lag(ts) over (partition by {keys} order by ts, doc_id))) / 86400000000.0::double as gap from {source}),
h as (select {keys}, median(gap) as gap_median, case when count(gap) >= 3 and avg(gap) > 0 then stddev_pop(gap) / avg(gap) end as burstiness from g group by {keys}),
v as (select {keys}, count(distinct token) as kinds from (select {keys}, unnest(tokens) as token from {source}) group by {keys}),
s as (select {keys}, count(*) as n_posts, sum(words)::bigint as n_words, {rates}, (sum(emoji_pos) - sum(emoji_neg)) / nullif(sum(emoji_pos) + sum(emoji_neg), 0)::double as emoji_val, avg(ln(1 + words)) as words_log, {per},
  avg(night) as night_share, (atan2(sum(sin(2 * pi() * hour / 24)), sum(cos(2 * pi() * hour / 24))) * 24 / (2 * pi()) + 24) % 24 as hour_circ, avg(weekend) as weekend_share,
  avg(video) as video_share, avg(no_caption) as no_caption_share, avg(symbols_only) as symbols_only_share, sum(english * has_text) / nullif(sum(has_text), 0)::double as english_share from {source} group by {keys}),
f25 as (select s.*, gap_median, burstiness, case when n_words >= 20 then kinds / n_words::double end as diversity from s join h using ({keys}) left join v using ({keys}))"""


ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in S.FEATURES)
COUNTERS = ["words", *S.RATES, "emoji", "emoji_neg", "emoji_pos", "hashtags", "mentions", "exclaims", "dots", "capitals", "no_caption", "symbols_only", "video", "english"]


def counted(t) -> DataFrame:
    return S.post_counts(posts(t), BANKS, video=F.col("media") == "view")


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_posts", "n_words", *[F.round(c, 6).alias(c) for c in S.FEATURES])


@query(f"with {counts_sql()} select doc_id, {', '.join(f'{c}::bigint as {c}' for c in COUNTERS)}, round(hour, 6) as hour, night, weekend, ts::date::varchar as day from counted")
def feat_post_counts(t):
    return counted(t).select("doc_id", *[F.col(c).cast("long").alias(c) for c in COUNTERS], F.round("hour", 6).alias("hour"), "night", "weekend", F.to_date("ts").cast("string").alias("day"))


@query(f"with {counts_sql()}, {style_sql('user_id')} select user_id, n_posts, n_words, {ROUNDED} from f25")
def feat_style25(t):
    return rounded(S.style25(counted(t), ["user_id"]), "user_id")


WINDOWED = """anchors as (select distinct user_id, date '2024-01-10' + (user_id * 7 % 10)::int as anchor from events),
w as (select c.*, ts::date as day, anchor from counted c join anchors using (user_id)),
x as (select *, unnest(list_filter([case when day >= anchor - 5 and day <= anchor + 5 then 'peri' end, case when day >= anchor - 15 and day <= anchor - 5 then 'base' end], lambda q: q is not null)) as win from w),
windowed as (select * from x where user_id in (select user_id from x group by user_id having count(distinct win) = 2))"""


def windowed(t) -> DataFrame:
    anchors = t("events").select("user_id").distinct().withColumn("anchor", F.expr("date_add(DATE'2024-01-10', cast(user_id * 7 % 10 as int))"))
    return S.assigned(counted(t), anchors, "user_id", F.to_date("ts"), 5, 10).withColumnRenamed("window", "win")


@query(f"with {counts_sql()}, {WINDOWED} select user_id, win, doc_id from windowed")
def ew_assign(t):
    return windowed(t).select("user_id", "win", "doc_id")


@query(f"with {counts_sql()}, {WINDOWED}, {style_sql('user_id, win', 'windowed')} select user_id, win, n_posts, n_words, {ROUNDED} from f25")
def feat_style25_by_window(t):
    return rounded(S.style25(windowed(t), ["user_id", "win"]), "user_id", "win")


@query(rf"""select doc_id, len(f) as emoji, len(list_filter(f, lambda x: x in ('😀') or replace(x, chr(65039), '') in ('😀', '❤'))) as pos from (select doc_id, regexp_extract_all(coalesce(text, '') || (['', ' 😀', ' ❤️ 👩‍🚀 🇪🇸', '🏳️‍🌈👍🏽'])[doc_id % 4 + 1], '{Y.EMOJI}') as f from documents)""")
def txt_emoji(t):
    tails = F.element_at(F.array(*[F.lit(x) for x in ("", " 😀", " ❤️ 👩‍🚀 🇪🇸", "🏳️‍🌈👍🏽")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = t("documents").select("doc_id", Y.emoji(F.concat(F.coalesce("text", F.lit("")), tails)).alias("f"))
    return d.select("doc_id", F.size("f").alias("emoji"), Y.valence(F.col("f"), ["😀", "❤"]).alias("pos"))
