"""Registered queries that flatten nested exports and read JSON, dates and saved media off them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonwalk as J
from ..functions import text as X
from ..operators import rules as R
from .registry import registrar
from .shapes import quoted, shaped, shaped_sql

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


def _nested(t):
    """Threads as profiles that hold their turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t("conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query(r"select conv_id, turn, role, turn > min(turn) over (partition by conv_id) as is_reply, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) as words from conversations")
def flat_comments(t):
    n = _nested(t).select("conv_id", F.get("turns", F.lit(0))["turn"].alias("first"), F.explode_outer("turns").alias("c"))
    return n.select("conv_id", "c.turn", "c.role", (F.col("c.turn") > F.col("first")).alias("is_reply"), X.word_count("c.text").alias("words"))


@query("select conv_id, count(*) as turns, count(*) filter (role = 'user') as own, count(*) filter (role <> 'user') as others, count(distinct role) as roles from conversations group by conv_id")
def flat_profiles(t):
    own = F.filter("turns", lambda c: c["role"] == "user")
    others = F.filter("turns", lambda c: c["role"] != "user")
    roles = F.size(F.array_distinct(F.transform("turns", lambda c: c["role"])))
    return _nested(t).select("conv_id", F.size("turns").cast("long").alias("turns"), F.size(own).cast("long").alias("own"), F.size(others).cast("long").alias("others"), roles.cast("long").alias("roles"))


@query("""with r as (select conv_id, turn, role, case when turn % 3 = 1 then 'user' when turn % 3 = 2 then 'assistant' end as at from conversations)
select a.conv_id, a.turn, max(b.turn) as parent_turn from r a left join r b on a.conv_id = b.conv_id and b.role = a.at and b.turn < a.turn group by all""")
def thread_link_mentioned(t):
    # the parent is the last turn so far of whom the turn mentions, whoever that is: one pass over each thread
    at = F.when(F.col("turn") % 3 == 1, "user").when(F.col("turn") % 3 == 2, "assistant")
    c = t("conversations").select("conv_id", "turn", "role", at.alias("at"))
    said = c.select("conv_id", F.col("turn").alias("place"), F.col("role").alias("who"), F.col("turn").alias("spoke"), F.lit(None).cast("long").alias("asks"))
    asks = c.select("conv_id", F.col("turn").alias("place"), F.col("at").alias("who"), F.lit(None).cast("long").alias("spoke"), F.col("turn").alias("asks"))
    w = Window.partitionBy("conv_id", "who").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    both = said.unionByName(asks).withColumn("parent_turn", F.max("spoke").over(w)).where("asks is not null")
    return both.select("conv_id", F.col("asks").alias("turn"), F.when(F.col("who").isNotNull(), F.col("parent_turn")).alias("parent_turn"))


@query("select page_id, min(split_part(url, '/', 3)) as owner from pages group by page_id")
def shortcode_owner_map(t):
    return t("pages").groupBy("page_id").agg(F.min(F.split_part("url", F.lit("/"), F.lit(3))).alias("owner"))


DATES = ["2024-03-01T10:20:30.000Z", "2024-03-01T10:20:30Z", "2024-02-30T10:00:00Z", None, "yesterday", "2023-12-31T23:59:59+00:00"]


@query(f"select o_orderkey, strftime(try_cast(left(s, 19) as timestamp), '%Y-%m-%d %H:%M:%S') as at from {shaped_sql(DATES, 'orders', 'o_orderkey')}")
def date_dom_time(t):
    at = F.try_to_timestamp(F.left("s", F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return shaped(t, DATES, "orders", "o_orderkey").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


_HEADS = ["ftyp", "moof", "free", None]
_MEDIA = f"""m as (select page_id, ([{', '.join('null' if x is None else quoted(x) for x in _HEADS)}])[(page_id % 4)::int + 1] as tag, 1700000000 + page_id * 3600 as expires from pages),
k as (select page_id, expires, case when tag = 'ftyp' then 'complete' when tag = 'moof' then 'fragment' when tag is not null then 'odd' when expires < 1700360000 then 'expired' else 'absent' end as status from m)"""


def _media(t):
    tag = F.element_at(F.array(*[F.lit(x).cast("string") for x in _HEADS]), (F.col("page_id") % 4 + 1).cast("int"))
    m = t("pages").select("page_id", tag.alias("tag"), (1700000000 + F.col("page_id") * 3600).alias("expires"))
    status = R.cascade([("complete", F.col("tag") == "ftyp"), ("fragment", F.col("tag") == "moof"), ("odd", F.col("tag").isNotNull()), ("expired", F.col("expires") < 1700360000)], "absent")
    return m.withColumn("status", status)


@query(f"with {_MEDIA} select status, count(*) as n from k group by status")
def media_inventory(t):
    return _media(t).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {_MEDIA} select count(*) filter (status = 'fragment') as repairable, count(*) filter (status = 'expired') as lost, min(expires) filter (status = 'absent') as next_expiry, count(*) filter (status = 'absent' and expires < 1700360000 + 7 * 86400) as soon from k")
def media_rescue_plan(t):
    absent = F.col("status") == "absent"
    return _media(t).agg(F.count_if(F.col("status") == "fragment").alias("repairable"), F.count_if(F.col("status") == "expired").alias("lost"), F.min(F.when(absent, F.col("expires"))).alias("next_expiry"), F.count_if(absent & (F.col("expires") < 1700360000 + 7 * 86400)).alias("soon"))


TREES = [
    None, "no json", '{"a": [{"pk": "1", "user": {"username": "ana"}, "text": "hi", "created_at": 5, "comment_like_count": 2}, {"pk": "1", "user": {"username": "bob"}, "text": "x", "created_at": 6, "comment_like_count": 0}]}',
    '[{"code": "S3", "taken_at": 1700000003, "usertags": {"in": [{"user": {"username": "kim"}}, {"user": {"username": "kim"}}, {"user": {}}]}}, {"code": "T", "taken_at": 1600000000}]',
    '{"x": {"y": {"pk": "7", "user": {"username": "lee"}, "text": " ", "created_at": 9, "comment_like_count": 1, "replies": [{"pk": "8", "user": {"username": "ana"}, "text": "yes", "created_at": 10, "comment_like_count": 0}]}}}',
]


@query(f"select page_id, case page_id % 5 when 2 then 5 when 3 then 9 when 4 then 6 else 0 end::int as objects from pages")
def json_walk(t):
    return shaped(t, TREES, "pages", "page_id").select("page_id", F.size(J.objects("s")).alias("objects"))


@query("""select page_id, pk, author, said, created::bigint as created, likes::bigint as likes from pages join (values (2, '1', 'ana', 'hi', 5, 2), (4, '7', 'lee', '[image]', 9, 1), (4, '8', 'ana', 'yes', 10, 0)) v(m, pk, author, said, created, likes) on page_id % 5 = m""")
def json_comments(t):
    return J.comments(shaped(t, TREES, "pages", "page_id"), "page_id", "s")


@query("select page_id, 'kim' as tagged from pages where page_id % 5 = 3")
def json_usertags(t):
    return J.usertags(shaped(t, TREES, "pages", "page_id"), "page_id", "s")


@query("select page_id, case when page_id % 2 = 0 then 1600000000 else 1700000003 end::bigint as taken from pages where page_id % 5 = 3")
def json_post_date(t):
    d = shaped(t, TREES, "pages", "page_id").withColumn("code", F.when(F.col("page_id") % 2 == 0, "T").otherwise("none"))
    return J.post_date(d, "page_id", "s", "code").select("page_id", F.unix_timestamp("taken").alias("taken"))
