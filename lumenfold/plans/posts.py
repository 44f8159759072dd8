"""Registered queries on posts, pages and threads: URLs, markup, rules, annotation, privacy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotation as A
from ..operators import privacy as P
from ..operators import rules as R
from .registry import registrar

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

# URLs and markup

_POST_URL = "'https://site.example/u' || (page_id % 7) || case when page_id % 3 = 0 then '/reel/' else '/p/' end || 'S' || page_id || '/?a=1&igsh=z&b=2'"


@query(rf"""with u as (select page_id, {_POST_URL} as u from pages)
select page_id, 'S' || page_id as code, 'u' || (page_id % 7) as owner, replace(u, '&igsh=z', '') as kept from u""")
def url_parts(t):
    u = t("pages").select("page_id", F.expr(_POST_URL).alias("u"))
    return u.select("page_id", X.shortcode("u").alias("code"), X.url_owner("u").alias("owner"), X.url_drop_param("u", "igsh").alias("kept"))


@query("select page_id, 1700000000 + page_id * 1000 as expires, page_id < 100 as expired from pages")
def url_expiry(t):
    u = t("pages").select("page_id", F.concat(F.lit("https://cdn.example/v?oh=1&oe="), F.hex(F.lit(1700000000) + F.col("page_id") * 1000)).alias("u"))
    return u.select("page_id", X.url_expiry("u").alias("expires"), (X.url_expiry("u") < 1700100000).alias("expired"))


@query(r"""select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as links,
  length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript|template|svg)[^>]*>.*?</(script|style|noscript|template|svg)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) as visible from pages""")
def html_extract(t):
    links = X.html_links("html")
    return t("pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(links).alias("links"), F.length(X.visible_text("html")).alias("visible"))


@query("select page_id, case when html ilike '%<video%' then 'video' when html ilike '%<ul%' then 'carousel' when html ilike '%<img%' then 'image' else 'none' end as media from pages")
def html_post_media(t):
    low = F.lower("html")
    kind = R.cascade([("video", low.contains("<video")), ("carousel", low.contains("<ul")), ("image", low.contains("<img"))], "none")
    return t("pages").select("page_id", kind.alias("media"))


@query("select c_custkey, c_custkey * 3 as likes, c_custkey % 5 as replies, 'user' || c_custkey as author, 'hello ' || c_custkey as caption from customer")
def caption_header(t):
    k = F.col("c_custkey")
    head = F.format_string('%,d likes, %d comments - user%d on January 2, 2024: "hello %d"', k * 3, k % 5, k, k)
    return t("customer").select("c_custkey", head.alias("h")).select("c_custkey", X.caption_header("h").alias("p")).select("c_custkey", "p.likes", "p.replies", "p.author", "p.caption")


@query("""with c as (select conv_id, turn, coalesce(text, '') as text, first_value(coalesce(text, '')) over (partition by conv_id order by turn) as cap, min(turn) over (partition by conv_id) as t0 from conversations)
select conv_id, turn from c where turn > t0 and not (text = cap or contains(cap, left(text, 40)))""")
def caption_echo_filter(t):
    c = t("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("cap"), F.min("turn").alias("t0"))
    return c.join(first, "conv_id").where("turn > t0").where(~R.echoes(F.col("text"), F.col("cap"))).select("conv_id", "turn")


@query("select doc_id, (quality = 1)::int as flag, case when doc_id % 2 = 0 then 'past' else null end as tense from labels")
def llm_json_parse(t):
    reply = F.concat(F.lit('Sure:\n```json\n{"flag": "'), F.when(F.col("quality") == 1, "Yes").otherwise("0"), F.lit('", "tense": "'), F.when(F.col("doc_id") % 2 == 0, "past").otherwise("soon"), F.lit('"}\n``` done'))
    got = A.parse_reply(reply, ["flag"], {"tense": ["past", "present", "future"]})
    return t("labels").select("doc_id", got.alias("r")).select("doc_id", "r.flag", "r.tense")


@query("select conv_id, turn, 'TURN ' || turn || case when role is not null then ' BY ' || role else '' end || case when length(coalesce(text, '')) > 0 then ' TEXT ' || left(text, 20) else ' (none)' end as prompt from conversations")
def render_prompt(t):
    body = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.concat(F.lit("TEXT "), F.left("text", F.lit(20)))).otherwise("(none)")
    return t("conversations").select("conv_id", "turn", F.concat_ws(" ", F.concat(F.lit("TURN "), F.col("turn").cast("string")), F.concat(F.lit("BY "), "role"), body).alias("prompt"))


@query(f"""with c as (select conv_id, turn, role, trim(coalesce(text, ''), '{X.SPACES}') as body from conversations)
select conv_id, turn, 'TURN ' || turn || case when role is not null then ' BY ' || role else '' end || case when body <> '' then ' TEXT ' || body else ' (none)' end as prompt from c""")
def render_prompt_whole(t):
    text = X.stripped("text")
    body = F.when(text != "", F.concat(F.lit("TEXT "), text)).otherwise("(none)")
    return t("conversations").select("conv_id", "turn", F.concat_ws(" ", F.concat(F.lit("TURN "), F.col("turn").cast("string")), F.concat(F.lit("BY "), "role"), body).alias("prompt"))


# flattening: profiles that hold their posts, and back to rows


@query("select user_id, count(*) as declared, count(*) filter (event_type <> 'error') as extracted, round(100 * count(*) filter (event_type <> 'error') / count(*)::double, 6) as coverage from events group by user_id")
def coverage_pct(t):
    n, got = F.count("*"), F.count_if(F.col("event_type") != "error")
    return t("events").groupBy("user_id").agg(n.alias("declared"), got.alias("extracted"), F.round(F.try_divide(100 * got, n), 6).alias("coverage"))


@query("select c_custkey, o_orderkey, o_orderstatus from customer left join orders on o_custkey = c_custkey")
def flat_posts(t):
    posts = t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("posts"))
    nested = t("customer").join(posts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "posts")
    return nested.select("c_custkey", F.explode_outer("posts").alias("p")).select("c_custkey", "p.o_orderkey", "p.o_orderstatus")


# rules


@query(r"""with d as (select doc_id, coalesce(text, '') || case when doc_id % 3 = 0 then ' 12 likes' else '' end as text from documents)
select doc_id % 3 = 0 as touched, count(*) as n, sum(length(coalesce(text, '')) - case when doc_id % 3 = 0 then 9 else 0 end)::bigint as chars from d where not regexp_matches(text, '(?i)^\s*(reply|like|share)\s*$') group by 1""")
def trim_like_tail(t):
    d = t("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " 12 likes").otherwise("")).alias("text"))
    cut = d.where(~F.col("text").rlike(r"(?i)^\s*(reply|like|share)\s*$")).withColumn("cut", F.regexp_replace("text", r" \d+ likes?$", ""))
    return cut.groupBy((F.col("cut") != F.col("text")).alias("touched")).agg(F.count("*").alias("n"), F.sum(F.length("cut")).alias("chars"))


@query("""select c_custkey, case when c_acctbal < 0 then 'rejected' when c_mktsegment = 'BUILDING' and c_acctbal > 5000 then 'approved' when c_mktsegment = 'MACHINERY' then 'approved_group' else 'pending' end as verdict,
  case when c_acctbal < 0 then 'balance' when c_mktsegment = 'BUILDING' and c_acctbal > 5000 then 'own words' when c_mktsegment = 'MACHINERY' then 'segment' else 'no evidence' end as reason from customer""")
def triage_verdict(t):
    return t("customer").select("c_custkey", _triage(0).alias("v")).select("c_custkey", "v.verdict", "v.reason")


def _triage(least: float):
    return R.verdict([("rejected", "balance", F.col("c_acctbal") < least), ("approved", "own words", (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000)), ("approved_group", "segment", F.col("c_mktsegment") == "MACHINERY")], ("pending", "no evidence"))


@query("""with v as (select case when c_acctbal < 0 then 'rejected' when c_mktsegment = 'BUILDING' and c_acctbal > 5000 then 'approved' when c_mktsegment = 'MACHINERY' then 'approved_group' else 'pending' end as old,
  case when c_acctbal < 1000 then 'rejected' when c_mktsegment = 'BUILDING' and c_acctbal > 5000 then 'approved' when c_mktsegment = 'MACHINERY' then 'approved_group' else 'pending' end as new from customer)
select old, new, count(*) as n from v where old <> new group by all""")
def triage_reeval(t):
    v = t("customer").select(_triage(0)["verdict"].alias("old"), _triage(1000)["verdict"].alias("new"))
    return v.where("old <> new").groupBy("old", "new").agg(F.count("*").alias("n"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 3 when 1 then 20 when 2 then 7 end::bigint as attempts, case c_custkey % 4 when 0 then 4.0 when 1 then 2.0 when 2 then 1.5 end::double as hours,
  case c_custkey % 4 when 0 then 'mood' when 1 then 'mood' when 2 then 'anxiety' else 'other' end as dx from customer""")
def intake_parses(t):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("c_custkey") % 4 + 1).cast("int"))
    c = t("customer").select("c_custkey", pick("3", "more than 20", "5-10", "unknown").alias("a"), pick("4 h", "2-3 hrs", "1.5", "many").alias("h"), pick("F32.1", "F33", "F41", "Z9").alias("d"))
    dx = R.cascade([("mood", F.col("d").rlike("^F3")), ("anxiety", F.col("d").rlike("^F4"))], "other")
    return c.select("c_custkey", X.parse_attempts("a").alias("attempts"), X.parse_hours("h").alias("hours"), dx.alias("dx"))


@query("select c_custkey, c_name from (select c_custkey, c_name, row_number() over (order by c_custkey) as k from customer) where k between 5 and 12 or c_custkey in (1, 50)")
def flt_id_or_name_slice(t):
    # the slice is a bounded top-k, so no window over the whole table is needed
    c = t("customer").select("c_custkey", "c_name")
    sliced = c.orderBy("c_custkey").offset(4).limit(8)
    return sliced.unionByName(c.where(F.col("c_custkey").isin(1, 50))).distinct()


# joins


@query("""with k as (select c_nationkey % 3 as i, c_nationkey // 9 as j, count(*) as n from customer group by all)
select a.i, a.j, sum(b.n)::bigint as neighbours from k a join k b on abs(a.i - b.i) + abs(a.j - b.j) between 1 and 2 group by all""")
def jn_theta_strata(t):
    # strata are few and fixed in number; each names its neighbours, so the join is on equal strata
    k = t("customer").groupBy((F.col("c_nationkey") % 3).alias("i"), F.floor(F.col("c_nationkey") / 9).alias("j")).agg(F.count("*").alias("n"))
    near = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if 1 <= abs(a) + abs(b) <= 2]
    hop = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near]))
    asks = k.select("i", "j", hop.alias("h")).select("i", "j", (F.col("i") + F.col("h.a")).alias("i2"), (F.col("j") + F.col("h.b")).alias("j2"))
    b = k.select(F.col("i").alias("i2"), F.col("j").alias("j2"), "n")
    return asks.join(b, ["i2", "j2"]).groupBy("i", "j").agg(F.sum("n").alias("neighbours"))


@query("""with r as (select c_custkey as id, 1 as p, 'own' as why from customer where c_acctbal < 0 union all select o_custkey, 2, 'author' from orders where o_totalprice > 200000 union all select c_custkey, 3, 'mention' from customer where c_mktsegment = 'HOUSEHOLD')
select id, arg_min(why, p) as reason from r group by id""")
def jn_network_exclusion(t):
    c, o = t("customer"), t("orders")
    return R.exclusions([("own", c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))), ("author", o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))), ("mention", c.where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("id")))])


# text


@query(r"""select doc_id, len(list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '#[\p{L}\p{N}_]+', ' ', 'g'), '@[\p{L}\p{N}_.]+', ' ', 'g'), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{Lu}{3,}'))) as caps,
  regexp_matches(text, '\S') and not regexp_matches(text, '\p{L}') as symbols_only, trim(text) = '' as blank from documents where text is not null""")
def txt_caps_words(t):
    d = t("documents").where("text is not null")
    return d.select("doc_id", X.caps_words("text").alias("caps"), (F.col("text").rlike(r"\S") & ~F.col("text").rlike(r"\p{L}")).alias("symbols_only"), (F.trim("text") == "").alias("blank"))


@query(r"""with k as (select doc_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '#[\p{L}\p{N}_]+', ' ', 'g'), '@[\p{L}\p{N}_.]+', ' ', 'g'), '\p{L}+(?:''\p{L}+)?'), lambda x: lower(x)) as w from documents),
n as (select doc_id, len(w) as k, len(list_filter(w, lambda x: x in ('the', 'and', 'of', 'to', 'is'))) as en, len(list_filter(w, lambda x: x in ('el', 'la', 'de', 'que', 'y'))) as es from k)
select doc_id, case when k < 2 then null when en >= 2 and en > es then 'en' else 'es' end as guess from n""")
def txt_language(t):
    return t("documents").select("doc_id", X.language(X.tokens("text"), ["the", "and", "of", "to", "is"], ["el", "la", "de", "que", "y"]).alias("guess"))


@query("select c_custkey, c_custkey * 1000 as plain, c_custkey * 1200 as thousands, c_custkey || '/' || (c_custkey + 3) || ' (' || printf('%.1f', 100 * c_custkey / (c_custkey + 3)::double) || '%)' as pct, 'v' || (c_custkey % 10) as folded from customer")
def txt_number_forms(t):
    k = F.col("c_custkey")
    sup = F.translate((k % 10).cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    return t("customer").select("c_custkey", X.parse_count(F.format_string("%,d", k * 1000)).alias("plain"), X.parse_count(F.format_string("%.1fK", k * 1.2)).alias("thousands"), X.fmt_pct(k, k + 3).alias("pct"), X.fold_digits(F.concat(F.lit("v"), sup)).alias("folded"))


# annotation


@query("""with p as (select doc_id, source, row_number() over (partition by source order by md5('9:' || doc_id), doc_id) as k from documents where text is not null)
select source, row_number() over (partition by source order by md5('s:' || doc_id), doc_id) as code, doc_id from p where k <= 5""")
def an_blind_export(t):
    return A.blind_key(t("documents").where("text is not null"), "source", "doc_id", cap=5)


@query(ORACLES["an_blind_export"].replace("k <= 5", "k <= 20"))
def an_blind_export_20(t):
    return A.blind_key(t("documents").where("text is not null"), "source", "doc_id", cap=20)


@query("select doc_id, case when quality = toxic then quality end::bigint as consensus, greatest(quality, toxic)::bigint as either, quality <> toxic as disputed from labels")
def an_consensus(t):
    return t("labels").select("doc_id", A.consensus("quality", "toxic").cast("long").alias("consensus"), F.greatest("quality", "toxic").cast("long").alias("either"), (F.col("quality") != F.col("toxic")).alias("disputed"))


@query("""with r as (select doc_id, quality as a1, (quality + (doc_id % 11 = 0)::int) % 2 as b1, toxic as a2, (toxic + (doc_id % 7 = 0)::int) % 2 as b2 from labels)
select doc_id, concat_ws(',', case when a1 <> b1 then 'quality' end, case when a2 <> b2 then 'toxic' end) as categories from r where a1 <> b1 or a2 <> b2""")
def an_disagreement_queue(t):
    flip = lambda c, m: (F.col(c) + (F.col("doc_id") % m == 0).cast("int")) % 2
    r = t("labels").select("doc_id", F.col("quality").alias("a_quality"), flip("quality", 11).alias("b_quality"), F.col("toxic").alias("a_toxic"), flip("toxic", 7).alias("b_toxic"))
    return A.disagreements(r, ["quality", "toxic"]).select("doc_id", "categories")


@query("""with s as (select doc_id, row_number() over (order by md5('v:' || doc_id), doc_id) as k, count(*) over () as n from labels where quality = toxic) select doc_id from s where k <= greatest(1, round(0.2 * n))""")
def an_validity_sample(t):
    return A.validity_sample(t("labels").where("quality = toxic"), "doc_id").select("doc_id")


# privacy


@query("""with f as (select conv_id, role, min(turn) as seen from conversations group by all) select conv_id, role, 'Anonymous ' || row_number() over (partition by conv_id order by seen) as alias from f""")
def pv_pseudonym_map(t):
    return P.pseudonyms(t("conversations"), "conv_id", "role", "turn")


@query("""with m as (select conv_id, role, 'Anonymous ' || row_number() over (partition by conv_id order by seen) as alias from (select conv_id, role, min(turn) as seen from conversations group by all))
select c.conv_id, c.turn, 'seen by ' || m.alias || '!' as said from conversations c join m using (conv_id, role)""")
def pv_rewrite_text(t):
    c = t("conversations").select("conv_id", "turn", F.concat(F.lit("seen by @"), "role", F.lit("!")).alias("said"))
    m = P.pseudonyms(t("conversations"), "conv_id", "role", "turn")
    return P.rewrite_mentions(c, m, "conv_id", "said", "role", "alias").select("conv_id", "turn", "said")


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_.]+')) as w from documents) select w as handle, count(*) as hits, count(distinct doc_id) as rows_n from w where w in (select lower(n_name) from nation) group by 1""")
def pv_leak_check(t):
    return P.leaks(t("documents"), "doc_id", "text", t("nation").select(F.lower("n_name").alias("handle")))


# incremental


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def inc_resume(t):
    from ..streaming.incremental import resume

    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume(t("orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, count(distinct k) as sessions from s group by 1""")
def win_sessions(t):
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("select conv_id, turn, last_value(turn) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as before from conversations")
def thread_previous(t):
    return t("conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
