"""Registered queries on cohorts: tables of a study, envelopes, coverage, sampling, samples of raters, contrasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import style as Y
from ..functions import text as X
from ..operators import cohorts as C
from ..operators import rules as R
from ..operators import statistics as S
from .registry import registrar
from .shapes import quoted, shaped, shaped_sql
from .style import BANKS, WINDOWED, counted, counts_sql, posts, windowed
from .style import POSTS as POSTS_SQL

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
r6 = lambda c: F.round(c, 6)

# cohorts that overlap: all customers, those with orders, those with a large order

_COHORT = """o as (select o_custkey, max(o_totalprice) as top from orders group by 1),
m as (select c.*, unnest(list_filter(['all', case when top is not null then 'ordered' end, case when top > 200000 then 'large' end], lambda x: x is not null)) as cohort from customer c left join o on o_custkey = c_custkey)"""


def _members(t):
    top = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    c = t("customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left")
    return C.cohorts(c, {"all": F.lit(True), "ordered": F.col("top").isNotNull(), "large": F.col("top") > 200000})


@query(f"""with {_COHORT}, i as (select cohort, c_custkey, unnest([{{'variable': 'solvent', 'v': case when c_acctbal is not null then (c_acctbal > 0)::int end}}, {{'variable': 'building', 'v': (c_mktsegment = 'BUILDING')::int}}, {{'variable': 'east', 'v': case when c_nationkey % 4 > 0 then (c_nationkey > 12)::int end}}], recursive := true) from m)
select variable, count(*) filter (cohort = 'all' and v = 1) as all_k, count(v) filter (cohort = 'all') as all_n, count(*) filter (cohort = 'ordered' and v = 1) as ordered_k, count(v) filter (cohort = 'ordered') as ordered_n, count(*) filter (cohort = 'large' and v = 1) as large_k, count(v) filter (cohort = 'large') as large_n from i group by variable""")
def agg_table1(t):
    items = {"solvent": F.col("c_acctbal") > 0, "building": F.col("c_mktsegment") == "BUILDING", "east": F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey") > 12)}
    return C.table1(_members(t), items, ["all", "ordered", "large"])


@query(f"with {_COHORT} select cohort, count(*) as n, median(c_acctbal) as median, (list_sort(list(c_acctbal)))[count(*) // 4 + 1] as q1, (list_sort(list(c_acctbal)))[3 * count(*) // 4 + 1] as q3 from m group by cohort")
def agg_table1_medians(t):
    m, n = _members(t), F.col("n")
    plain = m.groupBy("cohort").agg(F.count("*").alias("n"), F.median("c_acctbal").alias("median"))
    return plain.join(S.order_statistics(m, ["cohort"], "c_acctbal", {"q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)}), "cohort")


@query(f"""with {_COHORT}, i as (select cohort, unnest([{{'item': 'balance high', 'v': case when c_custkey % 7 > 0 then c_acctbal > 5000 end}}, {{'item': 'machinery', 'v': c_mktsegment = 'MACHINERY'}}], recursive := true) from m)
select item, count(v) filter (cohort = 'all') as all_n, count(*) filter (cohort = 'all' and v) as all_k, round(100 * count(*) filter (cohort = 'all' and v) / nullif(count(v) filter (cohort = 'all'), 0)::double, 1) as all_pct,
  count(v) filter (cohort = 'large') as large_n, count(*) filter (cohort = 'large' and v) as large_k, round(100 * count(*) filter (cohort = 'large' and v) / nullif(count(v) filter (cohort = 'large'), 0)::double, 1) as large_pct from i group by item""")
def agg_self_report(t):
    items = {"balance high": F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal") > 5000), "machinery": F.col("c_mktsegment") == "MACHINERY"}
    s = C.table1(_members(t), items, ["all", "large"]).withColumnRenamed("variable", "item")
    pct = lambda c: F.round(100 * F.col(f"{c}_k") / F.nullif(F.col(f"{c}_n"), F.lit(0)), 1).alias(f"{c}_pct")
    return s.select("item", *[x for c in ("all", "large") for x in (f"{c}_n", f"{c}_k", pct(c))])


@query(f"""with {POSTS_SQL}, p as (select user_id, user_id % 2 as grp, ts, media, len(list_filter(string_split_regex(coalesce(caption, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) as w from posts),
a as (select grp, user_id, count(*) as n, sum(w) as words, row_number() over (partition by grp order by count(*) desc, user_id) as k from p group by grp, user_id),
x as (select grp, count(*) as accounts, median(n) as per_account, min(n) as least, max(n) as most, sum(n) filter (k <= 4) as top4, count(*) filter (words = 0) as wordless, (list_sort(list(n)))[floor(0.25 * (count(*) - 1))::int + 1] as q1, (list_sort(list(n)))[floor(0.75 * (count(*) - 1))::int + 1] as q3 from a group by grp)
select p.grp, any_value(accounts) as accounts, count(*) as posts, any_value(per_account) as per_account, any_value(q1) as q1, any_value(q3) as q3, any_value(least) as least, any_value(most) as most, round(100 * any_value(top4) / count(*)::double, 6) as top4_pct, any_value(wordless) as wordless,
  sum(w)::bigint as words, median(w) as words_median, round(100 * count(*) filter (w > 0) / count(*)::double, 6) as with_text_pct, round(100 * count(*) filter (w > 10) / count(*)::double, 6) as over_10_pct, round(100 * count(*) filter (media = 'view') / count(*)::double, 6) as video_pct,
  min(ts)::date::varchar as first_post, max(ts)::date::varchar as last_post, round(100 * count(*) filter (date_diff('day', ts::date, date '2024-01-31') <= 7) / count(*)::double, 6) as last_week_pct from p join x using (grp) group by p.grp""")
def agg_corpus_describe(t):
    p = posts(t).withColumn("grp", F.col("user_id") % 2).withColumn("words", X.word_count("caption"))
    return C.describe(p, "grp", "user_id", "words", F.col("media") == "view", "ts", "2024-01-31", 7)


@query("""with e as (select user_id, count(*) as n from events group by 1), m as (select event_type, count(*) as k from events group by 1)
select min(n) as least, max(n) as most, quantile_cont(n, 0.25) as p25, median(n) as mid, quantile_cont(n, 0.75) as p75, greatest(0, floor(min(n) * 0.5))::bigint as admit_lo, floor(quantile_cont(n, 0.9) * 1.5)::bigint as admit_hi,
  (select round(k / sum(k) over ()::double, 6) from m qualify event_type = 'view') as views from e""".replace("(select round(k / sum(k) over ()::double, 6) from m qualify event_type = 'view')", "(select round(max(k) filter (event_type = 'view') / sum(k)::double, 6) from m)"))
def agg_envelope(t):
    e = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("v"))
    return C.envelope(e, "n").crossJoin(e.agg(r6(F.sum("v") / F.sum("n")).alias("views")))


@query(f"with {_COHORT}, d as (select cohort, o_orderdate::date as day from m join orders on orders.o_custkey = c_custkey) select cohort, min(day)::varchar as first, max(day)::varchar as last from d where day >= date '1995-06-01' group by cohort")
def agg_date_range(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    d = _members(t).select("cohort", "c_custkey").join(o, F.col("k") == F.col("c_custkey")).where("day >= date'1995-06-01'")
    return d.groupBy("cohort").agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"))


@query("select distinct lower(h) as handle from (select n_name as h from nation union all select role from conversations union all select split_part(c_name, '#', 1) from customer) where h is not null")
def agg_distinct_handles(t):
    return C.distinct_handles([t("nation").select(F.col("n_name").alias("h")), t("conversations").select(F.col("role").alias("h")), t("customer").select(F.split_part("c_name", F.lit("#"), F.lit(1)).alias("h"))])


@query("select event_type, bool_or(value > 99) as any_high, bool_or(value < 0) as any_negative from events group by event_type")
def agg_any_flag(t):
    return t("events").groupBy("event_type").agg(F.bool_or(F.col("value") > 99).alias("any_high"), F.bool_or(F.col("value") < 0).alias("any_negative"))


@query(f"with {counts_sql()}, {WINDOWED} select user_id, round(avg(words) filter (win = 'base'), 6) as base, round(avg(words) filter (win = 'peri'), 6) as peri from windowed group by user_id")
def agg_feature_plot(t):
    side = lambda w: r6(F.avg(F.when(F.col("win") == w, F.col("words"))))
    return windowed(t).groupBy("user_id").agg(side("base").alias("base"), side("peri").alias("peri"))


@query("select c_nationkey as seed, count(*) filter (c_acctbal > 0) as good, count(*) as total from customer group by 1")
def agg_seed_yield(t):
    return t("customer").groupBy(F.col("c_nationkey").alias("seed")).agg(F.count_if(F.col("c_acctbal") > 0).alias("good"), F.count("*").alias("total"))


@query(rf"""with d as (select case when quality = 1 and toxic = 1 then 'both' when quality = 1 then 'only a' when toxic = 1 then 'only b' else 'neither' end as class, coalesce(text, '') as text, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) as w from labels join documents using (doc_id))
select class, count(*) as n, round(100 * count(*) filter (not regexp_matches(text, '\S')) / count(*)::double, 6) as no_text_pct, round(100 * count(*) filter (regexp_matches(text, '{Y.EMOJI}')) / count(*)::double, 6) as emoji_pct, median(w) as words_median from d group by class""")
def agg_disagreement_profile(t):
    kind = R.cascade([("both", (F.col("quality") == 1) & (F.col("toxic") == 1)), ("only a", F.col("quality") == 1), ("only b", F.col("toxic") == 1)], "neither")
    text = F.coalesce("text", F.lit(""))
    share = lambda c: r6(100 * F.count_if(c) / F.count("*"))
    d = t("labels").join(t("documents").select("doc_id", "text"), "doc_id").select(kind.alias("class"), text.alias("text"), X.word_count("text").alias("w"))
    return d.groupBy("class").agg(F.count("*").alias("n"), share(~F.col("text").rlike(r"\S")).alias("no_text_pct"), share(F.col("text").rlike(Y.EMOJI)).alias("emoji_pct"), F.median("w").alias("words_median"))


_COVER = "c as (select user_id, count(*) + user_id % 9 as declared, count(*) as taken, 100 * count(*) / (count(*) + user_id % 9)::double as cov from events group by user_id)"


@query(f"with {_COVER} select count(*) as accounts, round(avg(cov), 6) as mean, round(median(cov), 6) as median, count(*) filter (declared >= 15 and cov < 95) as below from c")
def agg_coverage(t):
    return C.coverage(_declared(t), "declared", "taken", 95.0).select("accounts", r6("mean").alias("mean"), r6("median").alias("median"), "below")


def _declared(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("taken")).withColumn("declared", F.col("taken") + F.col("user_id") % 9)


@query(f"with {_COVER} select user_id, declared, taken from c where declared >= 15 and cov < 95")
def agg_coverage_short(t):
    return C.short_of(_declared(t), "declared", "taken", 95.0).select("user_id", "declared", "taken")


@query("select role, sum(length(coalesce(text, '')))::bigint as units, round(sum(length(coalesce(text, ''))) * 3.5 / 1e6 / count(distinct conv_id), 9) as per_thread from conversations group by role")
def agg_api_cost(t):
    units = F.sum(F.length(F.coalesce("text", F.lit(""))))
    return t("conversations").groupBy("role").agg(units.alias("units"), F.round(units * 3.5 / 1e6 / F.countDistinct("conv_id"), 9).alias("per_thread"))


# order and sampling


@query("""with r as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by md5('p:' || c_custkey), c_custkey) as k from customer) select c_custkey, c_nationkey, k from r order by k, c_nationkey limit 40""")
def win_round_robin(t):
    return C.round_robin(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 40, "p")


@query("""with e as (select user_id, event_id, ts, event_type = 'error' as bad, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
select event_id, user_id, case when bad then row_number() over (partition by user_id, island, bad order by ts, event_id) else 0 end as run from e""")
def win_run_of_failures(t):
    return C.runs(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "run")


@query("select doc_id, row_number() over (order by quality nulls last, doc_id) as place from documents left join (select doc_id, quality from labels) using (doc_id)")
def srt_nan_last(t):
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return S.placed(d, -F.col("quality"), "doc_id").select("doc_id", "place")


@query("select o_orderkey, row_number() over (partition by o_custkey order by case when o_orderkey % 6 > 0 then o_orderdate end desc nulls last, o_orderkey) as place from orders")
def srt_desc_date(t):
    o = t("orders").withColumn("day", F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderdate")))
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("day").desc_nulls_last(), "o_orderkey")).alias("place"))


@query("""with p as (select s_suppkey, c_custkey, abs(s_nationkey % 5 - c_nationkey % 5) as far, round(abs(s_acctbal - c_acctbal), 2) as apart from supplier join customer on s_nationkey // 5 = c_nationkey // 5)
select s_suppkey, c_custkey, place from (select *, row_number() over (partition by s_suppkey order by far, apart, c_custkey) as place from p) where place <= 3""")
def srt_multi_key(t):
    side = lambda table, p, key: t(table).select(F.col(key), F.floor(F.col(f"{p}_nationkey") / 5).alias("block"), (F.col(f"{p}_nationkey") % 5).alias("level"), F.col(f"{p}_acctbal").alias("score"))
    p = C.nearest_candidates(side("supplier", "s", "s_suppkey"), side("customer", "c", "c_custkey"), "block", "level", "score", "c_custkey", 3, slack=0.02)
    p = p.select(F.col("l_s_suppkey").alias("s_suppkey"), F.col("r_c_custkey").alias("c_custkey"), F.abs(F.col("l_level") - F.col("r_level")).alias("far"), F.round(F.abs(F.col("l_score") - F.col("r_score")), 2).alias("apart"))
    return C.nearest(p, ["s_suppkey"], ["far", F.col("apart").asc_nulls_last(), "c_custkey"], 3).select("s_suppkey", "c_custkey", "place")


@query("""with s as (select c_custkey as k, 1 as stage, c_acctbal as v from customer union all select o_custkey, 2, max(o_totalprice) from orders group by o_custkey)
select k, stage, v from (select *, row_number() over (partition by k order by stage desc) as n from s) where n = 1""")
def set_upsert_stage(t):
    a = t("customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("stage"), F.col("c_acctbal").alias("v"))
    b = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).select("k", F.lit(2).alias("stage"), "v")
    return C.upsert([a, b], ["k"], "stage")


@query("select l.doc_id, quality, source as win from labels l join (select doc_id, source from documents where text is not null) k on k.doc_id = l.doc_id")
def jn_label_key(t):
    key = t("documents").where("text is not null").select("doc_id", F.col("source").alias("win"))
    return t("labels").select("doc_id", "quality").join(key, "doc_id")


@query("""with f as (select 'c' || c_custkey as id, c_acctbal as v from customer union all select 's' || s_suppkey, s_acctbal from supplier)
select n_name, id, v from nation join (select c_nationkey as k, 'c' || min(c_custkey) as id from customer group by 1 union all select s_nationkey, 's' || min(s_suppkey) from supplier group by 1) w on n_nationkey = k join f using (id)""")
def jn_multi_lookup(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    f = t("customer").select(name("c", "c_custkey").alias("id"), F.col("c_acctbal").alias("v")).unionByName(t("supplier").select(name("s", "s_suppkey").alias("id"), F.col("s_acctbal").alias("v")))
    w = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("m")).select("k", name("c", "m").alias("id")).unionByName(t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("m")).select("k", name("s", "m").alias("id")))
    return w.join(t("nation").select("n_nationkey", "n_name"), F.col("k") == F.col("n_nationkey")).join(f, "id").select("n_name", "id", "v")


@query("select event_id from events where json_extract_string(props, '$.k')::int % 2 = 0 or json_extract_string(props, '$.k') is null")
def flt_own_posts(t):
    own = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return t("events").where(F.coalesce(own, F.lit(True))).select("event_id")


_STATUS = ["public_with_posts", "private", "missing", "public_without_posts", None]


@query(f"select c_custkey from {shaped_sql(_STATUS)} where s = 'public_with_posts'")
def flt_account_status(t):
    return shaped(t, _STATUS).where("s = 'public_with_posts'").select("c_custkey")


_CHROME = r"(?i)^\s*(reply|like|share|see translation)\s*$|view all \d+ replies|hidden by"
_ROWS = ["a fine day", "Reply", None, "View all 12 replies", "seen with ana.b and luis_99 12 likes", "hidden by author", "so good 3 likes", "ana.b"]


@query(rf"""with r as (select conv_id, turn, s, coalesce(regexp_matches(s, {quoted(_CHROME)}), false) as chrome from (select conv_id, turn, ([{', '.join('null' if x is None else quoted(x) for x in _ROWS)}])[((conv_id + turn) % 8)::int + 1] as s from conversations))
select chrome, count(*) as n, count(*) filter (regexp_matches(coalesce(s, ''), ' \d+ likes?$'))::bigint as trimmed, coalesce(sum(length(regexp_replace(s, ' \d+ likes?$', ''))), 0)::bigint as chars, array_to_string(list_sort(list_distinct(flatten(list(list_filter(regexp_extract_all(lower(coalesce(s, '')), '[a-z0-9_.]+'), lambda w: length(w) between 4 and 30 and not regexp_matches(w, '^[0-9.]+$') and w not in ('seen', 'with', 'likes')))))), ' ') as handles from r group by chrome""")
def split_clean_discard(t):
    text = F.element_at(F.array(*[F.lit(x).cast("string") for x in _ROWS]), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    c = t("conversations").select("conv_id", "turn", text.alias("s"))
    return C.split_rows(c, "s", _CHROME, r" \d+ likes?$", ["seen", "with", "likes"])


@query("""with h as (select doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.]+')), lambda w: length(w) between 4 and 30 and not regexp_matches(w, '^[0-9.]+$') and w not in ('that', 'with')) as h from documents) select doc_id, len(h) as n, list_min(h) as first from h""")
def txt_extract_handles(t):
    h = X.handles_in("text", ["that", "with"])
    return t("documents").select("doc_id", h.alias("h")).select("doc_id", F.size("h").alias("n"), F.array_min("h").alias("first"))


# arrays, maps, structs


@query("""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]+') as w from documents)
select doc_id, len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] is not null and p[2] is not null and p[1] < p[2])) as rises, array_to_string(w[1:40], ' ') as head, len(array_to_string(w[1:40], ' ').split(' ')) as pieces, list_max(list_transform(w, lambda x: length(x))) as longest from w""")
def arr_operators(t):
    w = F.col("w")
    d = t("documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a < b)
    head = F.array_join(F.slice(w, 1, 40), " ")
    return d.select("doc_id", F.size(F.filter(pairs, lambda x: x)).alias("rises"), head.alias("head"), F.size(F.split(head, " ")).alias("pieces"), F.length(X.longest(w)).alias("longest"))


@query("with c as (select source, lang, count(*) as n from documents group by all) select source, array_to_string(list_sort(list(lang || '=' || n)), ',') as counts from c where lang is not null group by source")
def map_counter(t):
    m = C.counter(t("documents"), ["source"], "lang")
    return m.select("source", F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("counts"))


@query("""select o_orderkey, o_orderstatus as status, case when o_orderkey % 2 = 0 then 'checked' else o_orderpriority end as note, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as at from orders""")
def struct_merge(t):
    base = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    late = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "checked").alias("note"), F.col("o_orderdate").alias("at"))
    o = t("orders").select("o_orderkey", C.merged_struct(base, ["status", "note"], late, ["note", "at"]).alias("m"))
    return o.select("o_orderkey", F.to_json("m", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("j")).select("o_orderkey", *[F.get_json_object("j", f"$.{c}").alias(c) for c in ("status", "note", "at")])


# raters


_RATED = """k as (select doc_id, user_id, win from windowed), r as (select l.doc_id, quality as a, toxic as b, case when quality = toxic then quality end as both_agree, greatest(quality, toxic) as either from labels l)"""


@query("select doc_id, greatest(quality, toxic, case when doc_id % 3 = 0 then 1 when doc_id % 3 = 1 then 0 end)::bigint as marked from documents left join labels using (doc_id)")
def an_any_marker(t):
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    third = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 0)
    return d.select("doc_id", F.greatest("quality", "toxic", third).cast("long").alias("marked"))


def _paired_sql(test: str, source: str) -> str:
    d = "(w - mean - case when w > mean then 0.5 else -0.5 end) / sqrt(nullif(var, 0))"
    return f"""e as (select {test} as test, user_id, avg(v) filter (win = 'peri') as p1, avg(v) filter (win = 'base') as p0, sum(v) filter (win = 'peri') as k1, sum(v) filter (win = 'base') as k0, count(v) filter (win = 'peri') as n1, count(v) filter (win = 'base') as n0 from {source} group by all),
f as (select *, round(p1 - p0, 9) as d from e where p1 is not null and p0 is not null),
c1 as (select test, count(*) as n, count(*) filter (d > 0) as up, count(*) filter (d < 0) as down, median(d) as diff, sum(k1)::bigint as k1, sum(n1)::bigint as n1, sum(k0)::bigint as k0, sum(n0)::bigint as n0 from f group by test),
rk as (select test, d, rank() over (partition by test order by abs(d)) + (count(*) over (partition by test, abs(d)) - 1) / 2.0::double as mid, count(*) over (partition by test, abs(d)) as ties from f where d <> 0),
ws as (select test, count(*) as m, coalesce(sum(mid) filter (d > 0), 0) as w, sum(ties * ties - 1.0::double) as tt from rk group by test),
wz as (select *, m * (m + 1) / 4.0::double as mean, m::double * (m + 1) * (2 * m + 1) / 24 - tt / 48 as var from ws),
wp as (select test, case when m >= 5 then case when var <= 0 then 1.0 else least(1.0, 2 * {N.normal_tail_sql(d)}) end end as wp from wz),
sp as (select c1.*, wp, case when up + down > 0 then least(1.0, 2 * (select sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))) from unnest(range(0, least(up, down) + 1)) u(i))) end as sign_p from c1 left join wp using (test)),
bh as (select *, case when wp is not null then wp * count(wp) over () / row_number() over (order by wp nulls last, test) end as raw, row_number() over (order by wp nulls last, test) as pl from sp),
out_ as (select test, n, up, down, round(diff, 6) as diff, k1, n1, k0, n0, round(sign_p, 6) as sign_p, round(wp, 6) as wilcoxon_p, case when wp is not null then round(least(1.0, min(raw) over (order by pl rows between current row and unbounded following)), 6) end as q from bh)"""


def _tested(df):
    return df.select("test", "n", "up", "down", r6("diff").alias("diff"), "k1", "n1", "k0", "n0", r6("sign_p").alias("sign_p"), r6("wilcoxon_p").alias("wilcoxon_p"), r6("q").alias("q"))


@query(f"""with {counts_sql()}, {WINDOWED}, lw as (select user_id, win, unnest([{{'cat': 'night', 'v': night}}, {{'cat': 'video', 'v': video}}, {{'cat': 'weekend', 'v': weekend}}, {{'cat': 'long', 'v': (words > 100)::int}}, {{'cat': 'marked', 'v': case when words > 0 then (exclaims > 0)::int end}}], recursive := true) from windowed), {_paired_sql('cat', 'lw')} select * from out_""")
def an_contrast(t):
    cats = {"night": F.col("night"), "video": F.col("video"), "weekend": F.col("weekend"), "long": (F.col("words") > 100).cast("int"), "marked": F.when(F.col("words") > 0, (F.col("exclaims") > 0).cast("int"))}
    long = windowed(t).select("user_id", "win", F.explode(F.array(*[F.struct(F.lit(n).alias("cat"), c.alias("v")) for n, c in cats.items()])).alias("x")).select("user_id", "win", "x.cat", "x.v")
    return _tested(S.paired_contrast(long, "cat", "user_id", "win", "v").withColumnRenamed("cat", "test"))


_VERSIONS = """rr as (select doc_id, (words > 100)::int as a, (exclaims + capitals + dots > 0)::int as b, win, user_id, day <= anchor as pre from windowed),
lw as (select user_id, win, unnest(list_filter([{'version': 'a', 'v': a}, {'version': 'b', 'v': b}, {'version': 'consensus', 'v': case when a = b then a end}, {'version': 'union', 'v': greatest(a, b)}, case when win = 'base' or pre then {'version': 'pre', 'v': greatest(a, b)} end], lambda x: x is not null), recursive := true) from rr)"""


@query(f"with {counts_sql()}, {WINDOWED}, {_VERSIONS}, {_paired_sql('version', 'lw')} select * from out_")
def an_contrast_versions(t):
    w = windowed(t).withColumn("a", (F.col("words") > 100).cast("int")).withColumn("b", (F.col("exclaims") + F.col("capitals") + F.col("dots") > 0).cast("int"))
    pre = (F.col("win") == "base") | (F.to_date("ts") <= F.col("anchor"))
    return _tested(S.paired_contrast(C.versions(w, "a", "b", pre), "version", "user_id", "win", "v").withColumnRenamed("version", "test"))


@query(f"with {counts_sql()}, {WINDOWED} select count(*) as posts, count(distinct user_id) as accounts, count(*) filter (win = 'peri') as peri, count(*) filter (win = 'base') as base, count(*) filter (words > 0) as with_text, sum(words)::bigint as words, median(words) filter (words > 0) as words_median, count(*) filter (words > 10) as over_10, count(*) filter (words > 20) as over_20, sum(video)::bigint as video from windowed")
def an_kit_describe(t):
    n = lambda c: F.count_if(F.expr(c))
    return windowed(t).agg(F.count("*").alias("posts"), F.countDistinct("user_id").alias("accounts"), n("win = 'peri'").alias("peri"), n("win = 'base'").alias("base"), n("words > 0").alias("with_text"), F.sum("words").alias("words"), F.median(F.when(F.col("words") > 0, F.col("words"))).alias("words_median"), n("words > 10").alias("over_10"), n("words > 20").alias("over_20"), F.sum("video").cast("long").alias("video"))


# statistics


@query("select source, count(*) as n, sum(toxic)::bigint as k, case when sum(toxic) = 0 then round(3 / count(*)::double, 9) end as bound from labels join documents using (doc_id) where quality = 1 group by source")
def st_rule_of_three(t):
    l = t("labels").where("quality = 1").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    return l.select("source", "n", "k", F.round(N.rule_of_three("k", "n"), 9).alias("bound"))


@query("with c as (select lang as a, case when doc_id % 5 = 0 then 'en' else lang end as b from documents) select count(*) as n, round(avg((a is not distinct from b)::int), 6) as agree, count(*) filter (a = 'en') as a_en, count(*) filter (b = 'en') as b_en from c")
def st_categorical_agreement(t):
    c = t("documents").select(F.col("lang").alias("a"), F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("b"))
    return c.agg(F.count("*").alias("n"), r6(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int"))).alias("agree"), F.count_if(F.col("a") == "en").alias("a_en"), F.count_if(F.col("b") == "en").alias("b_en"))


_UNI = f"""u as (select c_nationkey < 10 as pos, unnest([{{'test': 'balance', 'v': c_acctbal}}, {{'test': 'key', 'v': c_custkey::double}}, {{'test': 'segment', 'v': length(c_mktsegment)::double}}], recursive := true) from customer),
rk as (select test, pos, rank() over (partition by test order by v) + (count(*) over (partition by test, v) - 1) / 2.0::double as k, count(*) over (partition by test, v) as t from u),
st as (select test, count(*) filter (pos) as n1, count(*) filter (not pos) as n0, sum(k) filter (pos) as r1, sum(t * t - 1.0::double) as ties from rk group by test),
uu as (select *, r1 - n1 * (n1 + 1) / 2.0::double as u, n1::double * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0)::double * (n1 + n0 - 1))) as var from st),
pp as (select test, u / (n1::double * n0) as auc, case when var <= 0 then 1.0 else least(1.0, 2 * {N.normal_tail_sql('(u - n1::double * n0 / 2) / sqrt(nullif(var, 0))')}) end as p from uu),
md as (select test, median(v) filter (pos) as m1, median(v) filter (not pos) as m0 from u group by test),
qq as (select pp.*, m1, m0, p * count(*) over () / row_number() over (order by p, pp.test) as raw, row_number() over (order by p, pp.test) as pl from pp join md using (test))"""


@query(f"with {_UNI} select test, round(auc, 6) as auc, round(m1, 6) as median1, round(m0, 6) as median0, case when m1 > m0 then '>' when m1 < m0 then '<' else '=' end as direction, round(p, 6) as p, round(least(1.0, min(raw) over (order by pl rows between current row and unbounded following)), 6) as q from qq")
def st_univariate_table(t):
    u = S.univariate(_features(t), "test", "v", "pos")
    return u.select("test", r6("auc").alias("auc"), r6("median1").alias("median1"), r6("median0").alias("median0"), "direction", r6("p").alias("p"), r6("q").alias("q"))


def _features(t):
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("test"), c.cast("double").alias("v")) for n, c in (("balance", F.col("c_acctbal")), ("key", F.col("c_custkey")), ("segment", F.length("c_mktsegment")))]))
    return t("customer").select((F.col("c_nationkey") < 10).alias("pos"), each.alias("x")).select("pos", "x.test", "x.v")


@query(None)
def st_univariate_ci(t):
    f = _features(t)
    u = S.univariate(f, "test", "v", "pos").select("test", "p", "q").join(S.delong(f, "test", "v", "pos"), "test")
    return u.select("test", r6("auc").alias("auc"), r6("lo").alias("lo"), r6("hi").alias("hi"), r6("p").alias("p"), r6("q").alias("q"))


@query("""with i as (select source in ('src0', 'src1', 'src2') or doc_id % 10 = 0 as g, unnest([{'item': 'quality', 'v': quality = 1}, {'item': 'toxic', 'v': toxic = 1}, {'item': 'english', 'v': lang = 'en'}], recursive := true) from labels join documents using (doc_id)),
s as (select item, count(*) filter (g and v) as a, count(*) filter (g and not v) as b, count(*) filter (not g and v) as c, count(*) filter (not g and not v) as d from i where v is not null group by item),
x as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from s),
p as (select item, a, k, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) as l from x),
o as (select item, l as seen from p where k = a), f as (select p.item, least(1.0, sum(exp(l)) filter (l <= seen + 1e-7)) as p from p join o on p.item = o.item group by p.item)
select s.item, a as k1, a + b as n1, c as k0, c + d as n0, round(p, 6) as p from s join f using (item)""")
def st_selection_table(t):
    d = t("labels").join(t("documents").select("doc_id", "source", "lang"), "doc_id").withColumn("g", F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False)) | (F.col("doc_id") % 10 == 0))
    items = {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "english": F.col("lang") == "en"}
    return S.selection(d, items, "g").withColumn("p", r6("p"))


@query(None)
def st_auc_boot(t):
    c = t("supplier").select(F.col("s_acctbal").alias("v"), (F.col("s_nationkey") < 12).alias("pos"))
    return S.auc_boot(c, "v", "pos", replicates=2000).select(r6("lo").alias("lo"), r6("hi").alias("hi"), "replicates")


@query("""with r as (select (s_acctbal + 1100) / 5500 as ratio from supplier), i as (select ln(ratio) as v, row_number() over (order by ln(ratio)) - 1 as i, count(*) over () as n from r),
d as (select b, ('0x' || left(md5('r:' || b || ':' || i), 12))::bigint % n as j from i, range(0, 2000) x(b)), g as (select b, exp(avg(v)) as g from d join i on i.i = d.j group by b)
select round(quantile_cont(g, 0.025), 6) as lo, round(quantile_cont(g, 0.975), 6) as hi, count(g) as replicates from g""")
def st_ratio_boot(t):
    r = t("supplier").select(((F.col("s_acctbal") + 1100) / 5500).alias("ratio"))
    return S.ratio_boot(r, "ratio", replicates=2000).select(r6("lo").alias("lo"), r6("hi").alias("hi"), "replicates")
