"""Registered queries on accounts, posts and orders: rules, joins, aggregates, windows, text, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import event_windows as ew
from ..operators import rules as R
from ..operators import statistics as S
from . import windows as W
from .registry import registrar

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

r6 = lambda c: F.round(c, 6)

# filters, cascades, funnels


@query("select case when o_orderpriority like '1%' then 'urgent' when o_totalprice > 200000 then 'large' when o_orderstatus = 'O' then 'open' else 'rest' end as reason, count(*) as n from orders group by 1")
def funnel_reasons(t):
    rule = R.cascade([("urgent", F.col("o_orderpriority").startswith("1")), ("large", F.col("o_totalprice") > 200000), ("open", F.col("o_orderstatus") == "O")], "rest")
    return t("orders").groupBy(rule.alias("reason")).agg(F.count("*").alias("n"))


@query("""with s as (select count(*) as s0, count(*) filter (c_acctbal > 0) as s1, count(*) filter (c_acctbal > 0 and c_mktsegment = 'BUILDING') as s2 from customer)
select * from (select 'all' as stage, 0 as place, s0 as n, null::double as of_previous, 100.0::double as of_total from s union all
select 'solvent', 1, s1, round(100 * s1 / s0::double, 6), round(100 * s1 / s0::double, 6) from s union all
select 'building', 2, s2, round(100 * s2 / s1::double, 6), round(100 * s2 / s0::double, 6) from s)""")
def funnel_rates(t):
    return R.funnel(t("customer"), [("all", F.lit(True)), ("solvent", F.col("c_acctbal") > 0), ("building", F.col("c_mktsegment") == "BUILDING")])


@query("select o_orderkey from orders where coalesce(o_orderdate::date between date '1996-01-01' and date '1996-12-31', false)")
def flt_date_range(t):
    return t("orders").where(F.to_date("o_orderdate").between("1996-01-01", "1996-12-31")).select("o_orderkey")


@query("select c_custkey, c_acctbal, case when c_acctbal < lo then 'below' when c_acctbal > hi then 'above' else 'inside' end as gate from customer, (select quantile_cont(c_acctbal, 0.25) as lo, quantile_cont(c_acctbal, 0.75) as hi from customer)")
def range_gate(t):
    c = t("customer")
    limits = c.agg(F.percentile("c_acctbal", F.lit(0.25)).alias("lo"), F.percentile("c_acctbal", F.lit(0.75)).alias("hi"))
    gate = R.cascade([("below", F.col("c_acctbal") < F.col("lo")), ("above", F.col("c_acctbal") > F.col("hi"))], "inside")
    return c.crossJoin(F.broadcast(limits)).select("c_custkey", "c_acctbal", gate.alias("gate"))


# joins


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def jn_inner_pk(t):
    return t("orders").join(t("customer").where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def jn_left_default(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def jn_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def jn_anti(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select doc_id from documents intersect select doc_id from labels")
def jn_key_intersection(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@query("select d.doc_id, coalesce(l.quality, case when n_chars > 500 then 1 else 0 end)::bigint as label from documents d left join labels l using (doc_id)")
def jn_override(t):
    return t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 500, 1).otherwise(0)).cast("long").alias("label"))


@query("select s_suppkey, s_nationkey, count(*) as n from supplier join customer on c_nationkey = s_nationkey and c_acctbal between s_acctbal - 100 and s_acctbal + 100 group by all")
def jn_interval_age(t):
    # the range is binned, so the join is on equal bins and the range is checked on what meets
    s = t("supplier").withColumn("bin", F.explode(F.sequence(F.floor((F.col("s_acctbal") - 100) / 100), F.floor((F.col("s_acctbal") + 100) / 100))))
    c = t("customer").withColumn("bin", F.floor(F.col("c_acctbal") / 100))
    j = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (s["bin"] == c["bin"])).where("c_acctbal between s_acctbal - 100 and s_acctbal + 100")
    return j.groupBy("s_suppkey", "s_nationkey").agg(F.count("*").alias("n"))


@query("select c.conv_id, c.turn, max(p.turn) as parent_turn from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn < c.turn and p.role <> c.role group by all")
def thread_link(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    # the last turn of each role so far; the latest of another role is the parent
    names = ["user", "assistant", "system"]
    other = [F.when(F.col("role") != n, F.max(F.when(F.col("role") == n, F.col("turn"))).over(w)) for n in names]
    return t("conversations").select("conv_id", "turn", F.greatest(*other).alias("parent_turn"))


# aggregations


@query("select source, count(*) as n from documents group by source order by n desc, source limit 8")
def agg_group_count(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)


@query("select count(*) as rows_n, count(distinct user_id) as users_n from events")
def agg_count_distinct(t):
    return t("events").agg(F.count("*").alias("rows_n"), F.countDistinct("user_id").alias("users_n"))


@query("""select q.c_mktsegment as segment, median(c_acctbal) as median, round(avg(c_acctbal), 6) as mean, round(stddev_pop(c_acctbal), 6) as pstdev, quantile_cont(c_acctbal, 0.25) as p25,
  (list_sort(list(c_acctbal)))[count(*) // 4 + 1] as floor_p25, (list_sort(list(c_acctbal)))[count(*) // 2 + 1] as upper_median, (list_sort(list(c_acctbal)))[(0.75 * (count(*) - 1))::double::int64 + case when (0.75 * (count(*) - 1))::double::int64 > 0.75 * (count(*) - 1) then 0 else 1 end] as idx_p75 from customer q group by 1""")
def agg_quantile_family(t):
    n, x, c = F.col("n"), "c_acctbal", t("customer").withColumnRenamed("c_mktsegment", "segment")
    plain = c.groupBy("segment").agg(F.median(x).alias("median"), r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("pstdev"), F.percentile(x, F.lit(0.25)).alias("p25"))
    picked = S.order_statistics(c, ["segment"], x, {"floor_p25": F.floor(n / 4), "upper_median": F.floor(n / 2), "idx_p75": F.floor(0.75 * (n - 1))})
    return plain.join(picked, "segment", "left")


@query("select user_id, round((atan2(sum(sin(2 * pi() * h / 24)), sum(cos(2 * pi() * h / 24))) * 24 / (2 * pi()) + 24) % 24, 6) as hour from (select user_id, hour(ts) + minute(ts) / 60.0::double as h from events) group by user_id")
def agg_circular_mean(t):
    a = 2 * F.pi() * (F.hour("ts") + F.minute("ts") / 60) / 24
    return t("events").groupBy("user_id").agg(r6((F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a))) * 24 / (2 * F.pi()) + 24) % 24).alias("hour"))


@query("select sum(n) filter (k <= 4)::bigint as top_n, sum(n)::bigint as all_n, round(sum(n) filter (k <= 4) / sum(n)::double, 6) as share from (select count(*) as n, row_number() over (order by count(*) desc, user_id) as k from events group by user_id)")
def agg_topk_share(t):
    return R.top_share(t("events"), "user_id").select(F.col("top_n"), "all_n", "share")


@query("select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as k from customer) where k = 1")
def agg_dedup_best(t):
    return R.best_row(t("customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("select l_returnflag, round(100 * sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) as rate from lineitem group by 1")
def agg_ratio_of_sums(t):
    return t("lineitem").groupBy("l_returnflag").agg(r6(100 * F.sum(F.col("l_discount") * F.col("l_quantity")) / F.nullif(F.sum("l_quantity"), F.lit(0))).alias("rate"))


@query("select source, count(*) filter (quality = 1 and toxic = 1) as both_n, count(*) filter (quality = 1 and toxic = 0) as only_a, count(*) filter (quality = 0 and toxic = 1) as only_b, count(*) filter (quality = 0 and toxic = 0) as neither from labels join documents using (doc_id) group by 1")
def agg_contingency(t):
    n = lambda a, b: F.count_if((F.col("quality") == a) & (F.col("toxic") == b))
    return t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(n(1, 1).alias("both_n"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))


# windows and order


@query("select event_id, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 86400000000.0::double, 6) as gap_days from events")
def win_gap(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    return t("events").select("event_id", r6((F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 86400e6).alias("gap_days"))


@query("select c_custkey, rank() over (partition by c_mktsegment order by c_nationkey) + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2.0::double as midrank from customer")
def win_midrank(t):
    r = S.midranks(t("customer"), "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", "midrank")
    return t("customer").join(r, ["c_mktsegment", "c_nationkey"]).select("c_custkey", "midrank")


@query("select doc_id, source, k from (select doc_id, source, row_number() over (partition by source order by md5('7:' || doc_id::varchar), doc_id) as k from documents) where k <= 20")
def win_cap_per_group(t):
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return t("documents").select("doc_id", "source", F.row_number().over(w).alias("k")).where("k <= 20")


@query("select c_custkey, (row_number() over (partition by c_mktsegment order by md5(c_custkey::varchar)) - 1) % 5 as fold from customer")
def win_stratified_folds(t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.md5(F.col("c_custkey").cast("string")))
    return t("customer").select("c_custkey", ((F.row_number().over(w) - 1) % 5).alias("fold"))


@query("select p_partkey, p_retailprice from part order by abs(p_retailprice - 1000) desc, p_partkey limit 10")
def srt_abs_dev(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.abs(F.col("p_retailprice") - 1000).desc(), "p_partkey").limit(10)


@query("select p_partkey, p_retailprice, row_number() over (order by abs(p_retailprice - 1000) desc nulls last, p_partkey) as place from part")
def srt_abs_dev_all(t):
    return S.placed(t("part").select("p_partkey", "p_retailprice"), F.abs(F.col("p_retailprice") - 1000), "p_partkey")


@query("select name, min(k) as origin from (select lower(n_name) as name, 1 as k from nation union all select lower(r_name), 2 from region) group by name")
def set_union_dedup(t):
    u = t("nation").select(F.lower("n_name").alias("name"), F.lit(1).alias("k")).unionByName(t("region").select(F.lower("r_name").alias("name"), F.lit(2).alias("k")))
    return u.groupBy("name").agg(F.min("k").alias("origin"))


@query("select count(*) as n from (select c_custkey from customer except select o_custkey from orders)")
def set_diff_count(t):
    return t("customer").select("c_custkey").subtract(t("orders").select("o_custkey")).agg(F.count("*").alias("n"))


# text


@query(r"select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) as n from documents")
def txt_word_count_ws(t):
    return t("documents").select("doc_id", X.word_count("text").alias("n"))


@query(r"select doc_id, len(regexp_extract_all(text, '[!¡]')) as bangs, len(regexp_extract_all(text, '\.\.\.+|…')) as dots, len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')) as tags, len(regexp_extract_all(text, '@[\p{L}\p{N}_.]+')) as at from documents")
def txt_punct(t):
    return t("documents").select("doc_id", X.found("text", "[!¡]").alias("bangs"), X.found("text", r"\.\.\.+|…").alias("dots"), F.size(X.hashtags("text")).alias("tags"), F.size(X.mentions("text")).alias("at"))


@query(r"""with k as (select doc_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '#[\p{L}\p{N}_]+', ' ', 'g'), '@[\p{L}\p{N}_.]+', ' ', 'g'), '\p{L}+(?:''\p{L}+)?'), lambda x: lower(x)) as w from documents)
select doc_id, len(w) as tokens, len(list_filter(w, lambda x: x in ('the', 'and', 'of') or x like 'tion%')) as hits, len(list_distinct(w)) as types from k""")
def txt_tokens(t):
    w = F.col("w")
    return t("documents").select("doc_id", X.tokens("text").alias("w")).select("doc_id", F.size(w).alias("tokens"), X.lexicon_hits(w, ["the", "and", "of"], ["tion"]).alias("hits"), F.size(F.array_distinct(w)).alias("types"))


@query("select page_id, regexp_replace(url, '[?#].*$', '') as bare, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages")
def url_normalise(t):
    return t("pages").select("page_id", X.url_bare("url").alias("bare"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("select c_custkey, 'C' || upper(left(sha1(lower(trim(c_name))), 6)) as pid from customer")
def txt_stable_id(t):
    return t("customer").select("c_custkey", X.stable_id("c_name", "C").alias("pid"))


@query("select event_id, hour(ts) + minute(ts) / 60.0::double as hour_frac, hour(ts) < 6 as night, isodow(ts) >= 6 as weekend from events")
def dt_hour_frac(t):
    return t("events").select("event_id", (F.hour("ts") + F.minute("ts") / 60).alias("hour_frac"), (F.hour("ts") < 6).alias("night"), (F.weekday("ts") >= 5).alias("weekend"))


@query("select c_custkey, round(ln(1 + greatest(0.0, c_acctbal)), 6) as logged, case when c_acctbal <= 0 then 0 when c_acctbal <= 5000 then 1 else 2 end as bin, round(1 / (1 + exp(-greatest(least(c_acctbal / 100, 35), -35))), 6) as sig from customer")
def mth_scalars(t):
    return t("customer").select("c_custkey", r6(N.log1p_clamped("c_acctbal")).alias("logged"), N.cut_bin("c_acctbal", [0, 5000]).alias("bin"), r6(N.sigmoid(F.col("c_acctbal") / 100)).alias("sig"))


# statistics


@query("""with b as (select c_mktsegment as test, c_acctbal as v, c_nationkey % 2 = 0 as pos from customer),
r as (select test, pos, rank() over (partition by test order by v) + (count(*) over (partition by test, v) - 1) / 2.0::double as k from b)
select test, count(*) filter (pos) as n1, count(*) filter (not pos) as n0, round((sum(k) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0::double) / (count(*) filter (pos) * count(*) filter (not pos)), 6) as auc from r group by test""")
def st_auc(t):
    b = t("customer").select(F.col("c_mktsegment").alias("test"), F.col("c_acctbal").alias("v"), (F.col("c_nationkey") % 2 == 0).alias("pos"))
    return S.auc_mann_whitney(b, "test", "v", "pos").select("test", "n1", "n0", r6("auc").alias("auc"))


@query("""with s as (select count(*) as n, sum(quality)::bigint as prev_a, sum(toxic)::bigint as prev_b, sum(quality * toxic)::bigint as both_n, avg((quality = toxic)::int) as po from labels),
e as (select *, prev_a / n::double * prev_b / n::double + (1 - prev_a / n::double) * (1 - prev_b / n::double) as pe from s)
select n, prev_a, prev_b, both_n, round(po, 6) as po, round((po - pe) / nullif(1 - pe, 0), 6) as kappa, round(2 * po - 1, 6) as pabak from e""")
def st_kappa(t):
    return S.kappa(t("labels"), "quality", "toxic").select("n", "prev_a", "prev_b", F.col("both").alias("both_n"), r6("po").alias("po"), r6("kappa").alias("kappa"), r6("pabak").alias("pabak"))


@query("""with p as (select p_partkey, (p_partkey * 7919 % 1000 + 1) / 1001.0::double as p from part),
r as (select *, row_number() over (order by p, p_partkey) as k, count(*) over () as m from p)
select p_partkey, round(least(1.0, min(p * m / k) over (order by k rows between current row and unbounded following)), 6) as q from r""")
def st_bh_fdr(t):
    p = t("part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1000 + 1) / F.lit(1001.0)).alias("p"))
    return S.bh_fdr(p, "p").select("p_partkey", r6("q").alias("q"))


@query("""with s as (select c_mktsegment as test, avg(c_acctbal) filter (c_nationkey < 10) as m1, avg(c_acctbal) filter (c_nationkey >= 10) as m0, var_pop(c_acctbal) filter (c_nationkey < 10) as v1, var_pop(c_acctbal) filter (c_nationkey >= 10) as v0 from customer group by 1)
select test, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) as smd from s""")
def st_smd(t):
    c = t("customer").select(F.col("c_mktsegment").alias("test"), "c_acctbal", (F.col("c_nationkey") < 10).alias("is_case"))
    return S.smd(c, "test", "c_acctbal", "is_case").select("test", r6("smd").alias("smd"))


@query(f"""with d as (select l_returnflag as test, l_quantity - 25 as diff from lineitem where l_quantity <> 25), c as (select test, abs(diff) as a, count(*) as k, count(*) filter (diff > 0) as pos from d group by all),
r as (select *, coalesce(sum(k) over (partition by test order by a rows between unbounded preceding and 1 preceding), 0) + (k + 1) / 2.0::double as mid from c),
s as (select test, sum(k)::bigint as n, sum(pos * mid) as w, sum(k::double * k * k - k) as ties from r group by test),
z as (select *, n * (n + 1) / 4.0::double as mean, n::double * (n + 1) * (2 * n + 1) / 24.0::double - ties / 48.0::double as var from s)
select test, n, w, round(case when n >= 5 then case when var <= 0 then 1.0 else least(1.0, 2 * {N.normal_tail_sql('((w - mean - case when w > mean then 0.5 else -0.5 end) / sqrt(var))')}) end end, 9) as p from z""")
def st_wilcoxon(t):
    d = t("lineitem").select(F.col("l_returnflag").alias("test"), (F.col("l_quantity") - 25).alias("diff"))
    return S.wilcoxon(d, "test", "diff").withColumn("p", F.round("p", 9))


_MW = """b as (select c_nationkey as test, c_acctbal as v, c_mktsegment in ('BUILDING', 'MACHINERY') as pos from customer),
r as (select test, pos, rank() over (partition by test order by v) + (count(*) over (partition by test, v) - 1) / 2.0::double as k, count(*) over (partition by test, v) as t from b),
s as (select test, count(*) filter (pos) as n1, count(*) filter (not pos) as n0, sum(k) filter (pos) as r1, sum(t * t - 1.0::double) as ties from r group by test),
u as (select *, r1 - n1 * (n1 + 1) / 2.0::double as u, n1 * n0 / 12.0::double * ((n1 + n0 + 1) - ties / nullif((n1 + n0) * (n1 + n0 - 1), 0)) as var from s)"""


def _mw(t):
    return t("customer").select(F.col("c_nationkey").alias("test"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("pos"))


@query(f"with {_MW} select test, n1, n0, round(case when n1 < 2 or n0 < 2 then null when var <= 0 then 1.0 else least(1.0, 2 * {N.normal_tail_sql('((u - n1 * n0 / 2.0::double) / sqrt(nullif(var, 0)))')}) end, 9) as p from u")
def st_mann_whitney(t):
    return S.auc_mann_whitney(_mw(t), "test", "v", "pos").select("test", "n1", "n0", F.round("p", 9).alias("p"))


@query(f"""with {_MW.replace("c_nationkey as test", "c_nationkey % 2 as test")}, z as (select *, (abs(u - n1 * n0 / 2.0::double) - 0.5) / sqrt(nullif(var, 0)) as z from u), q as (select *, {N.normal_tail_sql('z')} as tail from z)
select test, n1, n0, u, round(least(1.0, 2 * case when z < 0 then 1 - tail else tail end), 9) as p from q""")
def st_mann_whitney_scipy(t):
    return S.mann_whitney_auto(_mw(t).withColumn("test", F.col("test") % 2), "test", "v", "pos").withColumn("p", F.round("p", 9))


# several anchor windows in one pass

QUERIES["ew_counts"] = lambda spark, sf: W.counted(spark, sf, [90]).select("entity", "near", "near_pre", "near_post", "base", "near_days", "base_days")
ORACLES["ew_counts"] = W._sql([90], "select entity, near, near_pre, near_post, base, near_days, base_days from c")
QUERIES["ew_sensitivity"] = lambda spark, sf: W._tested(ew.rate_test(W.rated(spark, sf, W.WIDTHS), ["width"]), "width")
ORACLES["ew_sensitivity"] = W._sql(W.WIDTHS, f"select width, {W.TEST} from p")
