"""Registered queries of a study: account features, windows, small-sample statistics, matching, modelling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import features as E
from ..operators import matching as M
from ..operators import modelling as L
from ..operators import rules as R
from ..operators import statistics as S
from . import windows as W
from .registry import registrar

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
r6 = lambda c: F.round(c, 6)

# features

_META = """m as (select user_id, count(*) as n, greatest(3.0, date_diff('day', min(ts)::date, max(ts)::date) / 30.44::double) as months,
  avg((hour(ts) < 6)::int) as night, avg((isodow(ts) >= 6)::int) as weekend, count(distinct ts::date) as days, count(distinct event_type) as kinds,
  avg((event_type = 'view')::int) as view_share, avg(value) as mean_value, max(value) as top_value from events group by user_id),
g as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 86400000000.0::double as gap from events),
b as (select user_id, count(gap) as k, median(gap) as gap, case when count(gap) >= 3 then (stddev_pop(gap) - avg(gap)) / nullif(stddev_pop(gap) + avg(gap), 0) end as bursty from g group by user_id),
f as (select m.*, n / months as rate, gap, bursty from m join b using (user_id))"""


@query(f"with {_META} select user_id, n, round(months, 6) as months, round(rate, 6) as rate, round(night, 6) as night, round(weekend, 6) as weekend, days, kinds, round(view_share, 6) as view_share, round(mean_value, 6) as mean_value, top_value, round(gap, 6) as gap, round(bursty, 6) as bursty from f")
def feat_meta(t):
    f = E.account_features(t("events"))
    return f.select("user_id", "n", "days", "kinds", "top_value", *[r6(c).alias(c) for c in ("months", "rate", "night", "weekend", "view_share", "mean_value", "gap", "bursty")])


_TOK = r"""k as (select source, coalesce(text, '') as text, list_transform(regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '#[\p{L}\p{N}_]+', ' ', 'g'), '@[\p{L}\p{N}_.]+', ' ', 'g'), '\p{L}+(?:''\p{L}+)?'), lambda x: lower(x)) as w from documents where source is not null)"""


@query(rf"""with {_TOK}, c as (select source, len(w) as words, list_sum(list_transform(w, lambda x: length(x))) as chars, len(list_filter(w, lambda x: x in ('i', 'me', 'my'))) as self, len(regexp_extract_all(text, '[!¡]')) as bangs, len(regexp_extract_all(text, '@[\p{{L}}\p{{N}}_.]+')) as ats from k),
y as (select source, count(distinct u) as types from (select source, unnest(w) as u from k) group by source)
select source, count(*) as n_posts, sum(words)::bigint as n_words, round(100 * sum(self) / nullif(sum(words), 0)::double, 6) as self_rate, round(sum(chars) / nullif(sum(words), 0)::double, 6) as word_length,
  round(100 * sum(bangs) / (sum(words) + count(*))::double, 6) as bang_rate, round(100 * sum(ats) / (sum(words) + count(*))::double, 6) as mention_rate, round(any_value(types) / nullif(sum(words), 0)::double, 6) as type_ratio from c join y using (source) group by source""")
def feat_style(t):
    f = E.style_features(t("documents").where("source is not null"), "source", "text", {"self": ["i", "me", "my"]})
    return f.select("source", "n_posts", "n_words", *[r6(c).alias(c) for c in ("self_rate", "word_length", "bang_rate", "mention_rate", "type_ratio")])


@query("select o_custkey as account, count(*) as n, min(o_orderdate)::date::varchar as first, max(o_orderdate)::date::varchar as last, round(count(*) / greatest(3.0, date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) / 30.44::double), 6) as rate from orders group by 1")
def feat_account_summary(t):
    d = F.to_date("o_orderdate")
    s = t("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.count("*").alias("n"), F.min(d).alias("first"), F.max(d).alias("last"))
    return s.select("account", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), r6(F.col("n") / N.months("first", "last")).alias("rate"))


@query("""with x as (select c_custkey, case when c_custkey % 5 > 0 then c_acctbal end as v from customer), m as (select coalesce(median(v), 0.0) as med, count(*) - count(v) as missing from x),
y as (select c_custkey, coalesce(v, med) as v, missing from x, m) select c_custkey, round((v - avg(v) over ()) / stddev_pop(v) over (), 6) as z, missing from y""")
def feat_impute_standardise(t):
    x = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("v"))
    full = E.impute_median(x, ["v"])
    return E.standardise(full, ["v"]).select("c_custkey", r6("v").alias("z"), F.col("v_missing").alias("missing"))


# windows

_W = W._sql([90], "")


def _ew_summary(spark, sf):
    c = W.counted(spark, sf, [90])
    n = lambda test: F.count_if(F.expr(test))
    after = F.greatest(F.datediff("near_to", "anchor"), F.lit(0))
    return c.agg(F.count("*").alias("entities"), n("near > 0 and base > 0").alias("both_n"), n("near > 0 and base = 0").alias("only_near"), n("near = 0 and base > 0").alias("only_base"), F.median("near").alias("near_median"), F.sum(F.least("near", F.lit(3))).alias("near_budget"), F.sum(F.least("base", F.lit(3))).alias("base_budget"), F.median(after).alias("exposure"))


QUERIES["ew_summary"] = _ew_summary
ORACLES["ew_summary"] = _W.rstrip() + " select count(*) as entities, count(*) filter (near > 0 and base > 0) as both_n, count(*) filter (near > 0 and base = 0) as only_near, count(*) filter (near = 0 and base > 0) as only_base, median(near) as near_median, sum(least(near, 3))::bigint as near_budget, sum(least(base, 3))::bigint as base_budget, median(greatest(date_diff('day', anchor, near_to), 0)) as exposure from c"


@query("select o_custkey as entity, round(100 * avg((date_diff('day', o_orderdate::date, date '1998-08-02') <= 90)::int), 6) as d90, round(100 * avg((date_diff('day', o_orderdate::date, date '1998-08-02') <= 365)::int), 6) as d365 from orders where o_orderdate::date <= date '1998-08-02' group by 1")
def dt_recency_share(t):
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    within = lambda k: r6(100 * F.avg((age <= k).cast("int")))
    return t("orders").where(age >= 0).groupBy(F.col("o_custkey").alias("entity")).agg(within(90).alias("d90"), within(365).alias("d365"))


# statistics

_CELLS = "c as (select source, count(*) filter (quality = 1 and toxic = 1) as a, count(*) filter (quality = 1 and toxic = 0) as b, count(*) filter (quality = 0 and toxic = 1) as c, count(*) filter (quality = 0 and toxic = 0) as d from labels join documents using (doc_id) group by source)"


def _cells(t):
    n = lambda q, x: F.count_if((F.col("quality") == q) & (F.col("toxic") == x))
    return t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))


@query(f"""with {_CELLS}, x as (select *, unnest(range(greatest(0, a + b - (b + d)), least(a + b, a + c) + 1)) as k from c),
p as (select source, a, k, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(b + d - (a + b - k) + 1) as l from x),
o as (select source, l as seen from p where k = a) select source, round(least(1.0, sum(exp(l)) filter (l <= seen + 1e-7)), 6) as p from p join o on p.source is not distinct from o.source group by p.source""".replace("select source, round(least", "select p.source, round(least"))
def st_fisher_exact(t):
    return _cells(t).select("source", r6(N.fisher_p("a", "b", "c", "d")).alias("p"))


@query("""with n as (select unnest(range(5, 26)) as n), k as (select n, unnest(range(0, n + 1)) as k from n),
p as (select n, k, case when 2 * k >= n then least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from unnest(range(0, n - k + 1)) u(i))) end as p from k)
select n::bigint as n, min(k)::bigint as least from p where p <= 0.05 group by n""")
def st_sign_mde(t):
    n = t("region").limit(1).select(F.explode(F.sequence(F.lit(5).cast("long"), F.lit(25).cast("long"))).alias("n"))
    return n.select("n", N.sign_mde("n").cast("long").alias("least")).where("least is not null")


@query(None)
def st_beta_upper(t):
    return _cells(t).select("source", N.beta_upper(F.col("a"), F.col("a") + F.col("b")).alias("upper"))


@query("""with s as (select c_mktsegment as test, c_nationkey % 2 = 0 as pos, c_acctbal as v from customer), x as (select test, v from s where pos), y as (select test, v from s where not pos),
j as (select x.test, x.v as xv, y.v as yv, case when x.v > y.v then 1.0 when x.v = y.v then 0.5 else 0.0 end::double as w from x join y using (test)),
a as (select test, avg(w) as auc from j group by test), px as (select test, xv, avg(w) as p from j group by all), py as (select test, yv, avg(w) as p from j group by all),
vx as (select test, var_samp(p) / count(*) as v from (select s.test, px.p from s join px on px.test = s.test and px.xv = s.v where pos) group by test),
vy as (select test, var_samp(p) / count(*) as v from (select s.test, py.p from s join py on py.test = s.test and py.yv = s.v where not pos) group by test)
select a.test, round(auc, 6) as auc, round(greatest(0.0, auc - 1.959963984540054 * sqrt(vx.v + vy.v)), 6) as lo, round(least(1.0, auc + 1.959963984540054 * sqrt(vx.v + vy.v)), 6) as hi from a join vx using (test) join vy using (test)""")
def st_delong(t):
    b = t("customer").select(F.col("c_mktsegment").alias("test"), F.col("c_acctbal").alias("v"), (F.col("c_nationkey") % 2 == 0).alias("pos"))
    return S.delong(b, "test", "v", "pos").select("test", r6("auc").alias("auc"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("""with u as (select c_nationkey < 10 as g, unnest([{'test': 'balance', 'v': c_acctbal}, {'test': 'key', 'v': ln(1 + c_custkey)}], recursive := true) from customer),
s as (select test, median(v) filter (g) as case_median, median(v) filter (not g) as control_median, (avg(v) filter (g) - avg(v) filter (not g)) / sqrt((var_pop(v) filter (g) + var_pop(v) filter (not g)) / 2) as smd from u group by test)
select test, round(case_median, 6) as case_median, round(control_median, 6) as control_median, round(smd, 6) as smd, case when abs(smd) < 0.1 then 'balanced' when abs(smd) < 0.25 then 'acceptable' else 'unbalanced' end as verdict from s""")
def st_balance_table(t):
    u = t("customer").select((F.col("c_nationkey") < 10).alias("g"), F.explode(F.array(F.struct(F.lit("balance").alias("test"), F.col("c_acctbal").alias("v")), F.struct(F.lit("key").alias("test"), F.log1p("c_custkey").alias("v")))).alias("x")).select("g", "x.*")
    s = S.smd(u, "test", "v", "g")
    verdict = R.cascade([("balanced", F.abs("smd") < 0.1), ("acceptable", F.abs("smd") < 0.25)], "unbalanced")
    return s.select("test", r6("md1").alias("case_median"), r6("md0").alias("control_median"), r6("smd").alias("smd"), verdict.alias("verdict"))


@query("""with p as (select user_id, event_type as test, avg(value) filter (day(ts) <= 15) as near, avg(value) filter (day(ts) > 15) as base from events group by all),
d as (select test, round(near - base, 9) as d from p where near is not null and base is not null), s as (select test, count(*) as n, count(*) filter (d > 0) as up, count(*) filter (d < 0) as down, count(*) filter (d = 0) as tie, median(d) as diff from d group by test)
select test, n, up, down, tie, round(diff, 6) as diff, round(least(1.0, 2 * (select sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))) from unnest(range(0, least(up, down) + 1)) u(i))), 6) as sign_p from s""")
def st_paired_table(t):
    side = lambda test: F.avg(F.when(test, F.col("value")))
    p = t("events").groupBy("user_id", F.col("event_type").alias("test")).agg(side(F.dayofmonth("ts") <= 15).alias("near"), side(F.dayofmonth("ts") > 15).alias("base"))
    return S.paired(p, "test", "near", "base").select("test", "n", "up", "down", "tie", r6("diff").alias("diff"), r6("sign_p").alias("sign_p"))


@query("""with s as (select source, count(*) as n, avg((quality = toxic)::int) as po, avg(quality) as pa, avg(toxic) as pb from labels join documents using (doc_id) group by source),
k as (select source, n, (po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0) as k, 2 * po - 1 as pabak from s)
select source, n, case when k is null then 'undefined' when round(k, 9) < 0 then 'poor' when k < 0.2 then 'slight' when k < 0.4 then 'fair' when k < 0.6 then 'moderate' when k < 0.8 then 'substantial' else 'almost perfect' end as grade, coalesce(round(k, 9) >= 0.6, false) or round(pabak, 9) >= 0.6 as usable from k""")
def st_kappa_grade(t):
    l = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    k = S.kappa(l, "quality", "toxic", "source")
    return k.select("source", "n", S.kappa_grade("kappa").alias("grade"), (F.coalesce(F.round("kappa", 9) >= 0.6, F.lit(False)) | (F.round("pabak", 9) >= 0.6)).alias("usable"))


@query("""with c as (select quality as q, toxic as x, count(*) as k from labels group by all), h as (select q, x, k, coalesce(sum(k) over (order by q, x rows between unbounded preceding and 1 preceding), 0) as lo, sum(k) over () as n from c),
i as (select unnest(range(0, (select count(*) from labels))) as i), b as (select unnest(range(0, 50)) as b),
d as (select b, ('0x' || left(md5('k:' || b || ':' || i), 12))::bigint % (select count(*) from labels) as spot from b, i),
j as (select b, count(*) as n, sum(q) as pa, sum(x) as pb, avg((q = x)::int) as po from d join h on spot >= lo and spot < lo + k group by b),
k as (select b, (po - (pa / n * pb / n + (1 - pa / n) * (1 - pb / n))) / nullif(1 - (pa / n * pb / n + (1 - pa / n) * (1 - pb / n)), 0) as k from j)
select round(quantile_cont(k, 0.025), 6) as lo, round(quantile_cont(k, 0.975), 6) as hi, count(k) as replicates from k""")
def st_kappa_boot(t):
    return S.kappa_boot(t("labels"), "quality", "toxic", replicates=50, seed="k").select(r6("lo").alias("lo"), r6("hi").alias("hi"), "replicates")


@query(ORACLES["st_kappa_boot"].replace("range(0, 50)", "range(0, 2000)"))
def st_kappa_boot_2000(t):
    return S.kappa_boot(t("labels"), "quality", "toxic", replicates=2000, seed="k").select(r6("lo").alias("lo"), r6("hi").alias("hi"), "replicates")


# matching and modelling


@query("""with q as (select quantile_disc(v, 0.33) as a, quantile_disc(v, 0.67) as b from (select c_acctbal as v from customer where c_mktsegment = 'BUILDING'))
select case when c_acctbal <= a then 0 when c_acctbal <= b then 1 else 2 end as stratum, c_mktsegment = 'BUILDING' as is_case, count(*) as n from customer, q group by all""")
def mt_strata(t):
    c = t("customer").withColumn("is_case", F.col("c_mktsegment") == "BUILDING")
    return M.strata(c, "c_acctbal", "is_case", [0.33, 0.67]).groupBy("stratum", "is_case").agg(F.count("*").alias("n"))


@query(None)
def mt_greedy(t):
    c = t("customer").withColumn("is_case", F.col("c_mktsegment") == "BUILDING")
    return M.matched(M.strata(c, "c_acctbal", "is_case", [0.33, 0.67]), ["stratum", "c_nationkey"], "c_custkey", "is_case", "c_acctbal", ratio=2)


@query(None)
def ml_cv_auc(t):
    f = E.account_features(t("events")).select("user_id", "rate", "night", "weekend", "view_share", "mean_value", (F.col("user_id") % 2).alias("y"))
    return L.cv_auc(f, "user_id", "y", ["rate", "night", "weekend", "view_share", "mean_value"], folds=5, repeats=20)


@query("select auc, case when auc <= 0.6 then 'same' when auc <= 0.7 then 'weak' else 'different' end as verdict from (select round(k / 10.0::double, 6) as auc from (select unnest(range(5, 10)) as k))")
def ml_verdict(t):
    a = t("region").limit(1).select(F.explode(F.sequence(F.lit(5), F.lit(9))).alias("k")).select((F.col("k") / 10).alias("auc"))
    return a.select("auc", L.verdict("auc").alias("verdict"))


@query("select c_mktsegment, c_nationkey, c_custkey, sum(1) over (partition by c_mktsegment order by c_nationkey, c_custkey rows unbounded preceding)::bigint as running from customer")
def win_running(t):
    w = Window.partitionBy("c_mktsegment").orderBy("c_nationkey", "c_custkey").rowsBetween(Window.unboundedPreceding, 0)
    return t("customer").select("c_mktsegment", "c_nationkey", "c_custkey", F.count("*").over(w).alias("running"))


@query(r"""with d as (select doc_id, 'I turned ' || (15 + doc_id % 20) || ' years, class of ' || (2010 + doc_id % 9) as s from documents) select doc_id, 15 + doc_id % 20 as value, case when abs((15 + doc_id % 20) - (18 + 2024 - (2010 + doc_id % 9))) <= 2 then 'high+' else 'high' end as confidence from d""")
def age_combine(t):
    d = t("documents").select("doc_id", F.format_string("I turned %d years, class of %d", 15 + F.col("doc_id") % 20, 2010 + F.col("doc_id") % 9).alias("s"))
    got = X.evidence("s", [("high", r"(\d{1,2}) years", lambda v: v), ("low", r"class of (\d{4})", lambda v: 18 + 2024 - v)], agree=2)
    return d.select("doc_id", got.alias("e")).select("doc_id", "e.value", "e.confidence")
