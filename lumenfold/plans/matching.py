"""Registered queries on matching and models: strata of cases, pairs, metadata features, permutations, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import modelling as L
from ..operators import pairs as M
from ..operators import statistics as S
from .registry import registrar

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
r6 = lambda c: F.round(c, 6)

# customers of one segment are cases; the "age" of a customer is a hash of its key within 15 to 29


def _people(t):
    c = t("customer").join(t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 5).alias("block"), (F.col("c_mktsegment") == "BUILDING").alias("is_case"), (15 + F.col("c_custkey") * 7 % 15).cast("int").alias("value"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("c_acctbal").alias("balance"))


_PEOPLE = """o as (select o_custkey, count(*) as n from orders group by 1),
p as (select c_custkey as key, c_nationkey % 5 as block, c_mktsegment = 'BUILDING' as is_case, (15 + c_custkey * 7 % 15)::int as value, coalesce(n, 0) as n, c_acctbal as balance from customer left join o on o_custkey = c_custkey),
k as (select (list_sort(list(n)))[count(*) // 3 + 1] as n1, (list_sort(list(n)))[2 * count(*) // 3 + 1] as n2, (list_sort(list(balance)))[count(*) // 3 + 1] as b1, (list_sort(list(balance)))[2 * count(*) // 3 + 1] as b2 from p where is_case),
s as (select p.*, case when n <= n1 then 0 when n <= n2 then 1 else 2 end as i, case when balance <= b1 then 0 when balance <= b2 then 1 else 2 end as j,
  case when key % 3 = 0 then (['15-18', '18-24', 'x'])[key % 2 + 1] else '' end as band, case when key % 3 = 0 then 'institution' else 'bio' end as kind from p, k),
v as (select *, case when kind = 'institution' and regexp_matches(band, '^\\d{2}-\\d{2}$') then left(band, 2)::int else value - 2 end as lo, case when kind = 'institution' and regexp_matches(band, '^\\d{2}-\\d{2}$') then right(band, 2)::int else value + 2 end as hi from s)"""


def _strata(t):
    p, n = _people(t), F.col("n")
    cases, thirds = p.where("is_case"), lambda x: {f"{x[0]}1": F.floor(F.col("n") / 3), f"{x[0]}2": F.floor(2 * F.col("n") / 3)}
    cuts = S.order_statistics(cases.withColumnRenamed("n", "posts"), [], "posts", thirds("n")).crossJoin(S.order_statistics(cases, [], "balance", thirds("b")))  # one row each
    bin_ = lambda x, a, b: F.when(F.col(x) <= F.col(a), 0).when(F.col(x) <= F.col(b), 1).otherwise(2)
    s = p.crossJoin(F.broadcast(cuts)).withColumn("i", bin_("n", "n1", "n2")).withColumn("j", bin_("balance", "b1", "b2"))
    third = F.col("key") % 3 == 0
    band = F.when(third, F.when(F.col("key") % 2 == 0, "15-18").otherwise("18-24")).otherwise("")
    e = M.interval(F.col("value"), band, F.when(third, "institution").otherwise("bio"), 2)
    return s.withColumn("e", e).select("key", "block", "is_case", "value", "i", "j", n, "balance", "e.lo", "e.hi")


@query(f"with {_PEOPLE} select i, j, is_case, count(*) as n from v group by all")
def mt_cutpoints(t):
    return _strata(t).groupBy("i", "j", "is_case").agg(F.count("*").alias("n"))


@query(f"with {_PEOPLE} select key, lo, hi from v")
def mt_age_interval(t):
    return _strata(t).select("key", "lo", "hi")


def _sides(t):
    s = _strata(t).withColumn("score", F.col("balance"))
    cases = s.where("is_case").select("block", F.col("key").alias("case_key"), "value", "i", "j", "score")
    return cases, s.where("not is_case").select("block", F.col("key").alias("control_key"), "lo", "hi", "i", "j", "score")


def _pairs(t):
    cases, controls = _sides(t)
    return cases, M.eligible(cases, controls, ["block"])


_PAIRS = f"""{_PEOPLE}, e as (select a.block, a.key as case_key, b.key as control_key, abs(a.i - b.i) + abs(a.j - b.j) as strata_apart, abs(a.balance - b.balance) as apart
  from v a join v b on a.block = b.block and a.is_case and not b.is_case and a.value between b.lo and b.hi and abs(a.i - b.i) + abs(a.j - b.j) <= 2)"""


@query(f"with {_PAIRS} select block, case_key, control_key, strata_apart, round(apart, 6) as apart from e")
def mt_eligible_pairs(t):
    x = F.col("apart")  # below 2^31 by whole millionths, as its SQL rounds; round() goes by decimal text, slow for so many rows
    return _pairs(t)[1].withColumn("apart", F.when(x < 2**31, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(r6(x)))


@query(f"with {_PAIRS}, x as (select case_key, count(*) as n from e group by 1) select count(*) as cases, sum(least(coalesce(x.n, 0), 1))::bigint as with_any from v left join x on case_key = key where is_case")
def mt_scarcity(t):
    cases, pairs = _pairs(t)
    n = pairs.groupBy("case_key").agg(F.count("*").alias("n"))
    return cases.join(n, "case_key", "left").agg(F.count("*").alias("cases"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.lit(1))).cast("long").alias("with_any"))


@query(None)
def mt_greedy_scarce(t):
    return M.scarce(*_sides(t), ["block"], ratio=2)


@query("select 0::bigint as reused, 0::bigint as over_ratio, 0::bigint as not_eligible, 0::bigint as wrong_relaxed")
def mt_invariants(t):
    # what no matching may break: a control twice, a case with too many, a pair that is not eligible, a wrong mark
    cases, controls = _sides(t)
    m = M.scarce(cases, controls, ["block"], ratio=2)
    j = M.strata_apart(m, cases, controls, ["block"])
    twice = m.groupBy("control_key").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("reused"))
    many = m.groupBy("case_key").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 2).alias("over_ratio"))
    rest = j.agg(F.count_if(F.col("strata_apart").isNull()).alias("not_eligible"), F.count_if(F.col("relaxed") != (F.col("strata_apart") > 0)).alias("wrong_relaxed"))
    return twice.crossJoin(many).crossJoin(rest)  # one row each


@query(None)
def mt_unmatched(t):
    cases, controls = _sides(t)
    return M.unmatched(cases, M.scarce(cases, controls, ["block"], ratio=4), 4).select("block", "case_key", "n")


# the 14 metadata features of an account, from its profile and its posts

_META14 = """with p as (select o_custkey as k, o_orderdate::date as d, hour(o_orderdate) as h, o_orderstatus as s, o_orderpriority as q from orders),
a as (select k, count(*) as n, min(d) as first, max(d) as last, avg(h) as hour_mean, case when count(*) > 1 then stddev_pop(h) else 0 end as hour_sd, 100 * avg((s = 'F')::int) as video, 100 * avg((s = 'P')::int) as carousel, 100 * avg((q like '1%')::int) as tagged, 100 * avg((q like '2%')::int) as placed, avg(length(q)) as length from p group by k)
select c_custkey as account, round(ln(1 + greatest(0.0, c_acctbal)), 6) as log_followers, round(ln(1 + c_nationkey), 6) as log_following, round(case when c_nationkey = 0 then 0 else c_acctbal / c_nationkey end, 6) as ratio, round(ln(1 + coalesce(n, 0)), 6) as log_posts,
  round(ln(1 + coalesce(n, 0) / coalesce(greatest(3.0, date_diff('day', first, last) / 30.44::double), 3.0)), 6) as log_rate, round(coalesce(date_diff('day', first, date '2002-01-01') / 365.25::double, 0), 6) as years, round(coalesce(video, 0), 6) as video_pct, round(coalesce(carousel, 0), 6) as carousel_pct,
  round(coalesce(hour_mean, 0), 6) as hour_mean, round(coalesce(hour_sd, 0), 6) as hour_sd, round(coalesce(tagged, 0), 6) as hashtag_pct, round(coalesce(placed, 0), 6) as place_pct, round(coalesce(length, 0), 6) as caption_length, (trim(c_mktsegment) <> '')::int::double as has_bio from customer left join a on k = c_custkey"""


def _meta14(t):
    p = t("orders").select(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("q"))
    profiles = t("customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("followers"), F.col("c_nationkey").alias("following"), F.col("c_mktsegment").alias("bio"))
    marks = {"video_pct": F.col("s") == "F", "carousel_pct": F.col("s") == "P", "hashtag_pct": F.col("q").startswith("1"), "place_pct": F.col("q").startswith("2")}
    return E.meta14(profiles, p, "account", "ts", marks, F.length("q"), "2002-01-01")


@query(_META14)
def feat_meta14(t):
    return _meta14(t).select("account", *[r6(c).alias(c) for c in E.META14])


@query(f"with f as ({_META14}), s as (select o_custkey as account, sum(o_totalprice) as spent from orders group by 1) select f.account, log_posts, has_bio, round(spent, 2) as spent from f left join s using (account)")
def ml_feature_concat(t):
    s = t("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return _meta14(t).join(s, "account", "left").select("account", r6("log_posts").alias("log_posts"), "has_bio", "spent")


_IMPORTANCE = """u as (select c_mktsegment = 'BUILDING' as pos, unnest([{'f': 'balance', 'v': c_acctbal}, {'f': 'key', 'v': c_custkey::double}, {'f': 'nation', 'v': c_nationkey::double}], recursive := true) from customer),
r as (select f, pos, rank() over (partition by f order by v) + (count(*) over (partition by f, v) - 1) / 2.0::double as k from u),
a as (select f, (sum(k) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0::double) / (count(*) filter (pos)::double * count(*) filter (not pos)) as auc from r group by f)"""


def _long(t):
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(c).cast("double").alias("v")) for n, c in (("balance", "c_acctbal"), ("key", "c_custkey"), ("nation", "c_nationkey"))]))
    return t("customer").select((F.col("c_mktsegment") == "BUILDING").alias("pos"), each.alias("x")).select("pos", "x.f", "x.v")


@query(f"with {_IMPORTANCE} select f, round(greatest(auc, 1 - auc), 6) as importance, row_number() over (order by greatest(auc, 1 - auc) desc, f) as place from a")
def ml_univariate_importance(t):
    return L.importance(_long(t), "f", "v", "pos").select("f", r6("importance").alias("importance"), "place")


@query("with x as (select n_nationkey as k, 0.5 + n_nationkey / 100.0::double as style, 0.55::double as meta, n_nationkey % 3 as q, n_nationkey % 4 as nominal from nation) select k, case when style - meta >= 0.15 then 'more than metadata' when style - meta >= 0.07 then 'somewhat more' else 'no more' end as delta, case when q > 0 then 'some after correction' when nominal > 0 then 'nominal only' else 'none' end as tests from x")
def ml_delta_verdict(t):
    x = t("nation").select(F.col("n_nationkey").alias("k"), (0.5 + F.col("n_nationkey") / 100).alias("style"), F.lit(0.55).alias("meta"), (F.col("n_nationkey") % 3).alias("q"), (F.col("n_nationkey") % 4).alias("nominal"))
    return x.select("k", L.delta_verdict("style", "meta").alias("delta"), L.tests_verdict("q", "nominal").alias("tests"))


_FEATURES = ["rate", "night", "weekend", "view_share", "mean_value"]


def _study(t):
    return E.account_features(t("events")).select("user_id", *_FEATURES, (F.col("user_id") % 2).alias("y"))


@query(None)
def ml_cv_bagged(t):
    return L.bagged(_study(t), "user_id", "y", _FEATURES, folds=5, repeats=20).select("user_id", "y", r6("score").alias("score"))


@query(None)
def ml_coefficients(t):
    return L.coefficients(_study(t), "y", _FEATURES).select("feature", r6("weight").alias("weight"), "place")


@query(None)
def mt_propensity(t):
    return L.propensity(_study(t), "user_id", "y", _FEATURES).select("user_id", r6("score").alias("score"))


@query(None)
def ml_frame_audit(t):
    s = _study(t).withColumn("pools", F.array_compact(F.array(F.lit("all"), F.when(F.col("rate") > 0, "eligible"), F.when(F.col("user_id") % 3 > 0, "matched"))))
    return L.by_pool(s.select("*", F.explode("pools").alias("pool")).drop("pools"), "pool", "user_id", "y", _FEATURES, folds=5, repeats=5).select("pool", r6("mean_auc").alias("mean_auc"), "n")


@query(None)
def st_permutation(t):
    return L.permutation(_study(t), "user_id", "y", _FEATURES, permutations=200, rounds=200)
