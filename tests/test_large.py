"""What only shows on larger numbers or tables: exact counts, sums beyond a long, work that grows with pairs."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import draws, numbers, text
from lumenfold.operators import anonymise, cohorts, pairs, statistics
from lumenfold.plans import catalog


def test_counts_with_units_are_exact(spark):
    shown = {"32773.2K": 32773200, "1,180": 1180, "1.0000009M": 1000000, "1.2M": 1200000, "25.2k": 25200, "2.5": 2, "K": None, "x": None, "9223372036854775807": 9223372036854775807, "99999999999999999M": None}
    got = spark.createDataFrame([(s,) for s in shown], "s string").select("s", text.parse_count("s").alias("n")).collect()
    assert {r.s: r.n for r in got} == shown
    wrong = spark.range(27000, 33000).where(text.parse_count(F.format_string("%.1fK", F.col("id") * 1.2)) != F.col("id") * 1200)
    assert wrong.count() == 0


def test_wilcoxon_of_millions_of_rows(spark):
    d = spark.range(4_000_000).select(F.lit("t").alias("t"), F.when(F.col("id") % 2 == 0, F.col("id") % 7 + 1).otherwise(-(F.col("id") % 5) - 1).cast("double").alias("d"))
    r = statistics.wilcoxon(d, "t", "d").first()
    assert r.n == 4_000_000 and 0 <= r.p <= 1


def people(spark, n, seed=7):
    import random

    r = random.Random(seed)
    some = lambda p, x: None if r.random() < p else x
    score = lambda: r.choice([None, float("nan"), *[r.randint(0, 6) * 1.0, round(r.random() * 6, 1)] * 8])
    cases = [(some(0.05, r.randint(0, 1)), r.randint(0, n), some(0.05, r.randint(15, 20)), r.randint(0, 2), r.randint(0, 2), score()) for _ in range(n)]
    controls = [(some(0.05, r.randint(0, 1)), r.randint(0, 4 * n), lo := r.randint(13, 20), lo + r.randint(-1, 4), r.randint(0, 2), some(0.05, r.randint(0, 2)), score()) for _ in range(3 * n)]
    return spark.createDataFrame(cases, "block int, case_key long, value int, i int, j int, score double"), spark.createDataFrame(controls, "block int, control_key long, lo int, hi int, i int, j int, score double")


@pytest.mark.parametrize(("ratio", "relax", "reach"), [(2, True, 2), (4, True, 2), (3, False, 2), (30, True, 1)])
def test_scarce_is_greedy_over_eligible_pairs(spark, ratio, relax, reach):
    # repeated keys, equal and missing scores, rows without block, value or stratum, bounds out of order
    cases, controls = people(spark, 60)
    want = pairs.greedy(pairs.eligible(cases, controls, ["block"], reach), ["block"], ratio, relax).collect()
    got = pairs.scarce(cases, controls, ["block"], ratio, reach, relax)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
    assert pairs.scarce(cases.limit(0), controls, ["block"], ratio).count() == pairs.scarce(cases, controls.limit(0), ["block"], ratio).count() == 0


#: Generate spreads intervals for the join that makes pairs.
def makes_pairs(spark, name):
    return "Generate" in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_greedy_makes_no_pairs(spark):
    assert not makes_pairs(spark, "mt_greedy_scarce")


def test_invariants_look_pairs_up(spark):
    assert not makes_pairs(spark, "mt_invariants")
    cases, controls = people(spark, 20)
    every = cases.select("block", "case_key").distinct().crossJoin(controls.select("control_key").distinct()).dropna()
    held = {(r.block, r.case_key, r.control_key): r.strata_apart for r in pairs.strata_apart(every, cases, controls, ["block"]).collect()}
    want = {}
    for r in pairs.eligible(cases, controls, ["block"]).collect():
        k = (r.block, r.case_key, r.control_key)
        want[k] = min(r.strata_apart, want.get(k, 9))
    assert {k: d for k, d in held.items() if d is not None} == want and len(held) > len(want)


def test_unmatched_makes_no_pairs(spark):
    assert not makes_pairs(spark, "mt_unmatched")


def test_closing_makes_no_pairs(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a pair table")

    monkeypatch.setattr(pairs, "eligible", none)
    assert catalog.QUERIES["mt_pipeline"](spark, "/root/testdata/sf0.001").columns[0] == "cases"


def at_random(text, n):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) % n


def test_draws_are_hashes():
    for prefix, n in (("k:0:", 12), ("k:1999:", 20001), ("x" * 54, 150), ("x" * 70, 30), ("é:", 105), ("", 1), ("", 0)):
        got = [int(x) for at in draws.drawn(prefix, n) for x in at]
        assert got == [at_random(f"{prefix}{i}", n) for i in range(n)]


def joins(df):
    return "Join" in df._jdf.queryExecution().optimizedPlan().toString()


def test_auc_interval_without_joined_draws(spark):
    rows = [(float(i * 37 % 11) + i % 3, i % 3 == 0) for i in range(50)] + [(None, True), (None, False), (float("nan"), True), (1.0, None)]
    df = statistics.auc_boot(spark.createDataFrame(rows, "v double, pos boolean"), "v", "pos", replicates=60)
    assert not joins(df)
    rank = lambda x: (x is None, x != x, x if x == x else 0)
    side = {c: sorted([v for v, p in rows if p is c], key=rank) for c in (True, False)}
    aucs = []
    for b in range(60):
        d = {c: [x for i in range(len(v)) if (x := v[at_random(f"a:{b}:{str(c).lower()}:{i}", len(v))]) is not None] for c, v in side.items()}
        wins = [(rank(x) > rank(y)) + (rank(x) == rank(y)) / 2 for x in d[True] for y in d[False]]
        aucs.append(sum(wins) / len(wins))
    got = df.first()
    assert got.replicates == 60 and np.allclose([got.lo, got.hi], np.percentile(aucs, [2.5, 97.5]))
    assert tuple(statistics.auc_boot(spark.createDataFrame([], "v double, pos boolean"), "v", "pos", 5).first()) == (None, None, 0)


def test_ratio_interval_without_joined_draws(spark):
    rows = [((i * 37 % 23 + 1) / 7,) for i in range(40)] + [(None,)] * 3
    df = statistics.ratio_boot(spark.createDataFrame(rows, "x double"), "x", replicates=60)
    assert not joins(df)
    v = sorted(np.log(x) for x, in rows if x) + [None] * 3
    gs = [np.exp(np.mean([x for i in range(43) if (x := v[at_random(f"r:{b}:{i}", 43)]) is not None])) for b in range(60)]
    got = df.first()
    assert got.replicates == 60 and np.allclose([got.lo, got.hi], np.percentile(gs, [2.5, 97.5]))
    assert tuple(statistics.ratio_boot(spark.createDataFrame([], "x double"), "x", 5).first()) == (None, None, 0)


def test_kappa_replicates_are_spread_and_counted_in_place(spark):
    rows = [(i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1)]
    df = statistics.kappa_boot(spark.createDataFrame(rows, "a int, b int"), "a", "b", replicates=40)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Generate" not in plan
    cells, ks = sorted(r for r in rows if r[0] is not None), []
    for b in range(40):
        d = np.array([cells[at_random(f"k:{b}:{i}", 30)] for i in range(30)])
        pa, pb = d.mean(0)
        pe = pa * pb + (1 - pa) * (1 - pb)
        ks.append(((d[:, 0] == d[:, 1]).mean() - pe) / (1 - pe))
    got = df.first()
    assert got.replicates == 40 and np.allclose([got.lo, got.hi], np.percentile(ks, [2.5, 97.5]))
    assert tuple(statistics.kappa_boot(spark.createDataFrame([], "a int, b int"), "a", "b", 5).first()) == (None, None, 0)


def test_fisher_of_many_tables_takes_one_pass_each(spark):
    rows = [(20_000, 20_000, 20_150, 19_850), (3, 1, 1, 3), (0, 0, 5, 2), (24, 6, 70, 4)]
    began = time.monotonic()
    got = [r.p for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(numbers.fisher_p("a", "b", "c", "d").alias("p")).collect()]
    assert time.monotonic() - began < 30  # 40,000 tables: a pass a table would be 1.6e9 steps
    g = math.lgamma

    def brute(a, b, c, d):
        ls = {x: g(a + b + 1) + g(c + d + 1) + g(a + c + 1) + g(b + d + 1) - g(a + b + c + d + 1) - g(x + 1) - g(a + b - x + 1) - g(a + c - x + 1) - g(d - a + x + 1) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        return min(1.0, sum(math.exp(v) for v in ls.values() if v <= ls[a] + 1e-7))

    assert got == pytest.approx([brute(*r) for r in rows], abs=1e-7)


def test_nearest_candidates_hold_the_first_of_all_pairs(spark, tmp_path):
    import random

    r = random.Random(3)
    some = lambda p, x: None if r.random() < p else x
    balance = lambda: r.choice([None, float("nan"), *[round(r.random() * 3, 2), r.randint(0, 2) * 1.0] * 6])
    s = spark.createDataFrame([(i % 70, some(0.05, r.randint(0, 14)), balance()) for i in range(80)], "s_suppkey long, s_nationkey int, s_acctbal double")
    c = spark.createDataFrame([(i, some(0.05, r.choice([0, 2, 2, 2, 4, 5, 9, 9, 12])), balance()) for i in range(300)], "c_custkey long, c_nationkey int, c_acctbal double")
    s.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    c.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    df = catalog.QUERIES["srt_multi_key"](spark, str(tmp_path))
    assert not joins(df)
    p = s.join(c, F.floor(F.col("s_nationkey") / 5) == F.floor(F.col("c_nationkey") / 5))
    p = p.select("s_suppkey", "c_custkey", F.abs(F.col("s_nationkey") % 5 - F.col("c_nationkey") % 5).alias("far"), F.round(F.abs(F.col("s_acctbal") - F.col("c_acctbal")), 2).alias("apart"))
    want = cohorts.nearest(p, ["s_suppkey"], ["far", F.col("apart").asc_nulls_last(), "c_custkey"], 3).select("s_suppkey", "c_custkey", "place").collect()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want)) and len(want) > 150


def test_anonymous_texts_take_time_by_their_words(spark):
    text = "@ana said w1.x " * 4000
    df = spark.createDataFrame([("P1", 1, "me", text)], "pid string, post long, handle string, said string")
    began = time.monotonic()
    got = anonymise.project_anonymous(df, "pid", ["post"], "post", "handle", "pid", spark.createDataFrame([], "handle string")).first()
    assert time.monotonic() - began < 30  # every word for every word would be 144 million looks
    assert got.said == "@[Anonymous 1] said w1.x " * 4000


def test_bounds_out_of_order_hold_nothing(spark):
    cases = spark.createDataFrame([(0, 1, 19, 0, 0, 1.0)], "block int, case_key long, value int, i int, j int, score double")
    controls = spark.createDataFrame([(0, 5, 24, 18, 0, 0, 1.0), (0, 6, 18, 24, 0, 0, 1.0), (0, 7, None, 24, 0, 0, 1.0)], "block int, control_key long, lo int, hi int, i int, j int, score double")
    assert [r.control_key for r in pairs.eligible(cases, controls, ["block"]).collect()] == [6]
    assert [r.control_key for r in pairs.scarce(cases, controls, ["block"], 2).collect()] == [6]


def test_pairs_of_rows_of_any_size(spark, monkeypatch):
    cases, controls = people(spark, 60)
    held = lambda a, b: None not in (a.block, a.value, a.i, a.j, b.i, b.j) and a.block == b.block and b.lo <= a.value <= b.hi and abs(a.i - b.i) + abs(a.j - b.j) <= 2
    apart = lambda a, b: None if None in (a.score, b.score) else abs(a.score - b.score)
    want = sorted(str((a.block, a.case_key, b.control_key, abs(a.i - b.i) + abs(a.j - b.j), apart(a, b))) for a in cases.collect() for b in controls.collect() if held(a, b))
    for row, parts in ((1024, 16), (3, 2), (1, 1)):
        monkeypatch.setattr(pairs, "ROW", row)
        monkeypatch.setattr(pairs, "PARTS", parts)
        assert sorted(str(tuple(r)) for r in pairs.eligible(cases, controls, ["block"]).collect()) == want and want


def test_pairs_take_little_disk(spark, tmp_path):
    # 1,500,000 pairs of one block and value, their scores repeated; rows as a plain join makes them took 2.13 MB
    score = lambda n: (F.xxhash64(F.col("id") % n) % 500000 / 100).alias("score")
    at = lambda n: [F.lit(0).alias("block"), (F.col("id") * 7919 % n).alias("key"), F.lit(20).alias("value"), (F.col("id") % 2).cast("int").alias("i"), F.lit(0).alias("j")]
    cases = spark.range(500).select(*at(500), score(50)).withColumnRenamed("key", "case_key")
    controls = spark.range(3000).select(*at(3000), score(1000)).withColumnsRenamed({"key": "control_key", "value": "lo"}).withColumn("hi", F.col("lo"))
    pairs.eligible(cases, controls, ["block"]).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 1_500_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1_000_000
