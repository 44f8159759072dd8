"""Statistics, style, matching and readers against known values and hostile rows."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import ages, jsonwalk, numbers, style
from lumenfold.operators import modelling, pairs, statistics
from lumenfold.operators import style as style_ops
from lumenfold.plans.style import BANKS
from lumenfold.sources import files
from lumenfold.streaming import incremental


def test_normal_tail_far_out(spark):
    zs = [0.0, 0.5, 1.96, 4.0, 8.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(numbers.normal_tail("z")).collect()
    for z, r in zip(zs, got, strict=True):
        assert r[0] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=2e-7)


def test_bh_with_missing_p_and_families(spark):
    rows = [("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None), ("a", 0.03), ("b", 1.0), ("c", None)]
    got = statistics.bh_fdr(spark.createDataFrame(rows, "g string, p double"), "p", "g").collect()
    want = {("a", 0.01): 0.04, ("a", 0.03): 0.04, ("a", 0.04): 0.04, ("a", None): None, ("b", 1.0): 1.0, ("c", None): None}
    assert len(got) == len(rows)
    for r in got:
        w = want[(r.g, r.p)]
        assert r.q is None if w is None else r.q == pytest.approx(w)


def test_exact_u_counts_arrangements():
    for n1, n0 in ((1, 1), (2, 3), (4, 3), (5, 5)):
        us = []
        for chosen in itertools.combinations(range(n1 + n0), n1):
            us.append(sum(c - i for i, c in enumerate(chosen)))
        for u in range(n1 * n0 + 1):
            low = min(u, n1 * n0 - u)
            assert statistics._exact_u(n1, n0, u) == pytest.approx(min(1.0, 2 * sum(x <= low for x in us) / len(us)))


def test_wilcoxon_at_its_mean(spark):
    d = spark.createDataFrame([("t", float(x)) for x in (1, -1, 2, -2, 3, -3)], "t string, d double")
    r = statistics.wilcoxon(d, "t", "d").first()
    assert r.n == 6 and r.w == 10.5 and r.p == pytest.approx(math.erfc(0.5 / math.sqrt(22.75 - 18 / 48) / math.sqrt(2)), rel=1e-6)


def test_order_statistics(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 4, 2)] + [("b", 7.0), ("b", None)], "g string, v double")
    n = F.col("n")
    got = {r.g: (r.q, r.m) for r in statistics.order_statistics(d, ["g"], "v", {"q": F.floor(n / 4), "m": F.floor(n / 2)}).collect()}
    assert got == {"a": (1.0, 2.0), "b": (7.0, 7.0)}


def test_counters_of_a_post(spark):
    rows = [(1, "I think MY CAT… is #Great!!! ¡no! @ana.b 😀❤️", "2024-03-02 02:30:00"), (2, "", "2024-03-04 12:00:00"), (3, "☹️ ... ##", "2024-03-04 12:00:00"), (4, None, "2024-03-04 12:00:00"), (5, "the end of the day", "2024-03-04 12:00:00")]
    d = spark.createDataFrame(rows, "doc_id long, caption string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.doc_id: r for r in style_ops.post_counts(d, BANKS).collect()}
    a = got[1]
    assert (a.words, a.hashtags, a.mentions, a.exclaims, a.dots, a.capitals, a.emoji, a.emoji_pos, a.hedge, a.neg, a.night, a.weekend, a.hour) == (6, 1, 1, 5, 1, 1, 2, 2, 1, 1, 1, 1, 2.5)
    assert (got[2].no_caption, got[2].symbols_only, got[3].no_caption, got[3].symbols_only, got[3].emoji_neg, got[4].no_caption) == (1, 0, 0, 1, 1, 1)
    assert got[5].english == 1 and got[1].english == 0 and got[5].has_text == 1
    f = style_ops.style25(style_ops.post_counts(d, BANKS).withColumn("u", F.lit(1)), ["u"]).first()
    assert f.n_posts == 5 and f.diversity is None and f.no_caption_share == pytest.approx(0.4)


def test_phrases_do_not_swallow_each_other(spark):
    lex = style.Lexicon.of(["in the", "so*", "so"])
    d = spark.createDataFrame([("in the in the xin the in then sofa so",)], "t string").withColumn("k", style.style_tokens("t"))
    assert d.select(lex.hits(F.col("k"), F.lower("t"))).first()[0] == 4


def test_ages(spark):
    d = spark.createDataFrame([("21 years old",), ("12.04.98, 25 $",), (None,)], "s string")
    got = [r[0] for r in d.select(ages.combined("s", F.lit(2022), 2024)).collect()]
    assert (got[0].age, got[0].confidence) == (21, "high") and got[2].age is None and got[2].confidence == "none"
    low = spark.createDataFrame([("15 years old",)], "s string").select(ages.combined("s", F.lit(2010), 2024)).first()[0]
    assert low.conflict and low.confidence == "low"


def test_scarce_cases_choose_first(spark):
    p = spark.createDataFrame([(0, 1, 10, 0, 0.1), (0, 1, 11, 1, 0.2), (0, 1, 12, 0, 0.3), (0, 2, 10, 0, 0.0)], "b int, case_key int, control_key int, strata_apart int, apart double")
    got = sorted(map(tuple, pairs.greedy(p, ["b"], 2).collect()))
    assert got == [(0, 1, 11, True), (0, 1, 12, False), (0, 2, 10, False)]
    assert len(pairs.greedy(p, ["b"], 2, relax=False).collect()) == 2


def test_folds_and_permutations(spark):
    rows = [(i, i % 2, float(i % 2) * 3 + (i * 37 % 11) / 10, float(i * 53 % 17)) for i in range(60)]
    d = spark.createDataFrame(rows, "k long, y int, a double, b double")
    r = modelling.permutation(d, "k", "y", ["a", "b"], permutations=20, rounds=100).first()
    assert r.auc > 0.95 and r.p_one == pytest.approx(1 / 21) and 0.3 < r.null_mean < 0.7
    w = {x.feature: x.place for x in modelling.coefficients(d, "y", ["a", "b"]).collect()}
    assert w == {"a": 1, "b": 2}


def test_objects_in_deep_json(spark):
    deep = "[" * 900 + '{"pk": 1}' + "]" * 900
    d = spark.createDataFrame([(deep,), (None,), ("{",), (json.dumps({"a": [{"b": {}}]}),)], "s string")
    assert [len(r[0]) for r in d.select(jsonwalk.objects("s")).collect()] == [1, 0, 0, 3]


def test_readers(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# list\n@Ana,School,near\nbob,unknown\nkim,club\n\n")
    assert sorted(map(tuple, files.seed_list(spark, str(tmp_path / "seeds.txt"), ["school", "club"]).collect())) == [("ana", "school", "near"), ("kim", "club", None)]
    (tmp_path / "users.csv").write_text("id,user,start,stop\n1,https://x.com/Ana/,2024-01-02,03/04/2024\n2,@bob,never,2024-01-01\n")
    r = files.intake_list(spark, str(tmp_path / "users.csv"), ["yyyy-MM-dd", "MM/dd/yyyy"]).collect()
    assert [(x.id, x.handle, str(x.stop)) for x in r] == [("1", "ana", "2024-03-04 23:59:59")]
    for name, text in (("a.json", '{"rows": [{"id": "1", "status": "ok"}, {"id": "2", "status": "no"}]}'), ("b.json", '[{"id": "3", "status": "ok"}]')):
        (tmp_path / name).write_text(text)
        got = [x.id for x in files.exported(spark, str(tmp_path / name), "id string, status string", "rows", "ok").collect()]
        assert got == (["1"] if name == "a.json" else ["3"])
    assert files.resolve_path({}, "d.csv", ["/x", "/y/"], lambda p: p == "/y/d.csv") == "/y/d.csv" and files.resolve_path({"d.csv": "/z"}, "d.csv", [], lambda p: False) is None
    assert "| 1 | 0.500 |" in files.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double"), "t")
    files.write_report(spark.range(2).withColumn("x", F.struct("id")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_budget_and_fixpoint(spark, tmp_path):
    d = spark.range(100)
    assert incremental.budgeted(d, ["id"], 60, 100, 0.4).count() == 16 and incremental.budgeted(d, ["id"], 200, 100, 0.4).count() == 0
    n = iter(range(100))

    def store(x):
        path = str(tmp_path / f"f{next(n)}")
        x.write.parquet(path)
        return spark.read.parquet(path)

    known, rounds = incremental.fixpoint(lambda i: spark.range(min(10, 4 * (i + 1))), "id", store, target=50)
    assert known.count() == 10 and rounds == 5
    assert incremental.fixpoint(lambda i: spark.range(7), "id", store, target=5)[1] == 1
