"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenfold.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(plain(x.item() if hasattr(x, "item") else x) for x in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


#: Many fits each, without SQL; tests/test_studies.py holds their operators against known values.
FITTED = {"st_permutation", "ml_frame_audit", "ml_cv_bagged"}


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - FITTED))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_published_statistics(spark):
    from pyspark.sql import functions as F

    from lumenfold.functions.numbers import sign_p

    df = spark.createDataFrame([(7, 10), (0, 3), (8, 12), (0, 0)], "up long, down long")
    assert [None if r.p is None else round(r.p, 4) for r in df.select(sign_p("up", "down").alias("p")).collect()] == [0.6291, 0.25, 0.5034, None]
    assert math.isclose(df.select(F.sum("up")).first()[0], 15)


def test_exact_bounds(spark):
    from lumenfold.functions.numbers import beta_upper, fisher_p

    df = spark.createDataFrame([(0, 104), (11, 80)], "k long, n long")
    assert [round(100 * r.u, 1) for r in df.select(beta_upper("k", "n").alias("u")).collect()] == [3.5, 23.3]
    df = spark.createDataFrame([(24, 6, 70, 4)], "a long, b long, c long, d long")
    assert round(df.select(fisher_p("a", "b", "c", "d").alias("p")).first().p, 3) == 0.032


def test_greedy_matching(spark):
    from lumenfold.operators.matching import matched

    rows = [("b", 1, True, 10.0), ("b", 2, True, 11.0), ("b", 3, False, 10.4), ("b", 4, False, 30.0), ("c", 5, True, 1.0)]
    got = matched(spark.createDataFrame(rows, "block string, id long, is_case boolean, score double"), ["block"], "id", "is_case", "score", 1).collect()
    assert sorted((r.case_key, r.control_key) for r in got) == [(1, 3), (2, 4)]


def test_model_separates(spark):
    from lumenfold.operators.modelling import cv_auc

    rows = [(i, i % 2, float(i % 2) + (i * 37 % 11) / 20, (i * 53 % 17) / 17.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, good double, noise double")
    assert cv_auc(df, "id", "y", ["good"], repeats=2).first().mean_auc > 0.95
    assert 0.2 < cv_auc(df, "id", "y", ["noise"], repeats=2).first().mean_auc < 0.8


def test_stream_appends_once(spark, tmp_path):
    from lumenfold.streaming.incremental import append, resume, snowball

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.range(5).write.parquet(src)
    for _ in range(2):
        append(spark.readStream.schema("id long").parquet(src), lambda b: b, out, ck, ["id"]).awaitTermination()
    done = spark.read.schema("id long").option("recursiveFileLookup", "true").parquet(out)
    assert done.count() == 5 and resume(spark.range(7), done, ["id"]).count() == 2
    step = lambda f: f.where("id < 6").selectExpr("id + 2 as id")
    assert sorted(r.id for r in snowball(spark.range(1), step, "id", lambda d: d.checkpoint()).collect()) == [0, 2, 4, 6]


def test_order_keeps_every_row(spark):
    from pyspark.sql import functions as F

    from lumenfold.operators.statistics import placed

    rows = [(i, None if i % 50 == 49 else float(i * 37 % 23)) for i in range(200)]
    got = placed(spark.createDataFrame(rows, "id long, v double"), F.abs(F.col("v") - 11), "id", parts=8).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -abs((r[1] or 0) - 11), r[0]))
    assert [(r.id, r.place) for r in got] == [(i, k + 1) for k, (i, _) in enumerate(want)]
    assert not placed(spark.createDataFrame([], "id long, v double"), F.col("v"), "id").collect()
    assert catalog.QUERIES["srt_abs_dev_all"](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_prompt_has_the_whole_text(spark, tmp_path):
    long = "word " * 2000 + "end"
    rows = [(1, 0, "user", f" \u3000\x1c{long}\n\t"), (1, 1, None, " \n"), (1, 2, "bot", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.QUERIES["render_prompt_whole"](spark, str(tmp_path)).collect()
    assert {r.turn: r.prompt for r in got} == {0: f"TURN 0 BY user TEXT {long}", 1: "TURN 1 (none)", 2: "TURN 2 BY bot (none)"}


def test_kappa_interval_rests_on_all_replicates(spark, tmp_path):
    import hashlib

    import numpy as np

    rows = [(i, int(i % 3 == 0), int(i % 3 == 0) ^ int(i % 5 == 0)) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = catalog.QUERIES["st_kappa_boot_2000"](spark, str(tmp_path)).first()
    cells, ks = sorted((q, x) for _, q, x in rows), []
    for b in range(2000):
        drawn = np.array([cells[int(hashlib.md5(f"k:{b}:{i}".encode()).hexdigest()[:12], 16) % 24] for i in range(24)])
        p, (pa, pb) = (drawn[:, 0] == drawn[:, 1]).mean(), drawn.mean(0)
        chance = pa * pb + (1 - pa) * (1 - pb)
        ks += [(p - chance) / (1 - chance)] if chance < 1 else []
    assert got.replicates == len(ks) > 1900
    assert np.allclose([got.lo, got.hi], np.percentile(ks, [2.5, 97.5]), atol=1e-6)


def test_cross_validation_has_all_repeats(spark):
    got = catalog.QUERIES["ml_cv_auc"](spark, SF).first()
    assert got.repeats == 20 and 0 <= got.mean_auc <= 1 and got.sd_auc > 0


def test_blind_export_takes_twenty_a_group(spark, tmp_path):
    rows = [(i, "big" if i < 50 else "small", "x") for i in range(60)] + [(60, "small", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["an_blind_export_20"](spark, str(tmp_path)).collect()
    codes = {s: sorted(r.code for r in got if r.source == s) for s in ("big", "small")}
    assert codes == {"big": list(range(1, 21)), "small": list(range(1, 11))}
    assert len({r.doc_id for r in got}) == len(got) and 60 not in {r.doc_id for r in got}
