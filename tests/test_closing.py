from pyspark.sql import functions as F

from lumenfold.operators import anonymise as N
from lumenfold.operators import replies as R


def li(inner):
    return f"<li><div><div>{inner}</div></div></li>"


def test_replies_by_mention_inside_and_before_the_link():
    page = "<ul>" + li('<a href="/ana/">ana</a> 3 sem <a href="/bob/">@bob</a> gracias 1 Me gusta <button>Responder</button>')
    page += li('<a href="/eva.l/">eva.l</a> <span>@<a href="/bob/">bob</a></span> yes 2 w <button>Reply</button>') + "</ul>"
    assert R.replies_of(page) == [("ana", "bob", "gracias"), ("eva.l", "bob", "@ bob yes")]


def test_replies_by_structure_skip_links_of_inner_lists():
    inner = '<ul><li><a href="/eva/">eva</a> <a href="/ana/">ana</a> no <b>Reply</b></li></ul>'
    page = f'<ul><li><a href="/ana/">ana</a> root <b>Reply</b>{inner}</li></ul>'
    assert R.replies_of(page) == [("eva", "ana", "no")]


def test_no_replies_without_button_or_accounts():
    link = '<a href="/ana/">ana</a> <a href="/bob/">@bob</a>'
    assert R.replies_of(None) == R.replies_of("") == []
    assert R.replies_of(f"<li>{link} hello</li>") == []
    assert R.replies_of('<li><a href="/reels/">x</a> <a href="/bob/">@bob</a> hello Reply</li>') == []
    # with nothing before it the button's word is what is left
    assert R.replies_of(f"<li>{link} Reply</li>") == [("ana", "bob", "Reply")]
    assert R.replies_of(f"<li>{link} {'long ' * 100} Reply</li>") == []
    assert R.replies_of(f"<script>Reply</script><li>{link} hello</li>") == []
    assert R.replies_of(f"<li>{link} hi Reply</li>" * 2) == [("ana", "bob", "hi")]


def test_replies_of_a_table(spark):
    rows = [(1, '<li><a href="/ana/">ana</a> <a href="/bob/">@bob</a> hi Reply</li>', "x"), (2, None, "y"), (3, "<p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, author string")
    assert [tuple(r) for r in R.replies(df, "page_id", "html").collect()] == [(1, 0, "ana", "bob", "hi")]
    assert R.replies(df.limit(0), "page_id", "html").count() == 0


SCHEMA = "pid string, post long, handle string, bio string, caption string, at string, comment struct<author:string,said:string,deep:array<struct<t:string>>>, tags map<string,string>"


def project(df, spark):
    known = spark.createDataFrame([("maria.g",), ("the",), (None,)], "handle string")
    return N.project_anonymous(df, "pid", ["post"], "post", "handle", "pid", known, people=["author"], drop=["bio"], keep=["at"])


def test_every_string_of_the_schema_is_cleaned(spark):
    rows = [
        ("P1", 1, "Own.er", "secret", "44 likes - zoe on July 20: see https://w.example/own.er/p/x and https://w.example/kim_1/reel/y", "2024-01-01",
         ("Ana", "hi @OWN.ER and @ana, the maria.g maria.g2 own.er!", [("#Maria.G",), (None,)]), {"k": "@zoe"}),
        ("P1", 2, "Own.er", None, None, None, None, None),
        ("P2", 1, None, "b", "plain words, no names", "d", (None, "", []), {}),
    ]
    got = {(r["pid"], r["post"]): r for r in project(spark.createDataFrame(rows, SCHEMA), spark).collect()}
    r = got["P1", 1]
    # people of P1 in order of sight, then name: ana, kim_1, maria.g, zoe
    assert "bio" not in r.asDict() and "handle" not in r.asDict() and r["at"] == "2024-01-01"
    assert r["caption"] == "44 likes - Anonymous_4 on July 20: see https://w.example/P1/p/x and https://w.example/Anonymous_2/reel/y"
    assert r["comment"]["author"] == "Anonymous_1"
    assert r["comment"]["said"] == "hi @P1 and @[Anonymous 1], the Anonymous_3 maria.g2 P1!"
    assert [x["t"] for x in r["comment"]["deep"]] == ["#Anonymous_3", None]
    assert r["tags"] == {"k": "@[Anonymous 4]"}
    assert got["P1", 2]["caption"] is None and got["P1", 2]["comment"] is None and got["P1", 2]["tags"] is None
    assert got["P2", 1]["caption"] == "plain words, no names" and got["P2", 1]["comment"]["said"] == ""


def test_repeated_and_null_keys_leave_no_handle(spark):
    rows = [(None, None, None, None, "- zoe on May 1", None, None, None), ("P1", 1, "me", None, "@ana", "x", None, None), ("P1", 1, "me", None, "@bob @ana", "y", None, None)]
    got = sorted(r["caption"] for r in project(spark.createDataFrame(rows, SCHEMA), spark).collect())
    assert got == ["- Anonymous_1 on May 1", "@[Anonymous 1]", "@[Anonymous 2] @[Anonymous 1]"]


def test_no_rows_and_no_strings(spark):
    assert project(spark.createDataFrame([], SCHEMA), spark).count() == 0
    df = spark.range(3).select(F.col("id").alias("pid"), F.col("id").alias("post"), F.lit(None).cast("string").alias("handle"), (F.col("id") * 2).alias("n"))
    known = spark.createDataFrame([], "handle string")
    got = N.project_anonymous(df, "pid", ["post"], "post", "handle", "pid", known)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]


def test_the_pipeline_agrees_with_its_parts(spark):
    from lumenfold.plans import catalog

    sf = "/root/testdata/sf0.001"
    row = catalog.QUERIES["mt_pipeline"](spark, sf).collect()[0]
    pairs = catalog.QUERIES["mt_greedy_scarce"](spark, sf).collect()
    short = [r for r in pairs if r["relaxed"]]
    assert (row["matched"], row["relaxed"]) == (len(pairs), len(short))
    held = {}
    for r in pairs:
        held[r["case_key"]] = held.get(r["case_key"], 0) + 1
    assert row["cases"] - row["short"] == sum(n == 2 for n in held.values())
    assert 0 <= row["auc"] <= 1 and row["verdict"] in ("same", "weak", "different")


def test_subsets_of_a_study_impute_for_themselves(spark):
    from lumenfold.operators import closing as C

    rows = [(i, i % 2, float(i), None if i % 3 else float(i % 2), i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, n long")
    got = C.sensitivity(C.most_active(df, "id", "y", "n", 4), "id", "y", [("all", F.lit(True), ["a", "b"], False), ("less active", ~F.col("top"), ["a"], False), ("with b", F.col("b").isNotNull(), ["b"], True)], 4, 2)
    got = {r["pool"]: (r["n"], r["mean_auc"]) for r in got.collect()}
    assert {k: n for k, (n, _) in got.items()} == {"all": 40, "less active": 36, "with b": 14}
    assert got["with b"][1] == 1.0 and got["all"][1] > 0.6
