"""Readers and writers on small files."""

import json

from lumenfold.sources import files


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid,text\n1,"two\nlines ""q"""\n2,\n')
    rows = files.csv(spark, str(tmp_path / "a.csv"), "id long, text string")
    assert sorted(map(tuple, rows.collect())) == [(1, 'two\nlines "q"'), (2, None)]
    files.write_csv(rows, str(tmp_path / "out"), ["text", "id"])
    assert files.csv(spark, str(tmp_path / "out"), "text string, id long").count() == 2
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "n.json").write_text(json.dumps({"items": [{"id": "x"}, {"id": "y"}]}, indent=1))
    assert [r.id for r in files.nested(spark, str(tmp_path / "n.json"), "id string", "items").collect()] == ["x", "y"]


def test_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# head\nOne\n\n two \none\n")
    assert sorted(r.word for r in files.wordlist(spark, str(tmp_path / "w.txt")).collect()) == ["one", "two"]
    (tmp_path / "l.txt").write_text("Word;Joy;0.9\nodd\tFear\t0.2\nplain\n")
    assert [tuple(r) for r in files.scored_lexicon(spark, str(tmp_path / "l.txt")).collect()] == [("word", "joy")]
    (tmp_path / "c.txt").write_text("Ann # a friend # of b\nbob\n")
    assert sorted(map(tuple, files.comment_list(spark, str(tmp_path / "c.txt")).collect()), key=str) == [("ann", "a friend # of b"), ("bob", None)]


def test_folders(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x_1.html").write_text("<a>")
    (tmp_path / "p" / "x_2.html").write_text("<b>")
    assert [tuple(r) for r in files.html_folder(spark, str(tmp_path / "p")).collect()] == [("x", "<a>")]
    (tmp_path / "m").mkdir()
    for name, data in (("a", b"\0\0\0\1ftypmp4"), ("b", b"\0\0\0\1moof"), ("c", b"text text")):
        (tmp_path / "m" / name).write_bytes(data)
    assert sorted((r.path[-1], r.kind) for r in files.media_folder(spark, str(tmp_path / "m")).collect()) == [("a", "complete"), ("b", "fragment"), ("c", "odd")]
    bare = spark.createDataFrame([(bytearray(),), (None,)], "content binary").select(files.media_kind("content").alias("k"))
    assert [r.k for r in bare.collect()] == ["absent", "absent"]
    rows = spark.createDataFrame([("P1", 1, "f"), ("P2", 1, "f"), ("C1", 2, "g")], "id string, at long, file string")
    assert [r.file for r in files.newest(rows, "id", "P", "at", "file").collect()] == ["f"]
