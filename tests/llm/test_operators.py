"""The operators against brute force on small hostile tables."""

import hashlib
from collections import Counter

import pytest

from lumenfold.llm import bpe, crf, exact_dedup, jaccard, licences, mixing, quality, secrets, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, key string, score string"
LONG = " ".join(f"w{i}" for i in range(90))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG.upper(), "en", None), (4, "x " + LONG + " y", "en", "b"),
    (5, None, None, "a"), (6, "", "fr", None), (7, "one two", "fr", "a"), (8, "One  TWO", "fr", "b"), (8, "One  TWO", "fr", "b"),
    (9, "MIT License mit license\npassword = 'abcdEF123456!' token: qwertyuiop", "en", "c"), (10, "line a\nline a\nline a\n" * 30, "en", "c"),
    (11, " é世 😀 ##", "de", "c"), (12, "123 456 !!", None, "z"), (None, "no id " + LONG[:200], "en", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "u", "k", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, empty):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in ROWS]
    seen = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    want = []
    for i, w in texts:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    for sizes in ({}, {"hot": 0}):
        assert sorted(map(str, (tuple(r) for r in substrings.strip(docs, texts=False, **sizes).collect()))) == sorted(map(str, want))
    assert substrings.strip(empty).count() == 0


def test_exact(docs, empty):
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({(t or "").encode().lower() for _, t, *_ in ROWS})
    assert {r.doc_id: r.keep_id for r in got}[1] == 3 and exact_dedup.groups(empty).count() == 0
    assert exact_dedup.groups(docs, capacity=1, max_depth=3).count() == len(ROWS)


def test_jaccard(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got[1] == (88, 1) and got[2][1] == got[3][1] == got[4][1] == 1 and got[5] == (0, 5) and got[7][1] == got[8][1] == 7
    assert jaccard.join(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) < 1 for t, n in by.values()) and mixing.mix(empty).count() == 0


def test_bpe(docs):
    enc = bpe.encoder(bpe.RANKS)
    for r in bpe.with_tokens(docs.where("doc_id is not null")).collect():
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        assert r.ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    long = "Mixed  words\n\nit's 12 \t" * 9000
    assert "".join(bpe.parts(long, 500)) == long and len(bpe.parts(long, 500)) > 100
    assert [i for p in bpe.parts(long, 500) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(long)


def test_language(docs, empty):
    model = crf.fit([("en", b"the of and with that"), ("fr", b"le de une avec que")] * 20, sequences=128)
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf.predict(docs, model, ["doc_id"]).collect()}
    assert got[5] == got[6] == got[12] == ("und", 0.0) and got[11][0] in ("en", "fr")
    assert crf.fit(crf.sample(empty)).labels == [] and crf.predict(empty, model, ["doc_id"]).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[10].n_dup_lines == 89 and got[10].n_repeat_words == 180 and got[10].base_failed and not got[5].kept and got[1].kept
    assert quality.judge(docs, labels.limit(0)).count() == len(ROWS)


def test_secrets(docs):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[9].n_assign == 2 and "lexed" in got[9].spans and got[5].spans == ""
    assert secrets.lexed('k = "s3cr3tVALUE99"\ndb_password = k') == [(5, 18)]


def test_licences(docs, empty):
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert (got[9].n_base, got[9].first_word, got[9].last_word, got[9].base_labels) == (2, 0, 2, "mit")
    assert got[5].n_words == 0 and got[5].first_word is None and licences.scan(empty).count() == 0
