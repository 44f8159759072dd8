"""The pipeline against brute force, stage by stage, each on the rows that its predecessor kept."""

import hashlib

import pytest

import corpus_pipeline as P
from lumenfold.llm import bpe, mixing

EN = "the cat and the dog sat on the mat with all of their friends that day".split()
FR = "le chat et le chien sont dans la maison avec une amie de la ville".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, __x string"


def made():
    rows = []
    for i in range(60):
        words = EN if i % 2 else FR
        text = " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] + ("" if j % 4 else str(i)) for j in range(30 + i))
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}" if i % 10 else None))
    near = lambda t, k: " ".join(w if j != k else "changed" for j, w in enumerate(t.split()))
    rows += [(100 + i, rows[i][1].upper() if i % 3 else rows[i][1], rows[i][2], "s0") for i in range(8)]
    rows += [(200 + i, near(rows[40 + i][1], 0), rows[40 + i][2], "s1") for i in range(8)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, "12 !!", None, "s2"), (5, rows[5][1], "en", "s2"), (303, "le chat", "fr", "s2")]
    return [(*r, 1, "u", "x") for r in rows]


def exact(rows):
    keep = {}
    for r in rows:
        key = (r.text or "").encode().lower()
        if key not in keep or r.doc_id > keep[key].doc_id:
            keep[key] = r
    return sorted(r.doc_id for r in keep.values())


def near(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(least.values())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(made(), SCHEMA)
    docs.write.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.stored(stage(spark, out[-1], sf), name))
    return sf, out


def test_stages(spark, stages):
    sf, out = stages
    assert all(d.columns == out[0].columns for d in out[1:-1])
    raw, spoken, single, apart, mixed = (d.collect() for d in out[:-1])
    assert {300, 301, 302}.isdisjoint({r.doc_id for r in spoken}) and {r.doc_id for r in spoken} <= {r.doc_id for r in raw} and len(spoken) > 60
    assert sorted(r.doc_id for r in single) == exact(spoken) and len(single) < len(spoken)
    assert sorted(r.doc_id for r in apart) == near(single) and len(apart) < len(single)
    size = lambda r: len(r.text.split())
    targets = {r.source: r.target for r in mixing.mix(out[3]).collect()}
    for source, target in targets.items():
        longest = max(size(r) for r in apart if r.source == source)
        assert abs(sum(size(r) for r in mixed if r.source == source) - target) <= longest
    enc = bpe.encoder(bpe.RANKS)
    want = sorted((r.doc_id, len(i := enc.encode_ordinary(r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    got = out[-1].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_run_is_its_stages(spark, stages):
    sf, out = stages
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, out[-1].collect()))
