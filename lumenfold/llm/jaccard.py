"""Jaccard self-join of shingle sets by PartEnum signatures, and the components of its links.

Documents with equal sets are one node. Sizes fall into bands; sets of size at most u with a Jaccard
similarity of 90/100 or more differ in at most k = floor(2u * 10 / 190) elements. A band's instance hashes
the feature domain into n1 partitions and each of these into n2 cells, and of the cells of a partition it
enumerates the subsets of n2 - k2: a signature is the elements of one subset. k differences leave some
partition with k2 or fewer, k2 = ceil((k + 1) / n1) - 1, and so one of its subsets whole. Narrow bands (k up to
PAIRS) enumerate subsets of two: k <= 2 in one partition of k + 2 cells, others in (k + 1) / 2 partitions of
three, where small sets need selective signatures. Wide bands enumerate the single cells of partitions of
two: subsets of two would make half as many signatures again, and large sets' cells are selective as they are.

Put in one order for all sets, by falling number of elements and then by value, the signatures of two sets that
differ in d elements have one in common among the first lost(d) + 1, where lost(d) is the most signatures that d
differences change; so a set signs only that many. The order keeps tiny subsets from joining unrelated sets.
A set near its band's top is signed for the next band too. Nothing similar is missed.

Signatures that one node has alone end in a combining aggregation. The others form stars: each node with
the smallest node of its signature, never all pairs. A set carries the parities of its elements' counts by
hashed cell; an element by which two sets differ turns one parity at most, so pairs whose parities differ in
more places than the limit allows cannot link, and only the others are verified on whole sets. Stars are
verified first, strongest first, and linked nodes become components. Where a signature still spans several
components its members meet a second centre, drawn by hash, so that a set meets another one by each of its
signatures; where it spans several even then, the pairs across components follow. So every link between different components is examined,
and the components are exact, whatever the size of a group.

Defined results: texts with fewer words than a shingle are one shingle; null and wordless texts have
n_shingles 0 and are their own component; equal sets are linked; rows that repeat are rows of their own,
in one component; a null doc_id takes part and is never smallest unless it is alone. Shingles are
compared by 64-bit hashes, equal sets by 128 bits and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, discard, documents, grams, map_texts, mix, packed, runs, stored, tie_order, unpacked

SHINGLE, SIMILARITY = 3, 90
#: Sizes of a band grow by this much; bands with at most PAIRS differences enumerate subsets of two cells;
#: partitions of two cells are SPARE times (k + 1) / 2.
BAND, PAIRS, SPARE = 1.5, 16, 1.25
#: Cells of a set's parities for each element it may differ by, and the fewest and most 64-bit words of them.
CELLS, LEAST, MOST = 12, 2, 32
#: Members that a verifying group holds for each copy of its centre's set.
GROUP = 256
_C = np.uint64(0xA0761D6478BD642F)


def bands(upto: int, percent: int = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(u, k, n1, n2) of each band, until sizes upto and the band after are covered."""
    out = [((100 + percent) // (2 * (100 - percent)), 0, 1, 0)]
    while len(out) < 3 or out[-2][0] < upto:
        u = max(out[-1][0] + 1, int(out[-1][0] * BAND))
        k = 2 * u * (100 - percent) // (100 + percent)
        wide = (u, k, int(np.ceil(SPARE * (k + 1) / 2)) + 1, 2)
        out.append((u, k, 1, k + 2) if k <= 2 else (u, k, (k + 2) // 2, 3) if k <= PAIRS else wide)
    # the first band's sets differ in nothing, so they are equal; its bound is the largest such size
    first = max(u for u in range(out[0][0] + 1) if 2 * u * (100 - percent) // (100 + percent) == 0)
    out[0] = (first, 0, 1, 0)
    return out


def lost(differ: np.ndarray, n1: np.ndarray, n2: int) -> np.ndarray:
    """The most signatures that so many differences change: one each of single cells, two of three of a pair's first."""
    if n2 == 2:
        return differ
    if n2 == 3:
        return np.minimum(2 * differ, n1 + differ)
    left = np.maximum(n2 - differ, 0)
    return n2 * (n2 - 1) // 2 - left * (left - 1) // 2


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: owner, value, in order of both, and their number by text."""
    h = w.lower_hash()
    g = grams(h, n)
    at = np.flatnonzero(w.owner[: len(g)] == w.owner[n - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    owner = np.concatenate((w.owner[at], few))
    value = np.concatenate((g[at], runs(h, w.first[few], w.count[few])))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        owner, value = owner[new], value[new]
    return owner, value, np.bincount(owner, minlength=len(w.texts))


def _sums(value: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(value, start[some])
    return out


def signatures(owner: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of each signed subset."""
    table = np.array(bands(int(size.max(initial=1)), percent))
    own = np.searchsorted(table[:, 0], size)
    nxt = np.where(size * 100 // percent > table[own, 0], own + 1, 0)
    texts, sigs = [], []
    for inst, n2 in [(inst, n2) for inst in (own, nxt) for n2 in sorted(set(table[1:, 3].tolist()))]:
        of = np.flatnonzero((inst > 0) & (size > 0) & (table[inst, 3] == n2))
        if not len(of):
            continue
        upto, parts, of_size = table[inst[of], 0], table[inst[of], 2], size[of]
        # what a set differs by from a similar one of this band, at most
        differ = (100 - percent) * (of_size + np.minimum(upto, of_size * 100 // percent)) // (100 + percent)
        lead = np.concatenate(([0], np.cumsum(parts)))
        rank = np.full(len(size), -1)
        rank[of] = np.arange(len(of))
        el = np.flatnonzero(rank[owner] >= 0)
        r = rank[owner[el]]
        v = mix(value[el] ^ _C)
        part = lead[r] + ((v >> np.uint64(20)) % parts[r].astype(np.uint64)).astype(np.int64)
        cell = part * n2 + ((v & np.uint64(0xFFFFF)) % np.uint64(n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        count = np.bincount(cell, minlength=int(lead[-1]) * n2)
        start = np.concatenate(([0], np.cumsum(count)[:-1]))
        total = _sums(v[order], start, count).reshape(-1, n2)
        count = count.reshape(-1, n2)
        # a subset of one cell is the cell, of two cells a pair
        i, j = (np.arange(2), None) if n2 == 2 else np.triu_indices(n2, 1)
        set_of = np.repeat(np.arange(len(of)), parts)
        place = np.arange(len(set_of)) - lead[set_of]
        name = (inst[of][set_of] * (1 << 32) + place * len(i))[:, None] + np.arange(len(i))
        elements, held = (total, count) if j is None else (total[:, i] + total[:, j], count[:, i] + count[:, j])
        sig, held = mix(elements + mix(name.astype(np.uint64))).ravel(), held.ravel()
        each = np.repeat(set_of, len(i))
        ranked = np.lexsort((sig, -held, each))
        nth = np.arange(len(each)) - (lead[:-1] * len(i))[each]
        keep = ranked[nth <= lost(differ, parts, n2)[each]]
        texts.append(of[each[keep]])
        sigs.append(sig[keep])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(sigs)


def parities(owner: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, their number by text): how often elements fall into each cell, modulo 2."""
    cells = CELLS * 2 * size * (100 - percent) / (100 + percent)
    words = 1 << np.ceil(np.log2(np.clip(cells / 64, LEAST, MOST))).astype(np.int64)
    lead = np.concatenate(([0], np.cumsum(words)[:-1]))
    cell = mix(value - _C)
    out = np.zeros(int(words.sum()), np.uint64)
    place = lead[owner] + (cell >> np.uint64(6)).astype(np.int64) % words[owner]
    np.bitwise_xor.at(out, place, np.uint64(1) << (cell & np.uint64(63)))
    return out, words


def may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether the sizes and parities of two sets allow a link."""

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    # numbers of words are powers of two; those of similar sets are equal or one is twice the other
    x = F.when(F.size(pa_) > F.size(pb), halved(pa_)).otherwise(pa_)
    y = F.when(F.size(pb) > F.size(pa_), halved(pb)).otherwise(pb)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, bits: total + bits)
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def signed(docs: DataFrame, percent: int = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """(doc_id, tp, n, f1, f2, sigs, par) of each row of docs (doc_id, tp, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        owner, value, size = shingles(Words(texts), n)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        f1, f2 = _sums(mix(value + _C), start, size), _sums(mix(value ^ ~_C), start, size)
        who, sig = signatures(owner, value, size, percent)
        order = np.argsort(who, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(texts)))))
        sigs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sig[order].view(np.int64)))
        words, many = parities(owner, value, size, percent)
        par = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(words.view(np.int64)))
        for name, x in (("n", pa.array(size.astype(np.int64))), ("f1", pa.array(f1.view(np.int64))), ("f2", pa.array(f2.view(np.int64))), ("sigs", sigs), ("par", par)):
            kept = kept.append_column(name, x)
        return kept

    return map_texts(docs, ["doc_id", "tp"], run, f"doc_id {kind}, tp bigint, n bigint, f1 bigint, f2 bigint, sigs array<bigint>, par array<bigint>")


def _overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, member, lead, set) by group, the centre first: the size of each overlap, a group at a time."""
    now, centre = None, np.zeros(0, np.uint64)
    for batch in it:
        a, part, member, lead = (batch.column(i).to_numpy() for i in range(4))
        sets, out = batch.column(4), []
        lengths = pc.binary_length(sets).to_numpy() // 8
        bound = np.concatenate(([0], np.cumsum(lengths)))
        data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sets]) if len(sets) else centre
        firsts = np.flatnonzero(lead == 0)
        edges = np.unique(np.concatenate(([0], firsts, [batch.num_rows])))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if lead[lo] == 0:
                now, centre = (a[lo], part[lo]), data[bound[lo] : bound[lo + 1]].copy()
                lo += 1
            if lo < hi:
                if ((a[lo:hi] != now[0]) | (part[lo:hi] != now[1])).any() if now else True:
                    raise ValueError(f"a group of {a[lo]} has no centre")
                x = data[bound[lo] : bound[hi]]
                met = np.concatenate(([0], np.cumsum(centre[np.searchsorted(centre, x).clip(max=len(centre) - 1)] == x)))
                both = met[bound[lo + 1 : hi + 1] - bound[lo]] - met[bound[lo:hi] - bound[lo]]
                out.append((a[lo:hi], member[lo:hi], both, np.full(hi - lo, len(centre)), lengths[lo:hi]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "both", "na", "nb"])


def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(a, b, both, na, nb) of each pair (a, b), from whole sets; a centre's set travels once a group."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "b", "part")
    members = grouped.join(sets, F.col("b") == F.col("uid")).select("a", "part", F.col("b").alias("member"), F.lit(1).alias("lead"), "set")
    centres = grouped.select("a", "part").distinct().join(sets, F.col("a") == F.col("uid")).select("a", "part", F.col("a").alias("member"), F.lit(0).alias("lead"), "set")
    rows = members.unionByName(centres)
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "lead", "member")
    return stored(rows.mapInArrow(_overlaps, "a bigint, b bigint, both bigint, na bigint, nb bigint").distinct(), name)


def linked(v: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    return v.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(uid, comp), stored: the smallest node that links reach, by hooking and pointer jumping, round by round."""
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "jac-edges")
    comp = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c"), F.lit(True).alias("moved")), "jac-comp")
    while True:
        near = both.join(comp.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("cv"))
        low = comp.join(near, "u").select("u", "c", F.least("c", "cv").alias("low"))
        # the old root follows the smallest label that any of its nodes saw, then labels jump once
        root = low.groupBy("c").agg(F.min("low").alias("to"))
        hooked = low.join(root, "c").select("u", "c", F.least("low", "to").alias("low"))
        jump = hooked.select(F.col("u").alias("low"), F.col("low").alias("then"))
        new = stored(hooked.join(jump, "low", "left").select("u", F.least("low", F.coalesce("then", "low")).alias("c"), (F.least("low", F.coalesce("then", "low")) != F.col("c")).alias("moved")), "jac-comp")
        discard(comp)
        comp = new
        if new.where("moved").isEmpty():
            discard(both)
            return new.select(F.col("u").alias("uid"), F.col("c").alias("comp"))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (uid, comp) with further links: only the components that these join are worked out anew."""
    ca, cb = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    hops = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    hops = stored(hops, "jac-hops")
    if hops.isEmpty():
        return comp
    more = components(hops).toDF("of", "to")
    known = comp.join(more, comp["comp"] == more["of"], "left").select("uid", F.coalesce("to", "comp").alias("comp"))
    new = more.join(comp, more["of"] == comp["uid"], "left_anti").select(F.col("of").alias("uid"), F.col("to").alias("comp"))
    out = stored(known.unionByName(new), "jac-comp")
    discard(hops)
    return out


def join(df: DataFrame, percent: int = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """(doc_id, tp, n_shingles, component_id, uid, comp) of each row of df; comp is the component's node."""
    docs = df.select("doc_id", F.xxhash64("text").alias("tp"), "text")
    all_of = stored(signed(docs, percent, n).withColumn("uid", F.monotonically_increasing_id()), "jac-signed")
    rows = stored(all_of.drop("sigs"), "jac-rows")
    nodes = stored(rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("uid").alias("node")), "jac-nodes")
    sig = all_of.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select("uid", F.explode("sigs").alias("sig"))
    # signatures are counted without their nodes, and only those that are shared carry more
    shared = sig.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    member = stored(sig.join(shared, "sig", "left_semi").select("sig", F.col("uid").alias("b")), "jac-members")
    discard(all_of)
    least = member.groupBy("sig").agg(F.min("b").alias("a"))
    star = stored(member.join(least, "sig").where("a != b"), "jac-stars")
    shape = rows.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select("uid", "n", "par")
    spokes = star.groupBy("a", "b").agg(F.count("*").alias("weight"))
    ends = spokes.join(shape.toDF("b", "nb", "pb"), "b").join(shape.toDF("a", "na", "pa"), "a")
    spokes = stored(ends.where(may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)).select("a", "b", "weight"), "jac-spokes")
    key = rows.join(member.select(F.col("b").alias("uid")).distinct(), "uid", "left_semi").select("uid", F.col("doc_id").alias("d"), F.col("tp").alias("t"))
    held = docs.join(key, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["tp"] == F.col("t"))).select("uid", "text")

    def lift(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        owner, value, size = shingles(Words(texts), n)
        return kept.append_column("set", pa.array([x.tobytes() for x in np.split(value, np.cumsum(size)[:-1])], pa.binary()))

    # a row of the documents that repeats lifts its set again
    sets = stored(map_texts(held, ["uid"], lift, "uid bigint, set binary").dropDuplicates(["uid"]), "jac-sets")
    discard(member)
    best = spokes.groupBy("b").agg(F.max(F.struct("weight", -F.col("a"))).alias("top")).select((-F.col("top.col2")).alias("a"), "b")
    seen = verified(best, sets, "jac-first")
    comp = components(linked(seen, percent))

    def further(pairs: DataFrame, name: str) -> DataFrame:
        found = verified(pairs, sets, name)
        out = merged(comp, linked(found, percent))
        discard(found)
        return out

    comp = further(across(spokes.select("a", "b").join(best, ["a", "b"], "left_anti"), comp), "jac-rest")
    few = _mixed(star.select("sig", "b").join(shape.toDF("b", "nb", "par"), "b"), comp)
    discard(seen, spokes, star)
    drawn = _drawn(few, percent)
    comp = further(drawn, "jac-drawn")
    left = _mixed(few.drop("comp"), comp)
    cross = _across(left, percent)
    comp = further(cross, "jac-cross")
    discard(few, drawn, left, cross, sets)
    node = rows.join(nodes, ["f1", "f2", "n"], "left").join(comp.withColumnRenamed("uid", "node"), "node", "left")
    node = node.select("doc_id", "tp", F.col("n").alias("n_shingles"), "uid", F.coalesce("comp", "node", "uid").alias("comp"))
    least = node.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return node.join(least, "comp").select("doc_id", "tp", "n_shingles", "component_id", "uid", "comp")


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) that stand in different components."""
    ca, cb = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    return pairs.join(ca, "a", "left").join(cb, "b", "left").where(apart).select("a", "b")


def _mixed(member: DataFrame, comp: DataFrame) -> DataFrame:
    """member (sig, b, nb, par) with comp, where a signature spans several components."""
    # the star's centre has met every member, so members alone are left
    m = member.join(comp.toDF("b", "c"), "b", "left").withColumn("comp", F.coalesce("c", "b"))
    mixed = m.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
    return stored(m.join(mixed, "sig", "left_semi").select("sig", "b", "nb", "par", "comp"), "jac-mixed")


def _drawn(m: DataFrame, percent: int) -> DataFrame:
    """The pairs of each signature's drawn centre and members of other components that may link."""
    centre = m.groupBy("sig").agg(F.min_by(F.struct("b", "nb", "par", "comp"), F.xxhash64("sig", "b")).alias("x"))
    on = (F.col("x.comp") != F.col("comp")) & may_link(F.col("x.nb"), F.col("x.par"), F.col("nb"), F.col("par"), percent)
    pairs = m.join(centre, "sig").where(on).select(F.least("x.b", "b").alias("a"), F.greatest("x.b", "b").alias("b"))
    return stored(pairs.distinct(), "jac-pairs")


def _across(m: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of one signature that stand in different components and may link."""
    x, y = m.alias("x"), m.alias("y")
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.b") < F.col("y.b"))
    on &= may_link(F.col("x.nb"), F.col("x.par"), F.col("y.nb"), F.col("y.par"), percent)
    return stored(x.join(y, on).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct(), "jac-across")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of five-word shingles at similarity 0.8 the smallest row stays.

    The smallest by doc_id, nulls last, then by the text's hash; of rows that agree in both the first by all its columns.
    """
    found = join(docs, 80, 5)
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tp")).alias("m")).select(F.col("m.doc_id").alias("d"), F.col("m.tp").alias("t")).distinct()
    row = F.col("row")
    rows = packed(docs).withColumn("fp", F.xxhash64(row["text"]))
    got = rows.join(first, row["doc_id"].eqNullSafe(F.col("d")) & (F.col("fp") == F.col("t")))
    rank = F.row_number().over(Window.partitionBy("fp", row["doc_id"]).orderBy(*tie_order()))
    return unpacked(got.withColumn("rank", rank).where("rank = 1"), docs)


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLES: dict[str, str] = {}
