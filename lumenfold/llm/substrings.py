"""Repeated passages of WINDOW words, by compressed FM-indexes over shards of the corpus.

Sharding. A window's key is the smallest hash of its runs of ANCHOR words (the leftmost, if equal), so equal
windows have equal keys wherever they stand. Consecutive windows with one key are a segment of at most
2 * WINDOW - ANCHOR words, and no window repeats within one segment. Keys seen once end there. Equal
segments are counted by map-side aggregation, so copies, however many, are one row; a segment seen twice
repeats in full. What is left are keys with different segments: where passages begin and end, near copies.

Index. Each shard of keys is one text of words, its Burrows-Wheeler transform in a wavelet matrix whose bit
vectors are packed with block ranks. The shard's segments are streamed through backward search, many at a
time: a search goes left while two or more places match; its reach is the matching statistic, windows
within it repeat, and the next search starts where the one that failed can still give a window. A key with
more than HOT_SEGMENTS different segments is cut into single windows, whose counts need no shard.

Defined results: null text has no words; texts of fewer words than a window lose nothing; windows repeat
within one document too; rows that repeat are places of their own; extra columns are not read; an empty
table gives no rows. Words are compared by 64-bit hashes, segments by key and another 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, documents, grams, map_texts, mix, runs, stored

WINDOW, ANCHOR = 35, 8
#: Segments of a shard's index, and different segments of a key beyond which it is cut into windows.
SHARD_SEGMENTS, HOT_SEGMENTS = 20_000, 20_000


def anchors(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the smallest of g[i : i + width], the leftmost if equal."""
    v, p, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        n = len(v) - step
        right = v[step:] < v[:n]
        v, p = np.where(right, v[step:], v[:n]), np.where(right, p[step:], p[:n])
        have += step
    return p


def segments(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """By segment: owner, start (word of the text), n (windows), key, body (64 bits of its words)."""
    h = w.hash
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return {"owner": none, "start": none, "n": none, "key": none, "body": none}
    g = grams(h, anchor)
    at = anchors(g, window - anchor + 1)
    ok = w.owner[: len(h) - window + 1] == w.owner[window - 1 :]
    i = np.flatnonzero(ok)
    if not len(i):
        return {"owner": none, "start": none, "n": none, "key": none, "body": none}
    new = np.concatenate(([True], (at[i][1:] != at[i][:-1]) | (np.diff(i) != 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(i)])))
    s = i[first]
    return {"owner": w.owner[s], "start": s - w.first[w.owner[s]], "n": n, "key": g[at[s]].view(np.int64), "body": runs(h, s, n + window - 1).view(np.int64)}


def cut(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        s = segments(Words(texts), window, anchor)
        out = kept.take(pa.array(s["owner"]))
        for name, kind in (("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("body", pa.int64())):
            out = out.append_column(name, pa.array(s[name]).cast(kind))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, ["doc_id", "fp"], run, f"doc_id {kind}, fp bigint, start int, n int, key bigint, body bigint")


class Bits:
    """A bit vector in 64-bit words, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bool))), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Of sequences of symbols 1..sigma - 1, each ended by 0."""

    def __init__(self, text: np.ndarray, sigma: int, longest: int):
        sa = suffix_array(text, longest)
        bwt = text[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift) & 1 > 0
            self.levels.append((shift, Bits(bit)))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))
        # where a symbol's run starts at the last level: rank of a symbol is its end less this
        self.base = np.zeros(sigma, np.int64)
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 > 0, bits.zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of what matches after a symbol is put before it."""
        both = self._descend(np.concatenate((symbol, symbol)), np.concatenate((lo, hi))) - np.concatenate((self.base[symbol],) * 2)
        c = self.first[symbol]
        return c + both[: len(lo)], c + both[len(lo) :]


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """By prefix doubling; beyond a sequence's end the order of equal suffixes is that of their places."""
    rank, n, reach = text.astype(np.int64), len(text), 1
    order = np.argsort(rank, kind="stable")
    while reach <= longest + 1:
        after = np.zeros(n, np.int64)
        after[:-reach] = rank[reach:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        if rank[order[-1]] == n - 1:
            break
        reach *= 2
    return order


def statistics(seqs: list[np.ndarray], ask: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """By sequence a mask of its windows that stand in two or more of the sequences; ask: which to stream."""
    length = np.array([len(s) for s in seqs])
    words, symbol = np.unique(np.concatenate(seqs), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    text = np.zeros(int(length.sum()) + len(seqs), np.int64)
    at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
    text[at] = symbol + 1
    index = FMIndex(text, len(words) + 1, int(length.max()))
    mask = np.zeros(len(seqs), np.int64)
    lane = np.flatnonzero(ask)
    # of each lane: the search's right end, its leftmost match so far, its interval
    end = length[lane].copy()
    left, lo, hi = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), len(text))
    while len(lane):
        a, b = index.step(text[start[lane] + left - 1], lo, hi)
        more = b - a >= 2
        left, lo, hi = np.where(more, left - 1, left), np.where(more, a, lo), np.where(more, b, hi)
        over = ~more | (left == 0)
        if over.any():
            o = np.flatnonzero(over)
            n = end[o] - window - left[o] + 1  # windows within the match: starts left .. end - window
            good = n > 0
            mask[lane[o[good]]] |= ((np.int64(1) << n[good]) - 1) << left[o[good]]
            # a window not judged yet starts before left, so it ends by left - 1 + window
            end[o] = np.minimum(end[o] - 1, left[o] - 1 + window)
            stop = (left[o] == 0) | (end[o] < window)
            left[o], lo[o], hi[o] = end[o], 0, len(text)
            live = np.ones(len(lane), bool)
            live[o[stop]] = False
            lane, end, left, lo, hi = lane[live], end[live], left[live], lo[live], hi[live]
    return mask


def _shards(it: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, body, times, words) in order of key: index after index, each of whole keys."""

    def flush(rows):
        mask = statistics([r[3] for r in rows], np.array([r[2] == 1 for r in rows]), window)
        full = [(1 << (len(r[3]) - window + 1)) - 1 if r[2] > 1 else int(m) for r, m in zip(rows, mask, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(full, pa.int64())], ["key", "body", "mask"])

    rows: list[tuple] = []
    for batch in it:
        key, body, times = (batch.column(i).to_numpy() for i in range(3))
        words = batch.column(3)
        for i in range(batch.num_rows):
            if len(rows) >= limit and rows[-1][0] != key[i]:
                yield flush(rows)
                rows = []
            rows.append((int(key[i]), int(body[i]), int(times[i]), np.frombuffer(words[i].as_py(), np.uint64)))
    if rows:
        yield flush(rows)


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD_SEGMENTS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, fp, start, mask) of each segment of docs (doc_id, fp, text) with a window that repeats.

    Bit j of mask stands for the window that starts at word start + j.
    """
    segs = cut(docs, window, anchor)
    again = segs.groupBy("key").agg(F.count("*").alias("places")).where("places > 1").select("key")
    some = stored(segs.join(again, "key"), "fm-some")
    group = some.groupBy("key", "body").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc_id", "fp", "start", "n")])  # of one row, in hash buffers
    group = stored(group, "fm-groups")
    kinds = group.groupBy("key").agg(F.count("*").alias("kinds"))
    group = stored(group.join(kinds, "key"), "fm-kinds")
    alone = group.where("kinds = 1").select("key", "body", F.lit(None).cast("bigint").alias("mask"))
    mixed = group.where("kinds > 1").select("key", "body", "times", "kinds", "doc_id", "fp", "start", "n")
    places = mixed.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "n", "key", "body", "times", "kinds")).alias("at"))
    held = docs.join(places, docs["doc_id"].eqNullSafe(places["doc_id"]) & (docs["fp"] == places["fp"])).select("at", "text")

    def lift(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        w, out = Words(texts), []
        h = w.hash
        for i, at in enumerate(kept["at"].to_pylist()):
            for p in at:
                a = w.first[i] + p["start"]
                words = h[a : a + p["n"] + window - 1]
                if p["kinds"] <= hot:
                    out.append((p["key"], p["body"], p["times"], 0, 0, words.tobytes()))
                else:
                    one = grams(words, window).view(np.int64)
                    out += [(p["key"], p["body"], p["times"], j, int(x), None) for j, x in enumerate(one)]
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()], strict=True)], ["key", "body", "times", "place", "one", "words"])

    lifted = map_texts(held, ["at"], lift, "key bigint, body bigint, times bigint, place int, one bigint, words binary")
    # a row of the documents that repeats lifts its segments again
    lifted = stored(lifted, "fm-words")
    sharded = lifted.where("words is not null").groupBy("key", "body").agg(F.first("times").alias("times"), F.first("words").alias("words"))
    size = sharded.select("key").count()
    sharded = sharded.repartition(max(1, -(-size // shard)), "key").sortWithinPartitions("key")
    masks = sharded.mapInArrow(lambda it: _shards(it, window, shard), "key bigint, body bigint, mask bigint")
    single = lifted.where("words is null").select("key", "body", "times", "place", "one").distinct()
    twice = single.groupBy("one").agg(F.sum("times").alias("all")).where("all > 1").select("one")
    cutup = single.join(twice, "one").groupBy("key", "body").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    verdict = stored(alone.unionByName(masks).unionByName(cutup), "fm-masks").where("mask is null or mask != 0")
    full = F.expr("shiftleft(1L, n) - 1")
    return some.join(verdict, ["key", "body"]).select("doc_id", "fp", "start", F.coalesce(F.col("mask"), full).alias("mask"))


def keyed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.xxhash64("text").alias("fp"), "text")


def strip(df: DataFrame, window: int = WINDOW, texts: bool = True, **sizes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of df, and kept, the words left, if asked for."""
    docs = keyed(df)
    found = repeated(docs, window, **sizes)
    marks = found.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    rows = docs.join(marks, docs["doc_id"].eqNullSafe(marks["doc_id"]) & (docs["fp"] == marks["fp"]), "left").select(docs["doc_id"], "marks", "text")
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(kept: pa.Table, raw: list[bytes]) -> pa.Table:
        out = []
        for marks, t in zip(kept["marks"].to_pylist(), raw, strict=True):
            words = t.split()
            left = words
            if marks:
                edge = np.zeros(len(words) + 1, np.int64)
                for m in marks:
                    j = np.flatnonzero((m["mask"] >> np.arange(63)) & 1) + m["start"]
                    np.add.at(edge, j, 1)
                    np.add.at(edge, j + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                left = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            text = b" ".join(left)
            out.append((len(words), len(words) - len(left), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if texts else None))
        cols = list(zip(*out, strict=True))
        kept = kept.select(["doc_id"])
        for name, values, of in zip(["n_words", "n_removed", "kept_sha256", "kept"], cols, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True):
            kept = kept.append_column(name, pa.array(values, of))
        return kept

    out = map_texts(rows, ["doc_id", "marks"], run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(documents(spark, sf_dir), texts=False)


QUERIES = {"op2_substrings": op2_substrings}
ORACLES: dict[str, str] = {
    "op2_substrings": r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
x as (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35),
g as (select doc_id, i, count(*) over (partition by words[i:i + 34]) as places from x),
c as (select distinct doc_id, unnest(range(i, i + 35)) as j from g where places > 1),
m as (select doc_id, list(j) as gone from c group by doc_id),
k as (select w.doc_id, len(words) as n_words, coalesce(gone, []) as gone,
  array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: not list_contains(coalesce(gone, []), z[2])), lambda z: z[1]), ' ') as kept
  from w left join m using (doc_id))
select doc_id, n_words::bigint as n_words, len(gone)::bigint as n_removed, sha256(kept) as kept_sha256 from k"""
}
