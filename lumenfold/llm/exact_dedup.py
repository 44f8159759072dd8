"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised bytes. A directory of 2**depth slots, addressed by
the key's first bits, points to buckets; a bucket with more distinct keys than its capacity is split in
two, and the directory doubles where a split needs one more bit than it has. Repeated texts have one
key, so they never overfill a bucket; at MAX_DEPTH bits a bucket takes whatever comes.

Filling. Equal texts of one batch of rows are combined where they are read, so a text that fills a third of
the table travels as a row a batch. The directory sends each entry to the owner of its bucket: an owner has
buckets that follow each other, a range of keys of about OWNER_BYTES of text. It reads its entries bucket by
bucket and key by key, compares bytes, and chains the different texts of one key; of each text it writes
one row (bucket, key, chain, sha, keep_id, group_size) to the shared folder, in the order of bucket and key.

Lookup. Every row goes through the directory to its bucket, and there along the chain of its key to the
entry with its SHA-256. What the directory or the index does not have is not found. Both sides of the lookup
are without texts; a hot key is split by Spark's skew join.

Only counts and bytes by slot reach the driver, at most 2**MAX_DEPTH rows, and the directory that is broadcast
has at most as many. Beyond about CAPACITY * 2**MAX_DEPTH keys buckets grow, and owners have one bucket each.

Defined results: a null text counts as empty; empty texts are a group; of equal texts the largest
doc_id stays, a null doc_id only if there is no other; of rows that agree in doc_id too, one is marked
kept; extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, packed, stored, tie_order, unpacked

#: Distinct keys that a bucket holds before it is split.
CAPACITY = 512
#: Bits of the key that the directory may use: the directory has at most 2**MAX_DEPTH slots.
MAX_DEPTH = 16
#: Bytes of text that an owner task has, about.
OWNER_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str | Column = "text") -> Column:
    """The text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def slot(key: Column, depth: int) -> Column:
    """The first depth bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """The buckets as (first bits, number of bits, bytes), from keys (key, bytes) counted by slot.

    It grows as an index that is filled row by row: from one bucket, each overfull one splits, and the
    directory's depth is the largest number of bits in use.
    """
    distinct = keys.groupBy("key").agg(F.max("bytes").alias("bytes"))
    rows = distinct.groupBy(slot(F.col("key"), max_depth).alias("slot")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    held = sorted((r["slot"], r["n"], r["bytes"]) for r in rows)
    done, todo = [], [(0, 0, held)]
    while todo:
        bits, depth, mine = todo.pop()
        if depth == max_depth or sum(n for _, n, _ in mine) <= capacity:
            done.append((bits, depth, sum(b for _, _, b in mine)))
            continue
        half = max_depth - depth - 1
        low = [x for x in mine if not x[0] >> half & 1]
        todo += [(2 * bits, depth + 1, low), (2 * bits + 1, depth + 1, mine[len(low) :])]
    return sorted(done, key=lambda b: b[0] << (max_depth - b[1]))


def table_of(spark: SparkSession, buckets: list[tuple[int, int, int]], owner_bytes: int = OWNER_BYTES) -> tuple[DataFrame, int, int]:
    """The directory as a table (slot, bucket, owner), its depth and the number of owners."""
    depth, rows, before = max(d for _, d, _ in buckets), [], 0
    for b, (bits, d, size) in enumerate(buckets):
        first = bits << (depth - d)
        rows += [(s, b, before // owner_bytes) for s in range(first, first + (1 << (depth - d)))]
        before += size
    names = {o: i for i, o in enumerate(sorted({r[2] for r in rows}))}
    made = spark.createDataFrame([(s, b, names[o]) for s, b, o in rows], "slot bigint, bucket int, owner int")
    return made, depth, len(names)


def combined(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, norm, keep_id, n): the different texts of each batch of rows, with their largest id and number."""
    picked = df.select(F.col(key).cast("long").alias("doc_id"), normal(text).alias("norm")).select("doc_id", F.xxhash64("norm").alias("key"), "norm")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held: dict = {}
            for i, (d, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                held.setdefault(k, []).append((i, d))
            norm, out = batch.column(2).cast(pa.large_binary()), []
            for k, rows in held.items():
                kinds: dict = {}
                for i, d in rows:
                    t = norm[i].as_py() if len(rows) > 1 else None
                    at, keep, n = kinds.get(t, (i, None, 0))
                    kinds[t] = (at, d if keep is None else keep if d is None else max(keep, d), n + 1)
                out += [(k, *kind) for kind in kinds.values()]
            if out:
                key_, at, keep, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key_, pa.int64()), batch.column(2).take(pa.array(at)), pa.array(keep, pa.int64()), pa.array(n, pa.int64())], ["key", "norm", "keep_id", "n"])

    return picked.mapInArrow(run, "key bigint, norm string, keep_id bigint, n bigint")


def _owner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's entries (bucket, key, norm, keep_id, n) in order: the chains of each key, bytes compared."""
    now, chain, out = None, {}, []

    def flush():
        for place, (text, (keep, n)) in enumerate(chain.items()):
            out.append((*now, place, hashlib.sha256(text).hexdigest(), keep, n))

    def made():
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "key", "chain", "sha", "keep_id", "group_size"])

    for batch in it:
        norm = batch.column(2).cast(pa.large_binary())
        for i, (b, k, d, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
            if (b, k) != now:
                flush()
                now, chain = (b, k), {}
            text = norm[i].as_py()
            keep, held = chain.get(text, (None, 0))
            chain[text] = (d if keep is None else keep if d is None else max(keep, d), held + n)
        yield made()
        out.clear()
    flush()
    yield made()


class Index:
    """The stored index and its directory; keys is a table (key, bytes) of every row."""

    def __init__(self, df: DataFrame, keys: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, owner_bytes: int = OWNER_BYTES):
        self.buckets = directory(keys, capacity, max_depth)
        self.slots, self.depth, owners = table_of(df.sparkSession, self.buckets, owner_bytes)
        sent = self.placed(combined(df, text, key)).select("bucket", "key", "norm", "keep_id", "n", "owner")
        owned = sent.repartitionById(owners, "owner").drop("owner").sortWithinPartitions("bucket", "key")
        self.rows = stored(owned.mapInArrow(_owner, "bucket int, key bigint, chain int, sha string, keep_id bigint, group_size bigint"), "exact-index")

    def placed(self, df: DataFrame) -> DataFrame:
        """df with the bucket and the owner that the directory has for its key."""
        held = F.broadcast(self.slots.withColumnRenamed("slot", "_slot"))
        return df.withColumn("_slot", slot(F.col("key"), self.depth)).join(held, "_slot").drop("_slot")

    def lookup(self, df: DataFrame) -> DataFrame:
        """df (key, sha, ...) with keep_id and group_size of its entry, found by bucket, key and along the chain."""
        return self.placed(df).drop("owner").join(self.rows, ["bucket", "key", "sha"]).drop("bucket", "chain")


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", **sizes) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of df."""
    norm = df.select(F.col(key).cast("long").alias("doc_id"), normal(text).alias("norm"))
    rows = norm.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("bytes"))
    rows = stored(rows, "exact-rows")
    out = Index(df, rows, text, key, **sizes).lookup(rows)
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows that agree in doc_id and text compete; every other row is alone in its window
    rank = F.row_number().over(Window.partitionBy("sha", F.when(~wins, F.col("uid"))).orderBy("uid"))
    return out.select("doc_id", "keep_id", "group_size", (wins & (rank == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts stays, found through the index.

    Of rows that agree in doc_id and text the first by all their columns stays.
    """
    keys = docs.select(normal().alias("norm")).select(F.xxhash64("norm").alias("key"), F.octet_length("norm").cast("long").alias("bytes"))
    index = Index(docs, keys)
    row = F.col("row")
    rows = packed(docs).withColumn("norm", normal(row["text"])).select("row", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))
    won = index.lookup(rows).where(row["doc_id"].cast("long").eqNullSafe(F.col("keep_id")))
    rank = F.row_number().over(Window.partitionBy("sha", row["doc_id"]).orderBy(*tie_order()))
    return unpacked(won.withColumn("rank", rank).where("rank = 1"), docs)


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d"""
}
