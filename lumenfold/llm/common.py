"""What the operators of this subpackage share: batches of texts, hashed words, the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker handles at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a session whose driver and executors are one process gets a folder of its
    own; on a cluster that is an error, for no folder of one machine is shared. The path goes when the session ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    return path


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, for every later reader."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what came of them is stored itself."""
    for df in tables:
        where, files = _files(df.sparkSession, df._stored_at)
        files.delete(where, True)


def packed(df: DataFrame) -> DataFrame:
    """One column `row`, a struct of df's columns: helpers beside it cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like out of `row`."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def tie_order() -> list[Column]:
    """An order of rows of one key by all that they hold, the same in every run; what ties is alike."""
    return [F.md5(F.to_json(F.col("row")))]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batches(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes (null: empty), in runs of about limit bytes, with the place of each run's first."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts.cast(pa.large_binary())):
        t = t.as_py() or b""
        if run and size + len(t) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def map_texts(df: DataFrame, columns: list[str], fn: Callable, schema: str | StructType, text: str = "text") -> DataFrame:
    """fn(carried columns as an Arrow table, texts as bytes) -> Arrow table or dict, batch by batch.

    Only the named columns and the text reach Python, so clashing extra columns do no harm.
    """
    # the text comes last and is taken by place, so its name may be any
    picked = df.select(*[F.col(c) for c in columns], F.col(text).alias("_text"))

    def run(it):
        for batch in it:
            table = pa.Table.from_batches([batch])
            col = batch.column(len(columns))
            for at, run_ in batches(col):
                out = fn(table.slice(at, len(run_)).select(columns), run_)
                if isinstance(out, dict):
                    out = pa.table(out)
                yield from out.to_batches()

    return picked.mapInArrow(run, schema)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_P, pow(int(_P), -1, 1 << 64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, at least n of each."""
    return _powers(max(21, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts: bytes, starts, ends, owner and count by text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = b" ".join(texts) + b" "
        self.buf = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.text_end = self.text_start + lengths
        self.space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.space)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        first = np.searchsorted(self.start, self.text_start)
        self.first = first
        self.count = np.diff(np.concatenate((first, [len(self.start)])))
        self.owner = np.repeat(np.arange(len(texts)), self.count)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return self.hash_of(self.buf)

    def hash_of(self, buf: np.ndarray) -> np.ndarray:
        """A 64-bit value of each word's bytes, the same in every text."""
        p, inverse = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def lower_hash(self) -> np.ndarray:
        """As hash, with A-Z taken as a-z."""
        low = self.buf.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        return self.hash_of(low)

    def per_text(self, by_byte: np.ndarray) -> np.ndarray:
        """Sums of a value by byte over each text."""
        total = np.concatenate(([0], np.cumsum(by_byte, dtype=np.int64)))
        return total[self.text_end] - total[self.text_start]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value of each run of n words, at the place of its first (runs may cross texts)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    return mix(runs(h, np.arange(len(h) - n + 1), np.full(len(h) - n + 1, n)))


def runs(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit value of each run of words."""
    p, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h ^ _Q) * p[: len(h)], out=total[1:])
    return mix((total[start + length] - total[start]) * inverse[start] + length.astype(np.uint64))
