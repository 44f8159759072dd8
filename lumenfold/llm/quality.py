"""Quality rules: a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Every document's words and word pairs are hashed to BUCKETS places and counted, for the whole corpus and
for the trusted documents (labelled quality 1 and not toxic); each task adds its counts up before the
shuffle. With add-one smoothing both are multinomials. A document's score is the mean over its n-grams of
log p_target - log p_raw, so length does not matter. A document passes if its score is at least the mean
less DEVIATIONS standard deviations of the trusted documents' own scores: one number for the corpus, from
all trusted documents, and no draw of chance.

Defined results: a null or empty text has no words, fails the base rule and scores 0; without trusted
documents all scores are 0 and the base rule alone decides; rows that repeat count each; a document is
trusted if any of its label rows says so; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, documents, grams, map_texts, mix, stored

BUCKETS = 1 << 16
DEVIATIONS = 4.0
#: Trusted ids are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_IDS = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def places(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and each pair of words of one text."""
    h = w.hash
    pair = grams(h, 2)
    inside = w.owner[:-1] == w.owner[1:] if len(h) > 1 else np.zeros(0, bool)
    owner = np.concatenate((w.owner, w.owner[:-1][inside] if len(h) > 1 else w.owner[:0]))
    return owner, (np.concatenate((h, pair[inside])) % np.uint64(buckets)).astype(np.int64)


def trusted_ids(labels: DataFrame) -> DataFrame:
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    return F.broadcast(ids) if labels.count() <= BROADCAST_IDS else ids


def marked(df: DataFrame, labels: DataFrame) -> DataFrame:
    ids = trusted_ids(labels)
    return df.select("doc_id", "text").join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def counts(df: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of all rows and of the trusted ones: two arrays of a fixed size."""
    picked = df.select("trusted", "text")

    def run(it):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in it:
            is_good = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for at, texts in batches(batch.column(1)):
                owner, b = places(Words(texts), buckets)
                raw += np.bincount(b, minlength=buckets)
                good += np.bincount(b[is_good[at : at + len(texts)][owner]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "good"])

    got = picked.mapInArrow(run, "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    raw[got["bucket"]], good[got["bucket"]] = got["raw"], got["good"]
    return raw, good


def ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    if not good.sum():
        return np.zeros(len(raw), np.float32)
    return (np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))).astype(np.float32)


def repeats(w: Words) -> np.ndarray:
    """By text: the words in windows of three that stand twice or more in it."""
    h, n = w.hash, len(w.hash)
    covered = np.zeros(n + 3, np.int8)
    if n >= 3:
        at = np.flatnonzero(w.owner[:-2] == w.owner[2:])
        of = mix(grams(h, 3)[at] ^ mix(w.owner[at].astype(np.uint64)))
        _, back, count = np.unique(of, return_inverse=True, return_counts=True)
        again = at[count[back] > 1]
        for k in range(3):
            covered[again + k] = 1
    return np.bincount(w.owner[covered[:n] > 0], minlength=len(w.texts))


def measured(df: DataFrame, llr: np.ndarray) -> DataFrame:
    """df's doc_id and trusted with the base counts and the score."""
    kind, buckets = df.schema["doc_id"].dataType.simpleString(), len(llr)

    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        w = Words(texts)
        owner, b = places(w, buckets)
        total, n = np.bincount(owner, llr[b], len(texts)), np.bincount(owner, minlength=len(texts))
        held = [[x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\f")] for t in texts]
        cols = {
            "n_words": w.count,
            "word_chars": w.per_text(~w.space & ((w.buf & 0xC0) != 0x80)),
            "n_symbols": w.per_text(_SYMBOL[w.buf]),
            "n_dup_lines": np.array([len(x) - len(set(x)) for x in held]),
            "n_repeat_words": repeats(w),
        }
        for name, x in cols.items():
            kept = kept.append_column(name, pa.array(x.astype(np.int64)))
        return kept.append_column("score", pa.array(total / np.maximum(n, 1)))

    return map_texts(df, ["doc_id", "trusted"], run, f"doc_id {kind}, trusted boolean, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, score double")


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, deviations: float = DEVIATIONS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)."""
    rows = marked(docs, labels)
    scored = measured(rows, ratio(*counts(rows, buckets)))
    scored = stored(scored.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "quality")
    of = scored.where("trusted and not base_failed").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    least = -float("inf") if of["m"] is None else of["m"] - deviations * of["s"]
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(least))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
