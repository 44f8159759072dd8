"""Language of texts by a linear-chain conditional random field over words.

Features of a word: its bytes' prefixes and suffixes of 1 to 4, its byte bigrams and trigrams with the
word's edges, and the word itself (the lexicon); all hashed to one weight table. Transitions between
labels are learned. Training maximises the conditional likelihood by forward-backward on code-switched
sequences: runs of words from labelled texts of different languages, spliced. A text's words get their
posteriors by forward-backward over the whole text; the text's label has the largest mean posterior.

Whole texts are labelled: blocks of words are contracted to transfer matrices, which chain exactly, so a
long text costs a few array operations a block and none is cut.

Training rows are a bounded sample, documented here: about SAMPLE rows a label, chosen by a hash of the id,
with their whole texts; the driver holds them, SAMPLE rows a label whatever the table's size. A sequence is
runs of words drawn from anywhere in those texts, and a word has all its features in training as in
prediction. Prediction reads texts alone.

Defined results: null, empty or letterless text is `und` with score 0; so is every text if no row is
labelled; one label only gives that label with score 1; rows that repeat get the same result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Words, documents, map_texts, mix, packed, unpacked

#: Labelled rows that training reads of each label, whole.
SAMPLE = 300
#: Spliced training sequences, their words, the shortest and longest run, and passes over them.
SEQUENCES, LENGTH, RUN, EPOCHS = 3000, 48, (4, 24), 4
BITS = 16
BLOCK = 32
UNKNOWN = "und"
#: Below this score the pipeline rejects a document.
MIN_SCORE = 0.3
_SEED = 7


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """By word: 9 places in the weight table (affixes, lexicon); by byte: 2 places (n-grams). 0 is empty."""
    low = np.where(w.space, 32, w.buf).astype(np.uint8)
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    b = np.concatenate(([32], low, np.full(8, 32))).astype(np.uint64)  # b[i + 1] is byte i
    length = w.end - w.start
    out = np.zeros((len(w.start), 9), np.int64)

    def place(x, kind):
        return ((mix(x * np.uint64(16) + np.uint64(kind)) >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.int64)

    head, tail = np.zeros(len(w.start), np.uint64), np.zeros(len(w.start), np.uint64)
    for k in range(4):
        head = head * np.uint64(256) + b[w.start + 1 + k]
        tail = tail * np.uint64(256) + b[np.maximum(w.end - k, 0)]
        fits = length > k
        out[:, k] = np.where(fits, place(head, k), 0)
        out[:, 4 + k] = np.where(fits, place(tail, 4 + k), 0)
    out[:, 8] = place(w.lower_hash(), 8)
    n = len(low)
    two = b[1 : n + 1] * np.uint64(256) + b[2 : n + 2]
    return out, np.stack((place(two, 9), place(two + b[:n] * np.uint64(65536), 10)), 1)


def gathered(w: Words, words: np.ndarray, by_byte: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all features of some words, word by word, and where each word's begin."""
    fixed, size = words.shape[1], w.end[which] - w.start[which]
    lead = np.concatenate(([0], np.cumsum(fixed + 2 * size)))
    flat = np.empty(int(lead[-1]), np.int64)
    at = lead[:-1, None] + np.arange(fixed)
    flat[at.ravel()] = words[which].ravel()
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte, put = np.repeat(w.start[which], size) + inner, np.repeat(lead[:-1] + fixed, size) + 2 * inner
    flat[put], flat[put + 1] = by_byte[byte, 0], by_byte[byte, 1]
    return flat, lead


def _byte_runs(w: Words) -> np.ndarray:
    return np.stack((w.start, w.end), 1).ravel()


class Model:
    """Weights by place and label, log transitions, labels in code-point order."""

    def __init__(self, labels: list[str], weights: np.ndarray, steps: np.ndarray):
        self.labels, self.weights, self.steps = labels, weights.astype(np.float32), steps

    def emissions(self, w: Words) -> np.ndarray:
        words, by_byte = features(w)
        out = np.zeros((len(words), len(self.labels)), np.float32)
        if len(words):
            for j in range(words.shape[1]):
                out += self.weights[words[:, j]]
            grams = self.weights[by_byte[:, 0]]
            grams += self.weights[by_byte[:, 1]]
            out += np.add.reduceat(grams, _byte_runs(w))[::2]
        return out

    def posteriors(self, w: Words) -> np.ndarray:
        """By word and label, exact over each whole text."""
        return chain(self.emissions(w), w.first, w.count, np.exp(self.steps))

    def mean(self, w: Words) -> np.ndarray:
        p = self.posteriors(w)
        total = np.stack([np.bincount(w.owner, p[:, k], len(w.texts)) for k in range(len(self.labels))], 1)
        return total / np.maximum(w.count, 1)[:, None]


def chain(emit: np.ndarray, first: np.ndarray, count: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward-backward over texts of count words from first, with a uniform start."""
    k = emit.shape[1] if emit.ndim == 2 else 1
    if not len(emit):
        return np.zeros((0, k))
    blocks = -(-count // BLOCK)
    lead = np.concatenate(([0], np.cumsum(blocks)))
    of = np.repeat(np.arange(len(count)), blocks)
    nth = np.arange(lead[-1]) - lead[:-1][of]
    begin = first[of] + nth * BLOCK
    size = np.minimum(count[of] - nth * BLOCK, BLOCK)
    at = begin[:, None] + np.minimum(np.arange(BLOCK), size[:, None] - 1)
    real = np.arange(BLOCK) < size[:, None]
    e = np.exp(emit - emit.max(1, keepdims=True))[at].astype(np.float64)  # block, word, label
    n = len(of)
    start = nth == 0
    eye = np.eye(k)
    # each block as one matrix: from the label before it to the label of its last word
    m = np.broadcast_to(eye, (n, k, k)).copy()
    for t in range(BLOCK):
        live = np.flatnonzero(real[:, t])
        x = (m[live].reshape(-1, k) @ step).reshape(-1, k, k)
        if t == 0:
            x[start[live]] = eye  # no step into the first word of a text
        x *= e[live, t][:, None, :]
        m[live] = x / x.sum((1, 2), keepdims=True)
    enter, leave = np.full((n, k), 1.0 / k), np.full((n, k), 1.0)
    texts = np.flatnonzero(blocks)
    order = texts[np.argsort(-blocks[texts], kind="stable")]
    for j in range(1, int(blocks.max(initial=0))):
        live = lead[order[: np.searchsorted(-blocks[order], -j, "left")]] + j
        a = np.einsum("nk,nkl->nl", enter[live - 1], m[live - 1])
        enter[live] = a / a.sum(1, keepdims=True)
    for j in range(int(blocks.max(initial=0)) - 1, 0, -1):
        live = lead[order[: np.searchsorted(-blocks[order], -j, "left")]] + j
        z = np.einsum("nkl,nl->nk", m[live], leave[live])
        leave[live - 1] = z / z.sum(1, keepdims=True)
    out = np.zeros((len(emit), k))
    alpha, a = np.zeros((n, BLOCK, k)), enter
    for t in range(BLOCK):
        x = a @ step
        if t == 0:
            x[start] = a[start]
        x = x * e[:, t]
        a = np.where(real[:, t, None], x / x.sum(1, keepdims=True), a)
        alpha[:, t] = a
    z = leave
    for t in range(BLOCK - 1, -1, -1):
        live = real[:, t]
        p = alpha[live, t] * z[live]
        out[at[live, t]] = p / p.sum(1, keepdims=True)
        back = (e[:, t] * z) @ step.T
        z = np.where(live[:, None], back / back.sum(1, keepdims=True), z)
    return out


def sample(df: DataFrame, bound: int = SAMPLE) -> list[tuple[str, bytes]]:
    """About bound labelled rows a label that are not held out, or all if there are fewer: (label, whole text)."""
    known = df.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.lit(_SEED)), F.lit(1 << 40))
    rows = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = rows.select("lang", (F.lit(float(bound)) / F.col("n") * (1 << 40)).cast("long").alias("below"))
    got = known.withColumn("hashed", hashed).join(F.broadcast(share), "lang").where("hashed < below").select("lang", "text").collect()
    return sorted((r["lang"], r["text"].encode()) for r in got if any(map(str.isalpha, r["text"])))


def fit(rows: list[tuple[str, bytes]], sequences: int = SEQUENCES, epochs: int = EPOCHS, seed: int = _SEED) -> Model:
    """Weights and transitions by stochastic gradients of the conditional likelihood, with scaled steps."""
    labels = sorted({r[0] for r in rows})
    k, rng = len(labels), np.random.default_rng(seed)
    weights, steps = np.zeros((1 << BITS, max(k, 1))), np.zeros((max(k, 1), max(k, 1)))
    if k < 2:
        return Model(labels, weights, steps)
    # runs of words are drawn from whole texts, and features are made of what is drawn
    w = Words([t for _, t in rows])
    label_of = np.array([labels.index(name) for name, _ in rows])
    pools = [np.flatnonzero((label_of == i) & (w.count > 0)) for i in range(k)]
    drawn, y = [], np.zeros((sequences, LENGTH), np.int64)
    for s in range(sequences):
        at = 0
        while at < LENGTH:
            lab = int(rng.integers(k))
            doc = pools[lab][rng.integers(len(pools[lab]))]
            n = min(int(rng.integers(RUN[0], RUN[1] + 1)), LENGTH - at, int(w.count[doc]))
            off = int(rng.integers(w.count[doc] - n + 1)) + w.first[doc]
            drawn.append(w.buf[w.start[off] : w.end[off + n - 1]].tobytes())
            y[s, at : at + n] = lab
            at += n
    w = Words(drawn)
    words, by_byte = features(w)
    x = np.arange(sequences * LENGTH).reshape(sequences, LENGTH)
    g2, s2, rate, batch = np.full(weights.shape, 1e-3), np.full(steps.shape, 1e-1), 0.15, 64
    one = np.eye(k)
    for _ in range(epochs):
        for at in range(0, sequences - batch + 1, batch):
            flat, lead = gathered(w, words, by_byte, x[at : at + batch].ravel())
            emit = np.add.reduceat(weights[flat], lead[:-1])
            a = np.exp(steps)
            n = len(emit)
            first = np.arange(0, n, LENGTH)
            post = chain(emit, first, np.full(batch, LENGTH), a)
            grad = one[y[at : at + batch].ravel()] - post
            # expected steps, from the posteriors of neighbours given by one more contraction
            e = np.exp(emit - emit.max(1, keepdims=True)).reshape(batch, LENGTH, k)
            fwd = np.zeros((batch, LENGTH, k))
            fwd[:, 0] = e[:, 0]
            for t in range(1, LENGTH):
                f = (fwd[:, t - 1] @ a) * e[:, t]
                fwd[:, t] = f / f.sum(1, keepdims=True)
            bwd = np.ones((batch, LENGTH, k))
            for t in range(LENGTH - 2, -1, -1):
                z = (e[:, t + 1] * bwd[:, t + 1]) @ a.T
                bwd[:, t] = z / z.sum(1, keepdims=True)
            pair = fwd[:, :-1, :, None] * a * (e[:, 1:] * bwd[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            yy = y[at : at + batch]
            seen = np.zeros((k, k))
            np.add.at(seen, (yy[:, :-1].ravel(), yy[:, 1:].ravel()), 1)
            gs = (seen - pair.sum((0, 1))) / n - 1e-4 * steps
            of = np.repeat(np.arange(n), np.diff(lead))
            gw = np.stack([np.bincount(flat, grad[of, i], 1 << BITS) for i in range(k)], 1) / batch - 1e-5 * weights
            gw[0] = 0
            g2 += gw**2
            s2 += gs**2
            weights += rate * gw / np.sqrt(g2)
            steps += rate * gs / np.sqrt(s2)
    return Model(labels, weights, steps)


def _has_letter(t: bytes) -> bool:
    return any(map(str.isalpha, t.decode("utf-8", "replace")))


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns to keep of each row of df, and its label and score."""
    kinds = StructType([*[df.schema[c] for c in keep], StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        letters = np.array([_has_letter(t) for t in texts])
        if len(model.labels) < 2:
            best, score = np.zeros(len(texts), int), np.full(len(texts), float(len(model.labels)))
            letters &= len(model.labels) > 0
        else:
            mean = model.mean(Words(texts))
            best, score = mean.argmax(1), mean.max(1)
        named = [model.labels[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
        return kept.append_column(names[0], pa.array(named, pa.string())).append_column(names[1], pa.array(np.where(letters, np.clip(score, 0, 1), 0.0)))

    return map_texts(df, keep, run, kinds, text)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(sample(docs))
    return predict(docs, model, ["doc_id"]).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter or without a likely language go."""
    rows = packed(docs).withColumn("text", F.col("row")["text"])
    judged = predict(rows, fit(sample(docs)), ["row"])
    return unpacked(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)), docs)


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
