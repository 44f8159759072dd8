"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut before white space that follows a letter or digit of any script, and in scripts without
spaces before the punctuation that follows a letter: the pattern ends a piece there whatever comes next, so
the parts give the ids of the whole. Ids are decoded to raw bytes, never through replacement characters.

Defined results: a null or empty text has no ids and decodes to nothing; a text without a safe
boundary (one run of letters, say, which is one match of the pattern) is encoded whole; rows and ids that repeat are encoded each; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a long text is cut at the next safe boundary.
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[\p{L}\p{N}])(?=\s)|(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])(?=[。、，．！？；：「」『』（）…])")


@functools.lru_cache(maxsize=4)
def encoder(ranks: str):
    """The encoder of a rank file: a path, or the name of a public tokenizer's file."""
    import public_tokenizers
    import tiktoken

    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of at least size characters, cut only where the pattern cuts."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode(enc, text: str) -> list[int]:
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def with_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(key, ids array<int>, decoded binary) for each row: the ids of the text and their bytes."""
    kind = df.schema[key].dataType.simpleString()

    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        enc = encoder(ranks)
        ids = [encode(enc, t.decode("utf-8", "replace")) for t in texts]
        return kept.append_column("ids", pa.array(ids, pa.list_(pa.int32()))).append_column("decoded", pa.array([enc.decode_bytes(i) for i in ids], pa.binary()))

    return map_texts(df, [key], run, f"{key} {kind}, ids array<int>, decoded binary", text)


def token_digests(df: DataFrame, text: str = "text", key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each row, digested where the ids are made."""
    kind = df.schema[key].dataType.simpleString()

    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        enc, n, a, b = encoder(ranks), [], [], []
        for t in texts:
            ids = encode(enc, t.decode("utf-8", "replace"))
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return kept.append_column("n_tokens", pa.array(n, pa.int64())).append_column("ids_sha256", pa.array(a, pa.string())).append_column("decoded_sha256", pa.array(b, pa.string()))

    return map_texts(df, [key], run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", text)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token digests of every document that is left."""
    return token_digests(docs)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
