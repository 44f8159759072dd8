"""A corpus from raw documents: language, copies, near copies, mix, tokens.

Each stage takes all that its predecessor kept and says in its own module what it does with nulls, ties and
repeats: texts without a letter go in the first, so null and empty ones never come further; of equal texts the
row with the largest doc_id stays, of near copies the smallest; rows that agree in doc_id and text are one, the
first by all their columns, so reruns agree; extra columns travel along whatever their names, and the last
stage returns ids and digests alone. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import bpe, crf, exact_dedup, jaccard, mixing
from lumenfold.llm.common import documents, stored

STAGES = [
    ("language_id", crf.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard", jaccard.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: No SQL: a trained model, components of a graph and a tokenizer stand in the way; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents, each one's rows written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
