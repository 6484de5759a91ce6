"""A training corpus from documents: each stage works on all rows that the one before kept.

Quality rules and toxicity drop rows, the n-gram join leaves one document of
each group of near duplicates, the mix takes documents as often as its sources'
weights say, and the last stage gives every row's ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import bpe, mixing, ngram_join, quality, toxicity
from attestor.llm.common import passing, remove, shared_dir

STAGES = [
    ("quality", quality.keep_good),
    ("toxicity", toxicity.keep_civil),
    ("ngram_join", ngram_join.keep_one),
    ("mixing", mixing.take_mix),
    ("bpe", bpe.encode_documents),
]

#: No SQL gives a learned grammar's verdicts or BPE ids; tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents of ``sf_dir``; each stage is written and read again.

    Null, empty and short texts go in the first stage; rows that repeat and null
    ids are handled as each stage says; an empty table gives an empty result;
    other columns are handed on up to the last stage. What a stage wrote on its way, and the stage before, is deleted once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, done = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, done)
        done = f"{folder}/{name}"
    return docs
