"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last return the columns of docs. run() applies them to
the documents table, each stage's result being written to the shared folder as
Parquet and read again as the next one's docs.

Edge cases are those of the operators: rows with a null or empty text or a null
doc_id pass every filter that can't judge them; an empty table gives an empty
table of the last stage's columns; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, decontam, quality, simhash, toxicity
from tracewright.llm.common import drop, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: toxic documents go."""
    stems = toxicity.learn_stems(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, toxicity.lexicon(stems=stems))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near-duplicates one document stays."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the text as token ids, and decoded from them again."""
    return bpe.encode_rows(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("byte-level bpe", token_ids),
]

#: No stage but the decontamination comes near SQL: see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
