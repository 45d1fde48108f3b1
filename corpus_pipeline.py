"""Corpus pipeline: toxicity filter, near-dedup, decontamination, pseudonyms, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all
but the last return the columns of ``documents``. Stages are written as Parquet and read again
in between, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.shared import spread, written
from mnemospark.llm import decontam, packing, pseudonyms, simhash, toxicity
from mnemospark.llm.queries import PSEUDONYM_KEY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels.where(toxicity.learnable())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, that of its smallest id."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced; a column ``n_chars``, if there is one, follows the text."""
    out = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]
#: No stage can be put in SQL as a whole: the tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
