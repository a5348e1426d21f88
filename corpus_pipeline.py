"""The corpus pipeline: toxicity, quality rules, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes
each stage's result as Parquet in the shared folder and rereads it as the next one's ``docs``.  All
stages but the last return the columns of documents.  When a stage begins, its predecessor's result has
been written, so it first deletes the tables that the predecessor's operator passed on to itself; tables
of other results of the session stay.

Defined cases: a null or empty text scores as no evidence of toxicity, fails the base rule of quality
(fewer than ten words) and so goes; texts of any length are read whole; repeated rows are judged one by
one and are one near-duplicate class, of which one row stays: that of the smallest id, of several texts
with that id the one with the smallest digest, and a null id only where the class has no other; a null
lang is a language of its own, a null source means nothing; columns besides those of documents are
carried as far as packing, whatever their names, and are not read;
an empty table gives an empty result, and without labels no document is rejected as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelweave.llm import near_dup, packing, quality, secrets, toxicity
from reelweave.llm._shared import clear, owned, written
from reelweave.llm.queries import vocabulary


OWNER = "pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger, trained on the labelled ones among them, scores below a half."""
    with owned(OWNER):
        return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's perplexity band."""
    clear(spark, OWNER)
    with owned(OWNER):
        return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    clear(spark, OWNER)
    with owned(OWNER):
        return near_dup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    clear(spark, OWNER)
    with owned(OWNER):
        return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    clear(spark, OWNER)
    with owned(OWNER):
        return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: No SQL for run(): training, alignment and packing are not SQL-expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}", passing=False)
    return docs
