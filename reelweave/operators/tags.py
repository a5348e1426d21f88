"""Scored tags in texts: (tag:score) pairs, ranked and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATTERN = r"\(([^:]+):([-+]?\d*\.\d+|\d+)\)"


def scored_tags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, tag, score) of every tag in order."""
    tags = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))
    scores = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(2))
    both = F.posexplode(F.arrays_zip(tags.alias("t"), scores.alias("s"))).alias("pos", "x")
    return texts.select(key, both).select(key, "pos", F.col("x.t").alias("tag"), F.col("x.s").cast("double").alias("score"))


def top_tags(texts: DataFrame, key: str, text: str, cutoff: float, k: int) -> DataFrame:
    """(key, rank, tag, score): best score of each positive tag; those over the cutoff and the k best.

    Equal scores keep the order in which their tags first occur.
    """
    best = scored_tags(texts, key, text).where("score > 0").groupBy(key, "tag").agg(F.max("score").alias("score"), F.min("pos").alias("first"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first")))
    return ranked.where((F.col("score") > cutoff) | (F.col("rank") <= k)).select(key, "rank", "tag", "score")


def negative_tags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, tag): tags scored 0 or less, in order, repeats kept."""
    return scored_tags(texts, key, text).where("score <= 0").select(key, "pos", "tag")
