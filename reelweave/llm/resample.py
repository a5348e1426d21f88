"""Importance resampling towards a target: hashed n-gram gains, Gumbel noise, the highest scores drawn.

A document's features are its runs of one and of two words; each falls into one of BUCKETS buckets.
The gain of a bucket is the rounded logarithm of its (add-one) share in the target over that in the
corpus, a document's weight the mean gain of its features.

Texts are cut and hashed once: higher-order functions make the array of a document's buckets, which is
written without the text.  Counting explodes that table, scoring folds its arrays over ``element_at`` of a
literal array of BUCKETS gains.  What counting shuffles are the totals, at most BUCKETS rows of a task;
those are also all that the driver sees.

The draw needs no global sort: scores are whole numbers of a narrow range, so the number of documents
with each score (an aggregation) tells the lowest drawn score and what rank each score starts with;
rows are then ranked among their equals only, and those below the cut are not shuffled.

Defined cases: a null or empty text has no features and weight 0; a null id hashes as an empty one and
is the last among equal scores; rows that tie in score and id are ranked in the order of features and
weight, each by itself; an empty corpus gives an empty result, an empty target T = 0; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm._shared import written

BUCKETS = 10_000
#: A word is a run of ASCII letters and digits and of any other characters beyond ASCII.
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def buckets(words: Column) -> Column:
    """Bucket of each word, then of each pair of neighbouring words."""
    bucket = lambda s: F.crc32(s.cast("binary")) % BUCKETS
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: bucket(F.concat_ws(" ", a, b)))
    return F.concat(F.transform(words, bucket), pairs)


def featured(docs: DataFrame) -> DataFrame:
    """docs with n_words and buckets in place of their texts."""
    found = docs.withColumn("words", words(F.col("text"))).drop("text")
    return found.withColumn("n_words", F.size("words")).withColumn("buckets", buckets(F.col("words"))).drop("words")


def totals(featured: DataFrame) -> dict[int, int]:
    """Features in each bucket over all rows: at most BUCKETS numbers."""
    found = featured.select(F.explode("buckets").alias("bucket"))
    return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """floor(1000 ln of the target's share over the corpus's) of each bucket."""
    s, t = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((corpus.get(b, 0) + 1.0) * t))) for b in range(BUCKETS)]


def weigh(found: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of (doc_id, n_words, buckets)."""
    # a text that is split and cast becomes one literal array before the job runs
    held = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    found = found.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(held, (b + 1).cast("int"))).alias("gain"))
    found = found.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(0).cast("long").alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    return found.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with ``rank``: 1, 2, ... for the highest scores of rows with enough words, null for the rest.

    scored is read several times, so it should be a written table.
    """
    enough = F.col("n_words") >= least_words
    by_score = scored.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    # one row for each distinct score, whose number the range of gains and noise bounds
    places = written(by_score.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")), "places")
    drawn = places.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * percent / 100).cast("long").alias("k")).first()["k"]
    cut = places.where(F.col("before") < drawn).agg(F.min("score").alias("cut")).first()["cut"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = enough & (F.col("score") >= cut)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    placed = scored.where(high).withColumn("place", F.row_number().over(order)).join(places.select("score", "before"), "score")
    rank = F.col("before") + F.col("place")
    top = placed.withColumn("rank", F.when(rank <= drawn, rank))
    return top.select(*scored.columns, "rank").unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs."""
    found = written(featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "featured")
    return draw(written(weigh(found, gains(totals(found), totals(featured(target.select("text")))), seed), "weighed"), least_words, percent)
