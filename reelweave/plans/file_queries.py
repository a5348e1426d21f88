"""Queries over image files that are written from the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.plans._query import query
from reelweave.plans.media_queries import _FRAMES, frames
from reelweave.sources import frame_files
from reelweave.sources.shared import fresh


def _files(spark, d) -> str:
    """A folder with each sequence's frames as PNG files, every sixth number left out."""
    frame_files.register(spark)
    where = fresh(spark, "frames")
    rows = frames(spark, d).select(F.format_string("seq%d", "seq_id").alias("prefix"), (F.col("frame_idx") + F.floor(F.col("frame_idx") / 5)).alias("sequence"), *[F.lit(n).alias(k) for k, n in (("h", 8), ("w", 8), ("c", 1))], "data")
    rows.write.format("frames").mode("append").option("path", where).save()
    return where


def _read(spark, where: str, **options):
    return spark.read.format("frames").options(path=where, **options).load()


_NUMBERED = f"""{_FRAMES}, s AS (SELECT 'seq' || seq_id AS prefix, frame_idx + frame_idx // 5 AS sequence, data FROM f)"""
_STORED = "floor(data[i // 3 + 1] * 255) / 255"


@query(f"""WITH {_NUMBERED}, n AS (SELECT DISTINCT prefix, r.k AS sequence FROM s, range(3, 43) AS r(k)),
g AS (SELECT n.prefix, n.sequence, data FROM n LEFT JOIN s USING (prefix, sequence))
SELECT prefix, sequence, CAST(NULL AS VARCHAR) AS error, CAST(i AS INTEGER) AS i, round({_STORED}, 9) AS v FROM g, range(192) AS r(i) WHERE data IS NOT NULL UNION ALL SELECT prefix, sequence, 'absent', NULL, NULL FROM g WHERE data IS NULL""")
def frame_files_range(spark, d):
    """Frames 3 to 42 of each sequence of PNG files, numbers without a file reported."""
    got = _read(spark, _files(spark, d), start=3, count=40, missing="report", batch=16)
    return got.select("prefix", "sequence", "error", F.posexplode_outer("data").alias("i", "v")).withColumn("v", F.round("v", 9))


@query(f"""WITH {_NUMBERED} SELECT prefix, sequence + 100 AS sequence, true AS same_bytes, CAST(i AS INTEGER) AS i, round({_STORED}, 9) AS v FROM s, range(192) AS r(i) WHERE sequence >= 4 AND sequence < 20""")
def frame_files_copied(spark, d):
    """Frames 4 to 19 of each sequence copied under numbers 100 higher, byte for byte."""
    where, to = _files(spark, d), fresh(spark, "frames")
    held = _read(spark, where, start=4, count=16, decode="false")
    held.select("prefix", "sequence", "format", "content").write.format("frames").mode("append").options(path=to, start=100).save()
    copied = _read(spark, to, decode="false").select("prefix", "sequence", F.col("content").alias("copy"))
    same = held.withColumn("sequence", F.col("sequence") + 100).join(copied, ["prefix", "sequence"]).select("prefix", "sequence", (F.col("content") == F.col("copy")).alias("same_bytes"))
    shown = _read(spark, to).select("prefix", "sequence", F.posexplode("data").alias("i", "v"))
    return same.join(shown, ["prefix", "sequence"]).withColumn("v", F.round("v", 9))
