"""Shared folders, doc splits and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one named by the session a temporary one, if all run on this machine."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark.sparkContext, "_reelweave_shared"):
        spark.sparkContext._reelweave_shared = tempfile.mkdtemp(prefix="reelweave-")
    return spark.sparkContext._reelweave_shared


BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session has chosen a size: batches of a number of rows grow with the texts."""
    if int(spark.conf.get(_BATCH, str(2**31 - 1)).rstrip("b")) >= 1 << 28:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Whose tables ``written`` makes now, and by owner the places of passing tables that ``clear`` has not deleted.
_owner: ContextVar[str | None] = ContextVar("owner", default=None)
_tables: dict[str, list[str]] = {}


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Passing tables made inside belong to ``owner``; those made elsewhere, which other results may still read, to no one."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def written(df: DataFrame, name: str, passing: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing twice.

    Passing tables with an owner can be deleted by ``clear``.
    """
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if passing and _owner.get():
        _tables.setdefault(_owner.get(), []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, owner: str = "pipeline") -> None:
    """Delete the owner's passing tables made so far; results that were read from them must have been written."""
    for place in _tables.pop(owner, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo divisor."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


#: A star's edges are dealt to so many tasks.
SALTS = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m the smallest v of each u; the edges of one u are spread over SALTS keys, so no star meets in a task.

    Merged, not broadcast: each broadcast of each round would build a table in the driver.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low.hint("merge"), ["u", "s"]).select("u", "v", "m")


def _settled(pairs: DataFrame) -> bool:
    """Whether all edges (u > v) form stars: each u has one v and no v is a u, so v is the smallest id of its component."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0] == 0


def stars(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list as stars: (u, v) of every id u but the smallest of its component, v that smallest.

    Alternates the large-star and small-star steps until all edges form stars: each is one shuffle of
    the edges, stars of any size are split by salting, and the number of rounds grows with the
    logarithm of the longest path.  Edges that a large-star step repeats go with the small-star step.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, done = written(pairs, "edges"), 0
    while not _settled(pairs):
        if done == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs, done = written(small.where("u <> v").distinct(), "edges"), done + 1
    return pairs


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (id, component), component the smallest id.

    Ids that occur in no edge are absent.
    """
    pairs = stars(edges, a, b, rounds)
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
