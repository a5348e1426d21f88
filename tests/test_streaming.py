"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from reelweave.operators import stats
from reelweave.streaming import events as E


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def source(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/events")
    return rows, spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/events")


def test_windows_and_throttle(spark, data, tmp_path):
    rows, stream = source(spark, data, tmp_path)
    got = run(spark, E.sliding(stream, "2 hours", "1 hour", ["event_type"], "1 hour"), "windows", "complete")
    want = E.sliding(rows, "2 hours", "1 hour", ["event_type"])
    pick = lambda d: sorted((str(r.start), r.event_type, r.n) for r in d.collect())
    assert pick(got) == pick(want)
    last = run(spark, E.throttled(stream, "1 hour", ["event_type"], "1 hour"), "last", "complete")
    pick = lambda d: sorted((str(r.start), r.event_type, r.event_id) for r in d.collect())
    assert pick(last) == pick(E.throttled(rows, "1 hour", ["event_type"]))


def test_carried_state(spark, data, tmp_path):
    rows, stream = source(spark, data, tmp_path)
    got = run(spark, E.smoothed(stream, 0.6), "smoothed")
    want = stats.smooth(rows, "user_id", ["ts", "event_id"], "value", 0.6)
    pick = lambda d: {r.event_id: round(r.smoothed, 9) for r in d.collect()}
    assert pick(got) == pick(want)
