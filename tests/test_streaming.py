from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.operators.timeline import keep_latest
from rosterspark.streaming.snapshots import current, upsert_batches


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    keys, order = ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(upsert_batches(str(tmp_path / "out"), keys, order)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(map(tuple, current(spark, str(tmp_path / "out"), keys, order).select("event_id").collect()))
    assert got == sorted(map(tuple, keep_latest(events, keys, order).select("event_id").collect()))
